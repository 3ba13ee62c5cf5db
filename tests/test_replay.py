import random

import pytest
from pyspark.sql import functions as F

from weirflow.contracts import ContractError
from weirflow.operators import replay
from weirflow.operators.replay import RecordError

PROFILE = {"identity_source_column": "identity", "identity_normalized_column": "norm", "measurement_core_fields": ["price"]}
SCHEMA = "_file int, _row long, identity long, norm string, price double, kind string, rank long"


def records(spark, *files):
    rows = [(f, i, r[0], str(r[0]), float(r[1]), *(r[2:] or (None, None))) for f, part in enumerate(files) for i, r in enumerate((x if isinstance(x, tuple) else (x, 1.0)) for x in part)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize(
    "files, want",
    [([[9, 1, 5]], (3, 3, 9, 5)), ([[3, 3, 4]], (3, 2, 3, 4)), ([[1], [1, 2]], (3, 2, 1, 2)), ([[1, 1], [1], [1, 2, 2]], (6, 2, 1, 2))],
)
def test_canonicalize(spark, files, want):
    s = replay.canonicalize(records(spark, *files), PROFILE).validate()
    assert (s.rows, s.groups, s.first["identity"], s.last["identity"]) == want


@pytest.mark.parametrize("files", [[[1, 2, 1]], [[1], [2], [1]], [[1, 2], [1]]])
def test_recurrence_fails(spark, files):
    with pytest.raises(RecordError, match="recurs"):
        replay.canonicalize(records(spark, *files), PROFILE)


def test_core_conflicts_and_bad_identities_fail(spark):
    with pytest.raises(RecordError, match="core"):
        replay.canonicalize(records(spark, [(1, 1.0)], [(1, 2.0)]), PROFILE)
    with pytest.raises(RecordError, match="core"):
        replay.canonicalize(records(spark, [1]).withColumn("price", F.lit(None).cast("double")), PROFILE)
    for bad in (0, -3):
        with pytest.raises(RecordError, match="positive"):
            replay.canonicalize(records(spark, [bad]), PROFILE)
    with pytest.raises(RecordError, match="mismatch"):
        replay.canonicalize(records(spark, [1]).withColumn("norm", F.lit("01")), PROFILE)
    for value in (F.lit(True), F.lit(1.5), F.lit(float("nan")), F.lit(float("inf")), F.lit(None).cast("double"), F.lit("x")):
        with pytest.raises(RecordError, match="positive"):
            replay.canonicalize(records(spark, [1]).withColumn("identity", value), PROFILE)


def test_sentinels(spark):
    plain = PROFILE | {"sentinel": {"identity_equals": -1}}
    exact = PROFILE | {"sentinel": {"identity_equals": -1, "exact_match_fields": {"kind": "boundary", "rank": 7}}}
    nulls = PROFILE | {"sentinel": {"identity_equals": -1, "exact_match_fields": {"kind": None}}}
    good = records(spark, [(-1, 0.0, "boundary", 7), 1, 2])
    assert [replay.canonicalize(good, p).witnesses for p in (plain, exact)] == [1, 1]
    with pytest.raises(RecordError):
        replay.canonicalize(records(spark, [(-1, 0.0, "boundary", 8), 1]), exact)
    assert replay.canonicalize(records(spark, [(-1, 0.0, None, 8), 1]), nulls).witnesses == 1


def test_witness_counts_follow_files_with_rows(spark):
    p = PROFILE | {"sentinel": {"identity_equals": -1}}
    assert replay.canonicalize(records(spark, [-1], [-1, 1]), p).witnesses == 1
    assert replay.canonicalize(records(spark, [-1, -1], [-1]), p).witnesses == 1


def test_merge(spark):
    run = lambda *ids: replay.canonicalize(records(spark, list(ids)), PROFILE)
    s = replay.merge(run(1), run(1, 2))
    assert (s.rows, s.groups) == (2, 2) and s.validate()
    assert replay.merge(run(1, 2), run(3)).groups == 3
    with pytest.raises(RecordError, match="recurs"):
        replay.merge(run(1, 2), run(3, 1))
    with pytest.raises(RecordError, match="boundary"):
        replay.merge(run(1), replay.canonicalize(records(spark, [(1, 2.0)]), PROFILE))
    with pytest.raises(RecordError, match="bucket_count"):
        replay.merge(run(1), replay.canonicalize(records(spark, [2]), PROFILE | {"bucket_count": 8}))


@pytest.mark.parametrize("n", [0, 3, 8192])
def test_bucket_counts_are_powers_of_two(spark, n):
    with pytest.raises(ContractError):
        replay.canonicalize(records(spark, [1]), PROFILE | {"bucket_count": n})


def test_buckets_follow_the_published_mixer(spark):
    def mix(x):
        m = (1 << 64) - 1
        x = (x + 0x9E3779B97F4A7C15) & m
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
        return x ^ (x >> 31)

    ids = random.Random(1).sample(range(1, 2**62), 500)
    s = replay.canonicalize(records(spark, ids), PROFILE | {"bucket_count": 64})
    assert {r.identity: r.bucket for r in s.identities.collect()} == {i: mix(i) & 63 for i in ids}


def test_changes_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(replay, "BLOCK_ROWS", 3)
    ids = [x for x in range(1, 30) for _ in range(random.Random(x).randrange(1, 6))]
    s = replay.canonicalize(records(spark, ids[:20], ids[20:]), PROFILE)
    assert (s.rows, s.groups) == (len(ids), 29)


JSON = {"source_column": "raw", "key_path": ["tick", "id.x"], "scalar_type": "integer", "output_column": "out"}


@pytest.mark.parametrize("raw, want", [('{"tick":{"id.x":5}}', 5), ('{"tick":{"id.x":2.0}}', 2), ('{"tick":{"id.x":1e3}}', 1000), ('{"tick":{"id.x":-7, "y":[]}}', -7)])
def test_json_integers(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert replay.project_json(df, [JSON]).first().out == want


@pytest.mark.parametrize("raw", [None, "{", '{"tick":{"id.x":true}}', '{"tick":{"id.x":1.5}}', '{"tick":{"id.x":"5"}}', '{"tick":{}}', '{"tick":[1]}', "[1]", '{"tick":{"id.x":null}}'])
def test_json_failures(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    with pytest.raises(Exception, match="JSON projection out"):
        replay.project_json(df, [JSON]).collect()


def test_json_strings_and_bundle_rules(spark):
    df = spark.createDataFrame([('{"a":"x"}',)], "raw string")
    p = {"source_column": "raw", "key_path": ["a"], "scalar_type": "string", "output_column": "s"}
    assert replay.project_json(df, [p]).first().s == "x"
    for bad in ([p, p], [p, p | {"source_column": "s", "output_column": "t"}], [p | {"output_column": "raw"}], [p | {"key_path": ["a"] * 9}], [p | {"output_column": "a b"}], [p | {"scalar_type": "float"}]):
        with pytest.raises(ValueError):
            replay.project_json(df, bad)


WINDOW = {
    "symbol": "x", "symbol_column": "symbol", "block_column": "block", "timestamp_column": "timestamp_ms", "decision_timestamp_ms": 5000, "causal_cutoff_block": 5,
    "as_of_measurement_field": "price", "profile": PROFILE, "as_of_offsets_ms": [0, 200], "tie_break_columns": ["timestamp_ms", "seq"],
    "trailing_windows": [{"fact_id": "trail", "measurement_field": "price", "trailing_width_ms": 2000}],
    "future_windows": [{"fact_id": "future", "measurement_field": "price", "start_offset_ms": 1000, "end_offset_ms": 3000, "min_block_exclusive": 5}],
}


def events(spark, rows):
    """rows: (identity, symbol, block, ts, price, seq)"""
    full = [(0, i, r[0], str(r[0]), *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "_file int, _row long, identity long, norm string, symbol string, block long, timestamp_ms long, price double, seq long").repartition(3)


def walk(rows, p):
    """Row-at-a-time oracle."""
    last = {}
    for r in rows:
        if r[1] == p["symbol"]:
            last[r[0]] = r
    d, kept = p["decision_timestamp_ms"], list(last.values())
    causal = [r for r in kept if r[2] <= p["causal_cutoff_block"]]
    facts = {}
    for w in p["trailing_windows"]:
        inside = [r for r in causal if d - w["trailing_width_ms"] < r[3] <= d]
        facts[w["fact_id"] + ".sum"] = float(sum(r[4] or 0 for r in inside))
        facts[w["fact_id"] + ".count"] = float(len(inside))
    pick = lambda rs, f: f(rs, key=lambda r: (r[3], r[5]))[4] if rs else None
    for o in p["as_of_offsets_ms"]:
        facts[f"as_of.{o}"] = pick([r for r in causal if r[3] <= d - o], max)
    for w in p["future_windows"]:
        facts[w["fact_id"]] = pick([r for r in kept if d + w["start_offset_ms"] <= r[3] <= d + w["end_offset_ms"] and r[2] > w["min_block_exclusive"]], min)
    return facts


def test_window_bounds(spark):
    rows = [(1, "x", 1, 2900, 1.0, 0), (2, "x", 2, 3000, 9.0, 0), (3, "x", 3, 3100, 2.0, 0), (4, "x", 4, 5000, 3.0, 0), (5, "x", 6, 5000, 4.0, 1), (6, "x", 6, 6000, 8.0, 0), (7, "y", 1, 4000, 50.0, 0)]
    got = {r.fact_id: r.value for r in replay.event_window(events(spark, rows), WINDOW).collect()}
    assert got == {"trail.sum": 5.0, "trail.count": 2.0, "as_of.0": 3.0, "as_of.200": 2.0, "future": 8.0}


@pytest.mark.parametrize("seed", range(4))
def test_window_equals_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1, 60):
        base = (i, rng.choice("xy"), rng.randrange(10), rng.randrange(2500, 8500, 100), float(rng.randrange(50)))
        rows += [(*base, i * 10 + k) for k in range(rng.choice([1, 1, 2]))]
    got = {r.fact_id: r.value for r in replay.event_window(events(spark, rows), WINDOW).collect()}
    assert got == walk(rows, WINDOW)


def test_a_bad_row_of_another_symbol_fails(spark):
    with pytest.raises(RecordError):
        replay.event_window(events(spark, [(1, "x", 1, 1, 1.0, 0), (-5, "y", 1, 1, 1.0, 0)]), WINDOW)


def test_splitmix_equals_whole_numbers(spark):
    from weirflow.functions import scalars

    def mix(x):
        m = (1 << 64) - 1
        x = (x + 0x9E3779B97F4A7C15) & m
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & m
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & m
        return x ^ x >> 31

    ids = [0, 1, 2, 255, 2**31, 2**63 - 1, -1, -(2**63), *range(-50, 1000, 37), 123456789012345678]
    got = spark.createDataFrame([(i,) for i in ids], "i long").select("i", scalars.splitmix64(F.col("i")).alias("x")).collect()
    assert all(r.x % (1 << 64) == mix(r.i % (1 << 64)) for r in got) and mix(0) == 0xE220A8397B1DCDAF
