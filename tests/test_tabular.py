import datetime as dt
import random

import pytest

from weirflow import registry
from weirflow.contracts import ContractError
from weirflow.operators import tabular
from weirflow.sources import tables


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_operations_follow_one_another(spark):
    """Readings of gauges as text: cleaned, typed, the latest of each gauge and hour kept, summed up by site."""
    rng = random.Random(11)
    raw, latest = [], {}
    for n in range(200):
        site, hour, level = rng.choice(["North", "south ", "\tEAST"]), rng.randrange(5), rng.choice(["7.25", "0.5", "-3", None])
        raw.append((n, site, str(hour), level))
        latest[site.strip().lower(), hour] = None if level is None else float(level)
    df = spark.createDataFrame(raw, "seq int, site string, hour string, level string").repartition(3)
    clean = registry.run("tabular.normalize", {"columns": ["site"], "lowercase": True}, data=df)
    typed = registry.run("tabular.cast", {"columns": {"hour": "integer", "level": "float"}}, data=clean)
    kept = tabular.dedup(typed, {"subset": ["site", "hour"], "keep": "last"}, ["seq"])
    assert {(r.site, r.hour): r.level for r in kept.collect()} == latest
    ordered = tabular.sort(kept, {"by": [{"column": "level", "descending": True, "nulls_last": True}, {"column": "hour"}]}).collect()
    assert [(r.level is None, -(r.level or 0), r.hour) for r in ordered] == sorted((r.level is None, -(r.level or 0), r.hour) for r in ordered)
    by_site = {r.site: r for r in tabular.statistics(kept, {"columns": ["level"], "group_by": ["site"], "aggregations": ["null_count", "max"]}).collect()}
    for site in ("north", "south", "east"):
        levels = [v for (s, _), v in latest.items() if s == site]
        assert by_site[site].level_null_count == levels.count(None)
        assert by_site[site].level_max == max((v for v in levels if v is not None), default=None)


def test_normalize_trims_all_whitespace_and_only_strings(spark):
    df = spark.createDataFrame([("\t a \n", 1, None), (None, None, "x")], "s string, n int, t string")
    out = tabular.normalize(df, {"fill_nulls": {"s": "none", "n": 7}})
    assert rows(out) == [("a", 1, None), ("none", 7, "x")]
    assert rows(tabular.normalize(df, {"columns": ["t"], "fill_nulls": {"s": "ignored"}})) == [("\t a \n", 1, None), (None, None, "x")]


@pytest.mark.parametrize(
    "value, kind, want",
    [("2", "integer", 2), (" 2 ", "integer", 2), ("2.5", "float", 2.5), ("t", "boolean", True), ("0", "boolean", False), ("2024-02-03", "date", dt.date(2024, 2, 3)), ("2024-02-03 04:05:06", "datetime", dt.datetime(2024, 2, 3, 4, 5, 6)), ("x", "string", "x")],
)
def test_casts(spark, value, kind, want):
    df = spark.createDataFrame([(value,)], "c string")
    for strict in (True, False):
        assert tabular.cast(df, {"columns": {"c": kind}, "strict": strict}).first().c == want


def test_strict_casts_raise_and_lenient_ones_do_not(spark):
    df = spark.createDataFrame([("2.0",), ("x",)], "c string")
    assert rows(tabular.cast(df, {"columns": {"c": "integer"}, "strict": False})) == [(None,), (None,)]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tabular.cast(df, {"columns": {"c": "integer"}}).collect()


@pytest.mark.parametrize("descending, last, want", [(False, False, [None, 1, 2]), (True, False, [None, 2, 1]), (False, True, [1, 2, None]), (True, True, [2, 1, None])])
def test_null_places(spark, descending, last, want):
    df = spark.createDataFrame([(2,), (None,), (1,)], "c int")
    out = tabular.sort(df, {"by": [{"column": "c", "descending": descending, "nulls_last": last}]})
    assert [r.c for r in out.collect()] == want


@pytest.mark.parametrize("keep, want", [("first", {(1, 0), (2, 1), (None, 3)}), ("last", {(1, 2), (2, 1), (None, 4)}), ("none", {(2, 1)})])
def test_dedup(spark, keep, want):
    df = spark.createDataFrame([(1, 0), (2, 1), (1, 2), (None, 3), (None, 4)], "k int, n int").repartition(3)
    assert set(rows(tabular.dedup(df, {"subset": ["k"], "keep": keep}, ["n"]))) == want


def test_dedup_needs_an_order_for_first(spark):
    df = spark.createDataFrame([(1, 0), (1, 0)], "k int, n int")
    assert rows(tabular.dedup(df, {})) == [(1, 0)]
    with pytest.raises(ContractError):
        tabular.dedup(df, {"subset": ["k"]})


def test_joins(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("a", 11), ("c", 12), (None, 13)], "k string, v int")
    got = lambda how: sorted(rows(tabular.join(left, right, {"on": ["k"], "how": how})), key=str)
    assert got("inner") == [("a", 1, 10), ("a", 1, 11)]
    assert got("left") == sorted([("a", 1, 10), ("a", 1, 11), ("b", 2, None), (None, 3, None)], key=str)
    assert got("right") == sorted([("a", 1, 10), ("a", 1, 11), ("c", None, 12), (None, None, 13)], key=str)
    assert got("full") == sorted([("a", 1, "a", 10), ("a", 1, "a", 11), ("b", 2, None, None), (None, 3, None, None), (None, None, "c", 12), (None, None, None, 13)], key=str)
    assert got("semi") == [("a", 1)] and got("anti") == sorted([("b", 2), (None, 3)], key=str)
    assert tabular.join(left, right, {"on": ["k"], "suffix": "_r"}).columns == ["k", "v", "v_r"]


def as_of(left, right, forward, tolerance):
    out = []
    for k, t, x in left:
        ok = [(rt, rv) for rk, rt, rv in right if rk == k and k is not None and t is not None and rt is not None and ((rt >= t) if forward else (rt <= t)) and (tolerance is None or abs(rt - t) <= tolerance)]
        best = (min if forward else max)(ok, default=(None, None))
        out.append((k, t, x, best[1]))
    return sorted(out, key=str)


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 0, 3])
def test_pit_join_equals_brute_force(spark, direction, tolerance):
    rng = random.Random(3)
    key = lambda: rng.choice(["a", "b", None])
    time = lambda: rng.choice([None, *range(30)])
    left = [(key(), time(), i) for i in range(60)]
    right = [(key(), time(), i) for i in range(60)]
    a, b = spark.createDataFrame(left, "k string, t long, x int"), spark.createDataFrame(right, "k string, seen long, v int")
    out = tabular.pit_join(a.repartition(3), b, {"on": ["k"], "left_time": "t", "right_time": "seen", "direction": direction, "tolerance": tolerance})
    assert out.columns == ["k", "t", "x", "v"]
    assert sorted(rows(out), key=str) == as_of(left, right, direction == "forward", tolerance)


def test_pit_join_times_suffix_and_duration(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    a = spark.createDataFrame([(t(1), "x"), (t(9), "y")], "at timestamp_ntz, v string")
    b = spark.createDataFrame([(t(0), "p"), (t(3), "q")], "at timestamp_ntz, v string")
    out = tabular.pit_join(a, b, {"left_time": "at", "right_time": "at", "tolerance": "1h30m"})
    assert sorted((r.v, r.v_right) for r in out.collect()) == [("x", "p"), ("y", None)]
    with pytest.raises(ContractError):
        tabular.pit_join(a, b, {"left_time": "at", "right_time": "at", "tolerance": "soon"})


def test_windows(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", None), ("b", 5)], "k string, v int")
    run = lambda f: {(r.k, r.v): r.n for r in tabular.window(df, {"partition_by": ["k"], "order_by": [{"column": "v", "descending": True, "nulls_last": True}], "function": f, "output_column": "n"}).collect()}
    assert run("rank") == {("a", 1): 1, ("a", 3): 2, ("a", None): None, ("b", 5): 1}
    assert run("dense_rank") == {("a", 1): 1, ("a", 3): 2, ("a", None): None, ("b", 5): 1}
    assert run("row_number")[("a", None)] == 4 and run("row_number")[("a", 1)] == 3


@pytest.mark.parametrize("kind", ["mean", "sum", "min", "max", "std", "count"])
def test_rolling_equals_brute_force(spark, kind):
    import statistics as st

    rng = random.Random(5)
    data = [("a" if i % 3 else "b", i, rng.choice([None, *range(9)])) for i in range(40)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(4)
    out = tabular.rolling(df, {"column": "v", "window_size": 4, "aggregation": kind, "partition_by": ["k"], "order_by": [{"column": "i"}], "min_periods": 2})
    f = {"mean": st.fmean, "sum": sum, "min": min, "max": max, "std": st.stdev, "count": len}[kind]
    for r in out.collect():
        before = [x for x in data if x[0] == r.k and x[1] <= r.i][-4:]
        values = [x[2] for x in before if x[2] is not None]
        assert r.rolling == (pytest.approx(f(values)) if len(values) >= 2 else None)
    assert tabular.rolling_halo_rows({"column": "v", "window_size": 4}) == 3


def test_statistics_edges(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", float("nan"))], "k string, v double")
    got = {r.k: r for r in tabular.statistics(df, {"columns": ["v"], "aggregations": ["count", "null_count", "sum", "min", "max", "std"], "group_by": ["k"]}).collect()}
    assert (got["a"].v_sum, got["a"].v_null_count, got["a"].v_min, got["a"].v_std) == (0, 2, None, None)
    assert (got["b"].v_min, got["b"].v_max) == (1.0, 1.0)
    assert tabular.statistics(df.where("false"), {"columns": ["v"]}).first().v_count == 0


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl", "parquet"])
def test_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    path = registry.run("tabular.format_migration", {"output_format": kind}, data=df, destination=str(tmp_path / f"t.{kind}"))
    assert sorted(rows(tables.read(spark, path).select("a", "b"))) == [(1, "x"), (2, None)]
    assert sorted(rows(tables.read(spark, {"uri": path}).select("a"))) == [(1,), (2,)]


def test_sources(spark):
    assert rows(tables.read(spark, [{"a": 1}])) == [(1,)]
    assert tables.format_of("x", "application/vnd.apache.parquet") == "parquet"
    with pytest.raises(ContractError):
        tables.format_of("x.bin")
    with pytest.raises(ContractError):
        tables.read_ordered(spark, [])


@pytest.mark.parametrize(
    "operation, params",
    [("tabular.sort", {"by": []}), ("tabular.sort", {"by": [{"column": ""}]}), ("tabular.join", {"on": []}), ("tabular.rolling", {"column": "v", "window_size": 2, "min_periods": 3}), ("tabular.cast", {"columns": {"v": "decimal"}}), ("tabular.normalize", {"unknown": 1}), ("tabular.normalize", {"sql": "x"}), ("tabular.normalize", {"fill_nulls": {"v": float("nan")}}), ("tabular.normalize", {"fill_nulls": {"command": 1}}), ("tabular.statistics", {"columns": ["v"], "aggregations": ["mode"]}), ("tabular.unknown", {})],
)
def test_contracts_are_closed(spark, operation, params):
    df = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(ContractError):
        registry.run(operation, params, data=df, right=df if operation == "tabular.join" else None)


def test_only_joins_take_two_tables(spark):
    df = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(ContractError):
        registry.run("tabular.sort", {"by": [{"column": "v"}]}, data=df, right=df)
    with pytest.raises(ContractError):
        registry.run("tabular.join", {"on": ["v"]}, data=df)
    assert registry.run("tabular.join", {"on": ["v"]}, data=df, right=df).count() == 1


def test_json_arrays_are_written_by_partition(spark, tmp_path):
    import json

    df = spark.range(1000).selectExpr("id", "if(id % 7 = 0, NULL, concat('a\\n\"', id)) AS b").repartition(5)
    path = tables.write(df, str(tmp_path / "t.json"), "json")
    parts = [json.loads(f.read_text()) for f in (tmp_path / "t.json").glob("part-*")]
    assert len(parts) == 5 and sum(map(len, parts)) == 1000
    assert sorted(rows(tables.read(spark, path, df.schema)), key=str) == sorted(rows(df), key=str)
    path = tables.write(df.where("id < 0"), str(tmp_path / "e.json"), "json")
    assert tables.read(spark, path, df.schema).count() == 0
