import random

import pytest

from weirflow.contracts import ContractError
from weirflow.operators import grid
from weirflow.operators.replay import RecordError

DAY = 86_400_000
PROFILE = {"identity_source_column": "identity", "identity_normalized_column": "norm", "measurement_core_fields": ["price"]}
BASE = {
    "target_symbols": ["x", "y"], "profile": PROFILE, "symbol_column": "symbol", "block_column": "block", "timestamp_column": "timestamp_ms", "price_field": "price", "notional_field": "notional",
    "start_timestamp_ms": 100, "end_timestamp_ms": 200, "step_ms": 10, "emit_start_ms": 100, "emit_end_ms": 200, "overlap_ms": 30, "as_of_measurement_field": "price", "as_of_offsets_ms": [0, 10],
    "trailing_windows": [{"fact_id": "w", "measurement_field": "notional", "trailing_width_ms": 20}], "tie_break_columns": ["timestamp_ms", "seq"],
}


def trades(spark, rows):
    """rows: (identity, symbol, block, ts, price, notional, seq)"""
    return spark.createDataFrame([(0, i, r[0], str(r[0]), *r[1:]) for i, r in enumerate(rows)], "_file int, _row long, identity long, norm string, symbol string, block long, timestamp_ms long, price double, notional double, seq long").repartition(3)


def witnesses(spark, rows):
    return spark.createDataFrame(rows, "block long, timestamp_ms long")


def walk(rows, seen, p, missing=()):
    """The stream, one event at a time: frontier per segment, and a queue for each symbol."""
    best = {}
    for i, r in enumerate(rows):
        if r[0] not in best or (r[3], r[6]) > (best[r[0]][3], best[r[0]][6]):
            best[r[0]] = r
    look = max(*p["as_of_offsets_ms"], *(w["trailing_width_ms"] for w in p["trailing_windows"]))
    stream = sorted([(r[3], r[2], 0, r) for r in best.values()] + [(t, b, -1, None) for b, t in seen], key=lambda e: e[:3])
    first = p["emit_start_ms"] - look
    times = [t for t in range(p["start_timestamp_ms"], p["end_timestamp_ms"] + 1, p["step_ms"]) if p["emit_start_ms"] <= t <= p["emit_end_ms"]]
    blocks, broken, queues, out = [], False, {s: [] for s in p["target_symbols"]}, []

    def emit(d):
        distinct = sorted(set(blocks))
        cut = distinct[-2] if len(distinct) > 1 and not broken else None
        for s, q in queues.items():
            facts = {}
            ok = [r for r in q if cut is not None and r[2] <= cut and r[3] <= d]
            for o in p["as_of_offsets_ms"]:
                c = [r for r in ok if r[3] <= d - o]
                facts[f"as_of.{o}"] = max(c, key=lambda r: (r[3], r[6]))[4] if c else None
            for w in p["trailing_windows"]:
                c = [r[5] for r in ok if d - w["trailing_width_ms"] < r[3] <= d]
                facts[w["fact_id"] + ".sum"] = None if cut is None else float(sum(c))
                facts[w["fact_id"] + ".count"] = None if cut is None else float(len(c))
            out.append((s, d, cut, facts))

    todo = list(times)
    for t, b, _, r in stream:
        if t > p["emit_end_ms"]:
            break
        while todo and todo[0] < t and t >= first:
            emit(todo.pop(0))
        broken = broken or (bool(blocks) and b < blocks[-1])
        blocks.append(b)
        if r and r[1] in queues:
            mark = first if t < first else max(first, t - look)
            queues[r[1]] = [x for x in queues[r[1]] if x[3] >= mark] + [r]
    for d in todo:
        emit(d)
    return sorted(out, key=lambda x: x[:2])


def rows_of(df):
    return sorted(((r.symbol, r.grid_timestamp_ms, r.causal_cutoff_block, {f.fact_id: f.value for f in r.facts}) for r in df.collect()), key=lambda x: x[:2])


def sample(seed, monotone=True):
    rng = random.Random(seed)
    rows, seen, t, block = [], [], 20, 1
    for i in range(1, 70):
        t += rng.choice([0, 1, 2, 3, 7])
        block += rng.choice([0, 0, 1, 2])
        b = block if monotone or rng.random() > 0.05 else max(1, block - 3)
        if rng.random() < 0.2:
            seen.append((b, t))
        else:
            rows.append((i, rng.choice("xyz"), b, t, float(i), float(rng.randrange(9)), rng.randrange(5) * 100 + i))
    rows += [(rows[0][0], *rows[0][1:6], 999)]
    return rows, seen


@pytest.mark.parametrize("seed", range(6))
def test_grid_equals_walk(spark, seed):
    rows, seen = sample(seed, seed % 3 > 0)
    got = rows_of(grid.causal_grid(trades(spark, rows), BASE, witnesses(spark, seen)))
    assert got == walk(rows, seen, BASE)
    if seed % 3:
        assert any(f["as_of.0"] is not None for _, _, _, f in got)


def test_cutoff_needs_two_blocks(spark):
    got = rows_of(grid.causal_grid(trades(spark, [(1, "x", 7, 95, 1.0, 1.0, 0)]), BASE))
    assert {(c, f["as_of.0"], f["w.sum"]) for _, _, c, f in got} == {(None, None, None)}
    got = rows_of(grid.causal_grid(trades(spark, [(1, "x", 7, 95, 1.0, 1.0, 0), (2, "x", 9, 100, 2.0, 1.0, 0)]), BASE))
    assert got[0][2] == 7 and got[0][3]["as_of.0"] == 1.0


def test_later_trades_push_out_earlier_ones(spark):
    p = BASE | {"as_of_offsets_ms": [10], "trailing_windows": [], "overlap_ms": 10, "target_symbols": ["x"]}
    seen = witnesses(spark, [(50, 99), (60, 100)])
    got = lambda rows: rows_of(grid.causal_grid(trades(spark, rows), p, seen))[0][3]["as_of.10"]
    assert got([(1, "x", 1, 90, 5.0, 1.0, 0)]) == 5.0
    assert got([(1, "x", 1, 85, 5.0, 1.0, 0), (2, "x", 2, 99, 6.0, 1.0, 0)]) is None


def test_carry_splits_a_run(spark):
    rows, seen = sample(11)
    whole = walk(rows, seen, BASE)
    first = BASE | {"emit_end_ms": 150}
    second = BASE | {"emit_start_ms": 151}
    early, late = [r for r in rows if r[3] <= 150], [r for r in rows if r[3] > 150]
    w1, w2 = witnesses(spark, [s for s in seen if s[1] <= 150] or [(1, 0)]), witnesses(spark, [s for s in seen if s[1] > 150] or [(10**6, 10**6)])
    carry = grid.carry_out(trades(spark, early), first, w1)
    grid.require_after(trades(spark, late), second, carry)
    got = rows_of(grid.causal_grid(trades(spark, early), first, w1)) + rows_of(grid.causal_grid(trades(spark, late), second, w2, carry))
    assert sorted(got, key=lambda x: x[:2]) == whole
    assert any(f["w.count"] for _, d, _, f in got if d > 150)
    with pytest.raises(RecordError):
        grid.require_after(trades(spark, early), second, carry)


def test_segments_start_anew_after_a_gap(spark):
    p = BASE | {"start_timestamp_ms": 0, "end_timestamp_ms": 3 * DAY, "step_ms": 2 * DAY + DAY // 2, "emit_start_ms": 0, "emit_end_ms": 3 * DAY, "hard_gap_missing_dates": ["1970-01-02"], "target_symbols": ["x"]}
    rows = [(1, "x", 5, 10, 1.0, 1.0, 0), (2, "x", 6, 20, 1.0, 1.0, 0), (3, "x", 1, 2 * DAY + 5, 1.0, 1.0, 0), (4, "x", 2, 2 * DAY + 6, 1.0, 1.0, 0)]
    assert [r[2] for r in rows_of(grid.causal_grid(trades(spark, rows), p))] == [None, 1]
    with pytest.raises(Exception, match="missing date"):
        grid.causal_grid(trades(spark, [*rows, (5, "x", 9, DAY + 5, 1.0, 1.0, 0)]), p).collect()


def test_contract(spark):
    for bad in ({"overlap_ms": 5}, {"max_output_rows": 3}, {"emit_end_ms": 1}, {"step_ms": 0}, {"target_symbols": []}):
        with pytest.raises(ContractError):
            grid.Grid.of(BASE | bad)
    with pytest.raises(Exception, match="core"):
        grid.causal_grid(trades(spark, [(1, "x", 1, 1, 1.0, 1.0, 0), (1, "x", 1, 1, 2.0, 1.0, 0)]), BASE).collect()
