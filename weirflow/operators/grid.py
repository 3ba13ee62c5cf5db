"""Causal time grid over trades and witnesses.

For every grid time and symbol: the causal cutoff, and facts over the trades that were
visible then. The stream of all events in (time, block) order defines the cutoff: the
second-largest block seen so far in the gap segment, null with fewer than two, and null for
good once a block was lower than one before it. Trades are visible from the moment a later
trade of their symbol has not yet pushed them out.

Nothing walks the stream. Events are summarised within grid steps, the summaries are scanned
once per segment, the last trade of each symbol is an as-of window, and visible trades are a
range join on buckets of the lookback.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.contracts import Record, record
from weirflow.functions.scalars import utc_date
from weirflow.operators.replay import FILE, ROW, Profile, RecordError, Trailing, checked


@record
class Grid(Record):
    target_symbols: tuple[str, ...]
    profile: Profile
    symbol_column: str
    block_column: str
    timestamp_column: str
    price_field: str
    notional_field: str
    start_timestamp_ms: int
    end_timestamp_ms: int
    step_ms: int
    emit_start_ms: int
    emit_end_ms: int
    overlap_ms: int
    as_of_measurement_field: str
    as_of_offsets_ms: tuple[int, ...] = (0, 5000)
    trailing_windows: tuple[Trailing, ...] = ()
    tie_break_columns: tuple[str, ...] = ("timestamp_ms",)
    hard_gap_missing_dates: tuple[str, ...] = ()
    witness_block_column: str = "block"
    witness_timestamp_column: str = "timestamp_ms"
    max_output_rows: int = 500_000

    def check(self):
        self._set("profile", Profile.of(self.profile))
        self._names("target_symbols", 1)
        self._names("tie_break_columns", 1)
        self._records("trailing_windows", Trailing)
        self._set("as_of_offsets_ms", tuple(self.as_of_offsets_ms))
        self._set("hard_gap_missing_dates", tuple(sorted(set(self.hard_gap_missing_dates))))
        for d in self.hard_gap_missing_dates:
            date.fromisoformat(d)
        self._whole("step_ms", 1)
        self._whole("overlap_ms", 0)
        self._whole("max_output_rows", 1, 10_000_000)
        self._need(self.emit_end_ms >= self.emit_start_ms, "emit_end_ms must not precede emit_start_ms")
        self._need(self.overlap_ms >= self.lookback, "overlap_ms is shorter than the lookback")
        self._need(self.grid_size * len(self.target_symbols) <= self.max_output_rows, "grid output row count exceeds limit")

    @property
    def lookback(self) -> int:
        return max((*self.as_of_offsets_ms, *(w.trailing_width_ms for w in self.trailing_windows)), default=0)

    @property
    def grid_bounds(self) -> tuple[int, int]:
        """First and last step number inside both the grid and the partition; last < first if none."""
        start, end = max(self.start_timestamp_ms, self.emit_start_ms), min(self.end_timestamp_ms, self.emit_end_ms)
        return -(-(start - self.start_timestamp_ms) // self.step_ms), (end - self.start_timestamp_ms) // self.step_ms

    @property
    def grid_size(self) -> int:
        lo, hi = self.grid_bounds
        return max(0, hi - lo + 1)

    def field(self, name: str) -> Column | None:
        """What a measurement name means inside the grid; other names mean nothing."""
        if name in self.tie_break_columns:
            return F.col(f"tie.{name}").cast("double")
        if name in ("notional", "notional_usd"):
            return F.col("notional")
        return F.col("price") if name in ("price", self.as_of_measurement_field) else None


#: Columns of the two tables that carry a partition's end into the next.
FRONTIER_SCHEMA = "segment int, top bigint, second bigint, broken boolean"


@dataclass(frozen=True)
class Carry:
    """``frontiers`` as in FRONTIER_SCHEMA, ``trades`` as ``collapse`` returns them."""

    frontiers: DataFrame
    trades: DataFrame


def segment_of(ms: Column, missing: tuple[str, ...]) -> Column:
    """Missing dates before the date; a time on a missing date raises."""
    if not missing:
        return F.lit(0)
    day = utc_date(ms)
    dates = F.array(*[F.lit(d) for d in missing])
    fail = F.raise_error(F.lit("a time lies on a missing date")).cast("int")
    return F.when(F.array_contains(dates, day), fail).otherwise(F.size(F.filter(dates, lambda d: d < day)))


def collapse(trades: DataFrame, p: Grid) -> DataFrame:
    """One trade for each identity: the greatest tie-break tuple, the earliest of equals.

    Core fields of an identity must agree over all its rows, wherever they stand.
    """
    marked = checked(trades, p.profile, (p.symbol_column, p.block_column, p.timestamp_column, p.price_field, p.notional_field, *p.tie_break_columns))
    tie = F.struct(*[F.col(c).alias(c) for c in p.tie_break_columns])
    ts, block = F.col(p.timestamp_column).try_cast("bigint"), F.col(p.block_column).try_cast("bigint")
    core = F.struct(*p.profile.measurement_core_fields)
    value = F.struct(
        F.col(p.symbol_column).cast("string").alias("symbol"), ts.alias("time"), block.alias("block"),
        F.col(p.price_field).cast("double").alias("price"), F.col(p.notional_field).cast("double").alias("notional"),
        tie.alias("tie"), F.col(FILE).cast("bigint").alias("f"), F.col(ROW).cast("bigint").alias("r"),
    )
    best = F.struct(tie.alias("tie"), (-ts).alias("t"), (-block).alias("b"), (-F.col(FILE)).alias("f"), (-F.col(ROW)).alias("r"))
    one = marked.where(~F.col("_witness")).groupBy("_identity").agg(
        F.max_by(value, best).alias("v"), F.min(core).alias("low"), F.max(core).alias("high")
    )
    agreed = F.when(F.col("low") == F.col("high"), F.col("v")).otherwise(
        F.raise_error(F.lit("measurement core fields disagree")).cast(one.schema["v"].dataType)
    )
    return one.select(agreed.alias("v")).select("v.*")


def _events(trades: DataFrame, witnesses: DataFrame | None, p: Grid) -> DataFrame:
    """(segment, time, block) of the whole stream up to the end of the partition."""
    parts = [trades.where(F.col("f") >= 0).select("time", "block")]  # carried trades were seen before
    if witnesses is not None:
        parts.append(witnesses.select(F.col(p.witness_timestamp_column).cast("bigint").alias("time"), F.col(p.witness_block_column).cast("bigint").alias("block")))
    stream = reduce(DataFrame.union, parts).where(F.col("time") <= p.emit_end_ms)
    return stream.select(segment_of(F.col("time"), p.hard_gap_missing_dates).alias("segment"), "time", "block")


def _summaries(events: DataFrame, carry: DataFrame | None, p: Grid) -> DataFrame:
    """Per segment and grid step, the frontier after the step's events: top, second, broken.

    Step k holds the events after grid time k - 1 up to grid time k, inclusive.
    """
    step = F.ceil((F.col("time") - p.start_timestamp_ms) / p.step_ms).cast("bigint")
    inside = Window.partitionBy("segment", "step").orderBy("time", "block")
    before = F.lag("block").over(inside)
    each = events.withColumn("step", step).withColumn("before", before)
    summed = each.groupBy("segment", "step").agg(
        F.max("block").alias("top"), F.min("block").alias("low"),
        F.max(F.when(F.col("before") < F.col("block"), F.col("before"))).alias("second"),
        F.max(F.coalesce(F.col("block") < F.col("before"), F.lit(False))).alias("broken"),
    )
    if carry is not None:
        first = carry.select(
            "segment", F.lit(-(2**62)).cast("bigint").alias("step"), "top", F.col("top").alias("low"), "second", "broken"
        )
        summed = summed.unionByName(first)
    run = Window.partitionBy("segment").orderBy("step")
    so_far = run.rowsBetween(Window.unboundedPreceding, 0)
    prior = F.max("top").over(run.rowsBetween(Window.unboundedPreceding, -1))
    joined = summed.withColumn("prior", prior)
    crossed = F.col("broken") | F.coalesce(F.col("low") < F.col("prior"), F.lit(False))
    passed = F.when(F.col("prior") < F.col("top"), F.col("prior"))
    return joined.withColumn("passed", passed).withColumn("crossed", crossed).select(
        "segment", "step", F.max("top").over(so_far).alias("top"),
        F.max(F.greatest("second", "passed")).over(so_far).alias("second"), F.max("crossed").over(so_far).alias("broken"),
    )


def grid_times(trades: DataFrame, p: Grid) -> DataFrame:
    """(step, grid_timestamp_ms, segment)."""
    lo, hi = p.grid_bounds
    time = (F.col("id") * p.step_ms + p.start_timestamp_ms).cast("bigint")
    steps = trades.sparkSession.range(lo, max(lo, hi + 1))
    return steps.select(F.col("id").alias("step"), time.alias("grid_timestamp_ms")).withColumn(
        "segment", segment_of(F.col("grid_timestamp_ms"), p.hard_gap_missing_dates)
    )


def cutoffs(trades: DataFrame, witnesses: DataFrame | None, p: Grid, carry: DataFrame | None = None) -> DataFrame:
    """(grid_timestamp_ms, causal_cutoff_block) for every grid time."""
    frontier = _summaries(_events(trades, witnesses, p), carry, p)
    state = F.struct("top", "second", "broken")
    seen = frontier.select("segment", "step", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("grid_timestamp_ms"), state.alias("s"))
    asked = grid_times(trades, p).select("segment", "step", F.lit(1).alias("side"), "grid_timestamp_ms", F.lit(None).cast(seen.schema["s"].dataType).alias("s"))
    w = Window.partitionBy("segment").orderBy("step", "side").rowsBetween(Window.unboundedPreceding, 0)
    held = seen.unionByName(asked).withColumn("at", F.last("s", ignorenulls=True).over(w)).where("side = 1")
    return held.select("grid_timestamp_ms", F.when(~F.col("at.broken"), F.col("at.second")).alias("causal_cutoff_block"))


def _stream_order() -> Column:
    return F.struct("time", "block", "f", "r")


def _with_last(points: DataFrame, trades: DataFrame) -> DataFrame:
    """To each (symbol, grid_timestamp_ms) the stream place of its symbol's last trade by then."""
    place = _stream_order()
    a = trades.select("symbol", F.col("time").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("grid_timestamp_ms"), place.alias("place"))
    b = points.select("symbol", F.col("grid_timestamp_ms").alias("t"), F.lit(1).alias("side"), "grid_timestamp_ms", F.lit(None).cast(a.schema["place"].dataType).alias("place"))
    w = Window.partitionBy("symbol").orderBy("t", "side", "place").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("last", F.last("place", ignorenulls=True).over(w)).where("side = 1").select("symbol", "grid_timestamp_ms", "last")


def _visible(points: DataFrame, trades: DataFrame, p: Grid, *keep: str) -> DataFrame:
    """Rows (point, trade) of the trades visible at each point."""
    first = p.emit_start_ms - p.lookback
    width = max(p.lookback, 1)
    held = _with_last(points, trades).where("last IS NOT NULL")
    lo = F.greatest(F.lit(first), F.col("last.time") - p.lookback)
    bucket = lambda c: F.floor(c / width).cast("bigint")
    # the last trade is visible however old it is
    ranged = held.withColumn("lo", F.least(lo, F.col("last.time"))).withColumn("b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("last.time")))))
    t = trades.withColumn("b", bucket(F.col("time")))
    joined = ranged.join(t, ["symbol", "b"])
    seen = (F.col("time") >= F.greatest(F.lit(first), F.col("last.time") - p.lookback)) | (_stream_order() == F.col("last"))
    return joined.where((F.col("time") <= F.col("last.time")) & seen)


def causal_grid(
    trades: DataFrame, params, witnesses: DataFrame | None = None, carry: Carry | None = None
) -> DataFrame:
    """(symbol, grid_timestamp_ms, causal_cutoff_block, facts) for every grid time and symbol.

    ``facts`` is an array of (fact_id, value): as-of by the greatest tie-break tuple, then sum
    and count of each trailing window, open at its start; all null without a cutoff. Inputs
    must begin where the carried partition ended.
    """
    p = Grid.of(params)
    kept = collapse(trades, p)
    wanted = kept.where(F.col("symbol").isin(*p.target_symbols))
    if carry is not None:
        wanted = wanted.unionByName(carry.trades.where(F.col("symbol").isin(*p.target_symbols)))
    wanted = wanted.where(F.col("time") <= p.emit_end_ms)
    cut = cutoffs(kept, witnesses, p, carry.frontiers if carry else None)
    points = cut.select("grid_timestamp_ms", "causal_cutoff_block", F.explode(F.array(*[F.lit(s) for s in p.target_symbols])).alias("symbol"))
    key = ["symbol", "grid_timestamp_ms"]
    causal = _visible(points.select(*key), wanted, p).join(points.where("causal_cutoff_block IS NOT NULL"), key).where("block <= causal_cutoff_block")
    d = F.col("grid_timestamp_ms")
    best = F.struct("tie", (-F.col("time")).alias("t"), (-F.col("block")).alias("b"), (-F.col("f")).alias("f"), (-F.col("r")).alias("r"))
    facts: dict[str, Column] = {}
    empty: dict[str, Column] = {}
    for offset in p.as_of_offsets_ms:
        facts[f"as_of.{offset}"] = F.max_by(p.field(p.as_of_measurement_field), F.when(F.col("time") <= d - offset, best))
        empty[f"as_of.{offset}"] = F.lit(None).cast("double")
    for w in p.trailing_windows:
        m = p.field(w.measurement_field)
        m = F.lit(None).cast("double") if m is None else F.when(F.col("time") > d - w.trailing_width_ms, m)
        facts[f"{w.fact_id}.sum"] = F.sum(m)
        facts[f"{w.fact_id}.count"] = F.count(m).cast("double")
        empty[f"{w.fact_id}.sum"] = empty[f"{w.fact_id}.count"] = F.lit(0.0)
    made = causal.groupBy(*key).agg(*[c.alias(n) for n, c in facts.items()])
    known = F.col("causal_cutoff_block").isNotNull()
    listed = F.array(*[
        F.struct(F.lit(n).alias("fact_id"), F.when(known, F.coalesce(F.col(f"`{n}`"), empty[n])).alias("value")) for n in facts
    ])
    return points.join(made, key, "left").select(*key, "causal_cutoff_block", listed.alias("facts"))


def carry_out(trades: DataFrame, params, witnesses: DataFrame | None = None, carry: Carry | None = None) -> Carry:
    """What the next partition needs: each segment's frontier, and trades still visible at the end."""
    p = Grid.of(params)
    kept = collapse(trades, p)
    summed = _summaries(_events(kept, witnesses, p), carry.frontiers if carry else None, p)
    end = summed.groupBy("segment").agg(F.max_by(F.struct("top", "second", "broken"), "step").alias("s")).select("segment", "s.*")
    wanted = kept if carry is None else kept.unionByName(carry.trades)
    wanted = wanted.where(F.col("symbol").isin(*p.target_symbols) & (F.col("time") <= p.emit_end_ms))
    point = wanted.select("symbol").distinct().select("symbol", F.lit(p.emit_end_ms).cast("bigint").alias("grid_timestamp_ms"))
    late = _visible(point, wanted, p).where(F.col("time") >= p.emit_end_ms - p.overlap_ms)
    # a negative file place marks what was carried, in the order it had
    aged = F.col("f") - 1_000_000
    return Carry(end, late.select("symbol", "time", "block", "price", "notional", "tie", aged.alias("f"), "r"))


def require_after(trades: DataFrame, params, carry: Carry) -> None:
    """Raise if an input trade is not later than every carried one; a repeat would count twice."""
    p = Grid.of(params)
    last = carry.trades.agg(F.max("time").alias("t")).first()["t"]
    if last is not None and not trades.where(F.col(p.timestamp_column) <= last).isEmpty():
        raise RecordError("inputs must begin after the carried partition")
