"""Tabular operations: cleaning, casting, ordering, joining, ranking and statistics.

Row order is data in some of these. A DataFrame has none, so operations that depend on it
take the columns of ``order``; files read with ``sources.tables.read_ordered`` carry theirs.

Casts follow Spark: text to whole numbers needs a whole number (spaces around it are fine),
decimals to whole numbers drop the fraction, and text to boolean takes t/true/y/yes/1 and
their opposites. Strict casts raise on the first value that cannot be converted.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.contracts import ContractError, Record, record
from weirflow.functions.scalars import ordered, strip

#: Target types of casts: fixed values.
CAST_TYPES = {
    "string": "string",
    "integer": "bigint",
    "float": "double",
    "boolean": "boolean",
    "date": "date",
    "datetime": "timestamp_ntz",
}


@record
class SortKey(Record):
    column: str
    descending: bool = False
    nulls_last: bool = False

    def check(self):
        self._need(isinstance(self.column, str) and bool(self.column), "column must be a name")

    def expression(self) -> Column:
        return ordered(self.column, self.descending, self.nulls_last)


@record
class Normalize(Record):
    columns: tuple[str, ...] | None = None
    trim_strings: bool = True
    lowercase: bool = False
    fill_nulls: Any = ()

    def check(self):
        if self.columns is not None:
            self._names("columns")
        self._set("fill_nulls", dict(self.fill_nulls or {}))


@record
class Cast(Record):
    columns: Any
    strict: bool = True

    def check(self):
        self._need(isinstance(self.columns, dict), "columns must map names to types")
        self._need(set(self.columns.values()) <= set(CAST_TYPES), f"types must be of {', '.join(CAST_TYPES)}")


@record
class Sort(Record):
    by: tuple[SortKey, ...]

    def check(self):
        self._records("by", SortKey, 1)


@record
class Dedup(Record):
    subset: tuple[str, ...] | None = None
    keep: str = "first"
    maintain_order: bool = True

    def check(self):
        if self.subset is not None:
            self._names("subset")
        self._one_of("keep", "first", "last", "none")


@record
class Join(Record):
    on: tuple[str, ...]
    how: str = "inner"
    suffix: str = "_right"

    def check(self):
        self._names("on", 1)
        self._one_of("how", "inner", "left", "right", "full", "semi", "anti")


@record
class PitJoin(Record):
    left_time: str
    right_time: str
    on: tuple[str, ...] = ()
    direction: str = "backward"
    tolerance: Any = None
    suffix: str = "_right"

    def check(self):
        self._names("on")
        self._need(bool(self.left_time) and bool(self.right_time), "times must be names")
        self._one_of("direction", "backward", "forward")
        self._need(not isinstance(self.tolerance, bool), "tolerance must be a number or a duration")


@record
class WindowFunction(Record):
    order_by: tuple[SortKey, ...]
    partition_by: tuple[str, ...] = ()
    function: str = "row_number"
    output_column: str = "window_value"

    def check(self):
        self._names("partition_by")
        self._records("order_by", SortKey, 1)
        self._one_of("function", "row_number", "rank", "dense_rank")
        self._need(bool(self.output_column), "output_column must be a name")


@record
class Rolling(Record):
    column: str
    window_size: int
    aggregation: str = "mean"
    output_column: str = "rolling"
    partition_by: tuple[str, ...] = ()
    order_by: tuple[SortKey, ...] = ()
    min_periods: int = 1

    def check(self):
        self._whole("window_size", 1)
        self._whole("min_periods", 1)
        self._need(self.min_periods <= self.window_size, "min_periods cannot exceed window_size")
        self._one_of("aggregation", "mean", "sum", "min", "max", "std", "count")
        self._names("partition_by")
        self._records("order_by", SortKey)


@record
class Statistics(Record):
    columns: tuple[str, ...]
    aggregations: tuple[str, ...] = ("count", "mean")
    group_by: tuple[str, ...] = ()

    def check(self):
        self._names("columns", 1)
        self._names("aggregations")
        self._names("group_by")
        allowed = {"count", "null_count", "mean", "sum", "min", "max", "std", "median"}
        self._need(set(self.aggregations) <= allowed, f"aggregations must be of {', '.join(sorted(allowed))}")


@record
class FormatMigration(Record):
    output_format: str

    def check(self):
        self._one_of("output_format", "csv", "json", "jsonl", "parquet")


def _need_columns(df: DataFrame, names: Sequence[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ContractError(f"no such column: {absent[0]}")


def normalize(df: DataFrame, params) -> DataFrame:
    """Trim and lower-case string columns, then fill nulls of the named columns."""
    p = Normalize.of(params)
    names = p.columns if p.columns is not None else tuple(df.columns)
    _need_columns(df, names)
    new = {}
    for name in names:
        c = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, T.StringType):
            c = strip(c) if p.trim_strings else c
            c = F.lower(c) if p.lowercase else c
        new[name] = F.coalesce(c, F.lit(p.fill_nulls[name])) if name in p.fill_nulls else c
    return df.withColumns(new)


def cast(df: DataFrame, params) -> DataFrame:
    """Cast columns; strict raises on what cannot be converted, otherwise it becomes null."""
    p = Cast.of(params)
    _need_columns(df, tuple(p.columns))
    convert = lambda c, t: F.col(c).cast(t) if p.strict else F.col(c).try_cast(t)
    return df.withColumns({name: convert(name, CAST_TYPES[kind]) for name, kind in p.columns.items()})


def sort(df: DataFrame, params) -> DataFrame:
    p = Sort.of(params)
    return df.orderBy(*[k.expression() for k in p.by])


def dedup(df: DataFrame, params, order: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the first or last in ``order``, or only keys that occur once.

    Without ``order`` first and last are told apart by nothing, so they are refused unless
    whole rows are the key.
    """
    p = Dedup.of(params)
    key = p.subset or tuple(c for c in df.columns if c not in order)
    _need_columns(df, key)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]
    if p.keep == "none":
        # a key that repeats within a task is one row before the shuffle
        counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(row).alias("_row"))
        return counted.where("_n = 1").select("_row.*")
    if not order:
        if set(key) != set(df.columns):
            raise ContractError("keeping the first or last row needs an order")
        return df.dropDuplicates()
    _need_columns(df, order)
    # an extreme per key is kept before the shuffle, where a window would move every row
    place = F.struct(*[F.col(c) for c in order])
    pick = F.min_by(row, place) if p.keep == "first" else F.max_by(row, place)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def _apart(left: DataFrame, right: DataFrame, on: Sequence[str], suffix: str, drop: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """The right side with colliding columns renamed, and its columns beside the keys."""
    rename = {c: c + suffix for c in right.columns if c not in on and c in left.columns}
    kept = [rename.get(c, c) for c in right.columns if c not in on and c not in drop]
    return right.withColumnsRenamed(rename), kept


def join(left: DataFrame, right: DataFrame, params) -> DataFrame:
    """Equi-join: keys, then left columns, then right columns; a full join keeps both keys."""
    p = Join.of(params)
    _need_columns(left, p.on)
    _need_columns(right, p.on)
    if p.how in ("semi", "anti"):
        return left.join(right.select(*p.on), list(p.on), f"left_{p.how}").select(*left.columns)
    other, extra = _apart(left, right, p.on, p.suffix)
    if p.how == "full":
        keyed = other.withColumnsRenamed({k: k + p.suffix for k in p.on})
        same = [left[k] == keyed[k + p.suffix] for k in p.on]
        condition = same[0]
        for more in same[1:]:
            condition = condition & more
        return left.join(keyed, condition, "full_outer").select(*left.columns, *[k + p.suffix for k in p.on], *extra)
    how = {"inner": "inner", "left": "left_outer", "right": "right_outer"}[p.how]
    return left.join(other, list(p.on), how).select(*left.columns, *extra)


def _distance(a: Column, b: Column, kind: T.DataType) -> Column:
    """Distance of two times: microseconds for timestamps, days for dates, else the difference."""
    if isinstance(kind, T.DateType):
        return F.abs(F.datediff(a, b))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        return F.abs(micros(a) - micros(b))
    return F.abs(a - b)


#: Durations as text, in microseconds: fixed values.
UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 604_800_000_000}


def duration_micros(text: str) -> int:
    import re

    if not re.fullmatch(r"(\d+(us|ms|[smhdw]))+", text):
        raise ContractError("a duration is whole numbers with units, as in 1h30m")
    return sum(int(n) * UNITS[u] for n, u in re.findall(r"(\d+)(us|ms|[smhdw])", text))


def pit_join(left: DataFrame, right: DataFrame, params) -> DataFrame:
    """As-of join: to each left row the nearest right row at or before (at or after) its time.

    Both sides are stacked, and one window over key and time carries the nearest right row to
    each left row: one shuffle and a linear pass, where a range join would expand every
    earlier match. Of right rows with one time, the last comes first backward and the first
    forward, in order of their other columns. Rows without a match, with a null time or a null
    key stay with nulls.
    """
    p = PitJoin.of(params)
    _need_columns(left, (*p.on, p.left_time))
    _need_columns(right, (*p.on, p.right_time))
    other, extra = _apart(left, right, p.on, p.suffix, drop=(p.right_time,))
    time_right = p.right_time + p.suffix if p.right_time in left.columns and p.right_time not in p.on else p.right_time
    payload = F.struct(F.col(time_right).alias("_time"), *[F.col(f"`{c}`") for c in extra])
    keys = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(p.on)]
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    usable = F.col(time_right).isNotNull()
    for c in p.on:
        usable = usable & F.col(f"`{c}`").isNotNull()
    a = left.select(*keys, F.col(p.left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"))
    b = other.where(usable).select(*keys, F.col(time_right).alias("_t"), F.lit(0).alias("_side"), payload.alias("_match"))
    stacked = a.unionByName(b, allowMissingColumns=True)
    by = [f"_k{i}" for i in range(len(p.on))]
    # backward: a match stands before its left row; forward: after it, so sides swap
    tie = F.col("_match")
    if p.direction == "backward":
        w = Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), F.col("_side").asc(), tie.asc()).rowsBetween(Window.unboundedPreceding, 0)
    else:
        w = Window.partitionBy(*by).orderBy(F.col("_t").desc_nulls_first(), F.col("_side").asc(), tie.desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = stacked.withColumn("_found", F.last("_match", ignorenulls=True).over(w)).where("_side = 1")
    near = F.col("_found").isNotNull() & F.col("_t").isNotNull()
    if p.tolerance is not None:
        limit = duration_micros(p.tolerance) if isinstance(p.tolerance, str) else p.tolerance
        near = near & (_distance(F.col("_t"), F.col("_found._time"), left.schema[p.left_time].dataType) <= F.lit(limit))
    match = F.when(near, F.col("_found"))
    return found.withColumn("_m", match).select("_row.*", *[F.col("_m").getField(c).alias(c) for c in extra])


def window(df: DataFrame, params, order: Sequence[str] = ()) -> DataFrame:
    """Row numbers by the whole order; ranks by its first key alone, ascending, null for null."""
    p = WindowFunction.of(params)
    _need_columns(df, (*p.partition_by, *[k.column for k in p.order_by]))
    by = Window.partitionBy(*p.partition_by)
    if p.function == "row_number":
        value = F.row_number().over(by.orderBy(*[k.expression() for k in p.order_by], *order))
    else:
        first = F.col(p.order_by[0].column)
        ranked = getattr(F, p.function)().over(by.orderBy(first.asc_nulls_last()))
        value = F.when(first.isNotNull(), ranked)
    return df.withColumn(p.output_column, value.cast("bigint"))


def rolling(df: DataFrame, params, order: Sequence[str] = ()) -> DataFrame:
    """Aggregate over the last ``window_size`` rows; null under ``min_periods`` values."""
    p = Rolling.of(params)
    _need_columns(df, (p.column, *p.partition_by))
    keys = [k.expression() for k in p.order_by] + [F.col(c).asc() for c in order]
    if not keys:
        raise ContractError("a rolling window needs an order")
    w = Window.partitionBy(*p.partition_by).orderBy(*keys).rowsBetween(1 - p.window_size, 0)
    c = F.col(p.column)
    made = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}[p.aggregation](c)
    return df.withColumn(p.output_column, F.when(F.count(c).over(w) >= p.min_periods, made.over(w)))


def rolling_halo_rows(params) -> int:
    """Rows that a shard of a rolling window needs from before it."""
    return Rolling.of(params).window_size - 1


def statistics(df: DataFrame, params) -> DataFrame:
    """Columns ``{column}_{aggregation}``, in one pass; one row, or one for each group."""
    p = Statistics.of(params)
    _need_columns(df, (*p.columns, *p.group_by))

    def one(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("min", "max") and isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        return {
            "count": lambda: F.count(c),
            "null_count": lambda: F.count_if(c.isNull()),
            "mean": lambda: F.avg(c),
            "sum": lambda: F.coalesce(F.sum(c), F.lit(0)),
            "min": lambda: F.min(c),
            "max": lambda: F.max(c),
            "std": lambda: F.stddev_samp(c),
            "median": lambda: F.median(c),
        }[kind]().alias(f"{name}_{kind}")

    return df.groupBy(*p.group_by).agg(*[one(c, a) for c in p.columns for a in p.aggregations])
