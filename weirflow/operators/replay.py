"""Event records: JSON scalars, structural checks, identity groups, and window facts.

Inputs are ordered: ``sources.tables.read_ordered`` gives each row its file's place and its
place in the file, and rows of equal identity must follow one another in that order. Checks
that must fail the job are counted in one pass and raised before any result is returned.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.contracts import ContractError, Record, record
from weirflow.functions.scalars import splitmix64

FILE, ROW = "_file", "_row"

#: Rows of one file that are looked at together; only their ends meet those of the next.
BLOCK_ROWS = 1 << 20

MAX_PROJECTIONS, MAX_PATH = 16, 8


class RecordError(ValueError):
    """Event records break a structural rule."""


@record
class JsonScalar(Record):
    source_column: str
    key_path: tuple[str, ...]
    scalar_type: str
    output_column: str

    def check(self):
        self._names("key_path", 1)
        self._need(len(self.key_path) <= MAX_PATH, "key_path is too deep")
        self._one_of("scalar_type", "integer", "string")
        self._need(bool(self.source_column), "source_column must be a name")
        self._need(self.output_column.isidentifier() and not self.output_column.startswith("_"), "output_column must be a plain name")


@record
class Sentinel(Record):
    identity_equals: int
    exact_match_fields: Any = ()

    def check(self):
        self._whole("identity_equals")
        self._set("exact_match_fields", dict(self.exact_match_fields or {}))


@record
class Profile(Record):
    """How event records name their identity and what must agree within one."""

    identity_source_column: str
    identity_normalized_column: str
    measurement_core_fields: tuple[str, ...]
    sentinel: Sentinel | None = None
    json_scalar_projections: tuple[JsonScalar, ...] = ()
    bucket_count: int = 256

    def check(self):
        self._names("measurement_core_fields", 1)
        if self.sentinel is not None:
            self._set("sentinel", Sentinel.of(self.sentinel))
        self._records("json_scalar_projections", JsonScalar)
        self._whole("bucket_count", 1, 4096)
        self._need(self.bucket_count & (self.bucket_count - 1) == 0, "bucket_count must be a power of two")
        check_projections(self.json_scalar_projections)


def check_projections(projections: tuple[JsonScalar, ...]) -> None:
    outputs = [p.output_column for p in projections]
    if len(projections) > MAX_PROJECTIONS:
        raise ContractError("too many JSON projections")
    if len(set(outputs)) != len(outputs):
        raise ContractError("two JSON projections share an output column")
    if set(outputs) & {p.source_column for p in projections}:
        raise ContractError("a JSON projection reads another's output")


def json_scalar(source: Column, p: JsonScalar) -> Column:
    """The scalar at a key path of JSON text; whatever is not there, or of another type, raises."""
    fail = lambda why, t: F.raise_error(F.lit(f"JSON projection {p.output_column}: {why}")).cast(t)
    value = F.try_parse_json(source)
    whole = F.when(source.isNull(), fail("source is null", "variant")).when(value.isNull(), fail("malformed", "variant")).otherwise(value)
    for key in p.key_path:
        if "'" in key or "\\" in key:
            raise ContractError("a key may not hold a quote or backslash")
        at = F.variant_get(whole, f"$['{key}']", "variant")
        whole = (
            F.when(~F.schema_of_variant(whole).startswith("OBJECT"), fail("path leads through a non-object", "variant"))
            .when(at.isNull(), fail("key is missing", "variant"))
            .otherwise(at)
        )
    kind = F.schema_of_variant(whole)
    if p.scalar_type == "string":
        return F.when(kind == "STRING", F.variant_get(whole, "$", "string")).otherwise(fail("not a string", "string"))
    number = F.variant_get(whole, "$", "double")
    integral = kind.startswith("DECIMAL") | (kind == "DOUBLE") | (kind == "FLOAT")
    return (
        F.when(kind == "BIGINT", F.variant_get(whole, "$", "bigint"))
        .when(integral & (number == F.floor(number)), F.try_variant_get(whole, "$", "bigint"))
        .otherwise(fail("not a whole number", "bigint"))
    )


def project_json(df: DataFrame, projections) -> DataFrame:
    ps = tuple(JsonScalar.of(p) for p in projections)
    check_projections(ps)
    for p in ps:
        if p.source_column not in df.columns:
            raise ContractError(f"no such column: {p.source_column}")
        if not isinstance(df.schema[p.source_column].dataType, T.StringType):
            raise RecordError("a JSON projection reads text")
        if p.output_column in df.columns:
            raise ContractError("a JSON projection would overwrite a column")
    return df.withColumns({p.output_column: json_scalar(F.col(p.source_column), p) for p in ps}) if ps else df


def is_witness(df: DataFrame, sentinel: Sentinel | None, identity: Column) -> Column:
    """True for marker rows: the sentinel identity, and every named field as given."""
    if sentinel is None:
        return F.lit(False)
    found = F.coalesce(identity == sentinel.identity_equals, F.lit(False))
    for name, value in sentinel.exact_match_fields.items():
        c = F.col(name)
        found = found & (c.isNull() if value is None else F.coalesce(c == F.lit(value), F.lit(False)))
    return found


def whole_identity(df: DataFrame, column: str) -> Column:
    """The identity as a long; null if it is missing, boolean, not finite or not whole."""
    if isinstance(df.schema[column].dataType, T.BooleanType):
        return F.lit(None).cast("bigint")
    number = F.col(column).try_cast("double")
    whole = (number == F.floor(number)) & ~number.isin(float("inf"), float("-inf")) & ~F.isnan(number)
    return F.when(whole, F.col(column).try_cast("bigint"))


def checked(df: DataFrame, profile: Profile, extra: tuple[str, ...] = ()) -> DataFrame:
    """Project, mark and validate; adds ``_identity`` and ``_witness``.

    All rules are counted in one aggregate, then raised in a fixed order.
    """
    df = project_json(df, profile.json_scalar_projections)
    needed = (profile.identity_source_column, profile.identity_normalized_column, *profile.measurement_core_fields, *extra)
    if profile.sentinel is not None:
        needed += tuple(profile.sentinel.exact_match_fields)
    for name in needed:
        if name not in df.columns:
            raise RecordError(f"missing required column: {name}")
    marked = df.withColumn("_identity", whole_identity(df, profile.identity_source_column))
    marked = marked.withColumn("_witness", is_witness(marked, profile.sentinel, F.col("_identity")))
    identity, positive = F.col("_identity"), F.col("_identity") > 0
    text = F.col(profile.identity_normalized_column).cast("string")
    no_core = F.lit(False)
    for name in profile.measurement_core_fields:
        no_core = no_core | F.col(name).isNull()
    counts = marked.agg(
        F.count_if(identity.isNull() | ((identity <= 0) & ~F.col("_witness"))).alias("identity"),
        F.count_if(positive & (text.isNull() | (text != identity.cast("string")))).alias("normalized"),
        F.count_if(positive & no_core).alias("core"),
    ).first()
    if counts["identity"]:
        raise RecordError("identity is missing or not positive")
    if counts["normalized"]:
        raise RecordError("identity normalized column mismatch")
    if counts["core"]:
        raise RecordError("measurement core fields disagree")
    return marked


def with_changes(df: DataFrame) -> DataFrame:
    """Adds ``_new``: whether a row's identity differs from the row before, over all files in order.

    The row before is found within blocks of a file, so no file is one task; the first row of
    a block looks at the last row of the block before, from a table with a row for each block.
    """
    block = F.floor(F.col(ROW) / BLOCK_ROWS)
    inside = Window.partitionBy(FILE, "_block").orderBy(ROW)
    placed = df.withColumn("_block", block).withColumn("_before", F.lag("_identity").over(inside))
    ends = placed.groupBy(FILE, "_block").agg(F.max_by("_identity", ROW).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(Window.orderBy(FILE, "_block"))).drop("_end")
    joined = placed.join(ends, [FILE, "_block"])
    before = F.coalesce("_before", "_carried")
    return joined.withColumn("_new", before.isNull() | (before != F.col("_identity"))).drop("_block", "_before", "_carried")


def identity_bucket(identity: Column, buckets: int) -> Column:
    """Bucket of an identity: the low bits of its mix, for a number of buckets that is a power of two."""
    return splitmix64(identity.cast("long")).bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


@dataclass(frozen=True)
class State:
    """What canonicalization says of its inputs; ``identities`` has (bucket, identity)."""

    bucket_count: int
    rows: int
    groups: int
    witnesses: int
    first: dict | None
    last: dict | None
    identities: DataFrame

    def bucket_counts(self) -> DataFrame:
        return self.identities.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))

    def summary(self, spark: SparkSession) -> DataFrame:
        """One row: bucket_count, rows, groups, witnesses, first_identity, last_identity."""
        end = lambda x: None if x is None else x["identity"]
        schema = "bucket_count bigint, rows bigint, groups bigint, witnesses bigint, first_identity bigint, last_identity bigint"
        return spark.createDataFrame([(self.bucket_count, self.rows, self.groups, self.witnesses, end(self.first), end(self.last))], schema)

    def validate(self) -> State:
        """Counts, ends and buckets must agree with one another."""
        n = self.identities.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("identity").alias("d"), F.count_if(F.col("identity") <= 0).alias("bad")).first()
        ends = (self.first is None, self.last is None)
        if n["n"] != self.groups or n["d"] != n["n"] or n["bad"] or self.rows < self.groups or (self.groups == 0) != all(ends) or any(ends) != all(ends):
            raise RecordError("canonicalization state is inconsistent")
        wrong = self.identities.where(F.col("bucket") != identity_bucket(F.col("identity"), self.bucket_count))
        if not wrong.isEmpty():
            raise RecordError("an identity is in another bucket")
        return self


def canonicalize(df: DataFrame, params) -> State:
    """Validate ordered event records and summarise their identities.

    Witnesses of a file without a positive row are not counted beside files that have one.
    """
    profile = Profile.of(params)
    marked = checked(df, profile)
    core = F.struct(*profile.measurement_core_fields)
    positive = with_changes(marked.where("_identity > 0"))
    place = F.struct(FILE, ROW)
    per_identity = positive.groupBy(F.col("_identity").alias("identity")).agg(
        F.count_if("_new").alias("runs"), F.min(core).alias("low"), F.max(core).alias("high")
    )
    bad = per_identity.agg(F.count_if(F.expr("runs > 1")).alias("recurs"), F.count_if(F.col("low") != F.col("high")).alias("differs"), F.count(F.lit(1)).alias("n")).first()
    if bad["differs"]:
        raise RecordError("measurement core fields disagree")
    if bad["recurs"]:
        raise RecordError("positive identity recurs non-contiguously")
    end = F.struct(F.col("_identity").alias("identity"), core.alias("core"))
    per_file = marked.groupBy(FILE).agg(
        F.count_if(F.expr("_identity > 0")).alias("rows"), F.count_if("_witness").alias("witnesses"),
        F.min_by(F.when(F.col("_identity") > 0, end), F.when(F.col("_identity") > 0, place)).alias("first"),
        F.max_by(F.when(F.col("_identity") > 0, end), F.when(F.col("_identity") > 0, place)).alias("last"),
    ).orderBy(FILE).collect()  # one row for each input file
    held = [r for r in per_file if r["rows"]]
    ends = lambda r, k: {"identity": r[k]["identity"], "core": r[k]["core"].asDict()} if r else None
    witnesses = sum(r["witnesses"] for r in held) if held else (per_file[-1]["witnesses"] if per_file else 0)
    return State(
        bucket_count=profile.bucket_count, rows=sum(r["rows"] for r in held), groups=bad["n"], witnesses=witnesses,
        first=ends(held[0], "first") if held else None, last=ends(held[-1], "last") if held else None,
        identities=per_identity.select(identity_bucket(F.col("identity"), profile.bucket_count).alias("bucket"), "identity"),
    )


def merge(left: State, right: State) -> State:
    """Join two states of neighbouring inputs.

    An identity may be in both only as left's last and right's first with equal core fields;
    its group and one row are then counted once. A side without positive rows gives way to
    the other whole, witnesses included.
    """
    if left.bucket_count != right.bucket_count:
        raise RecordError("bucket_count differs between states")
    if not left.groups:
        return right
    if not right.groups:
        return left
    shared = left.last["identity"] == right.first["identity"]
    if shared and left.last["core"] != right.first["core"]:
        raise RecordError("measurement core fields disagree at boundary identity")
    both = left.identities.join(right.identities, ["bucket", "identity"])
    if shared:
        both = both.where(F.col("identity") != left.last["identity"])
    if not both.isEmpty():
        raise RecordError("positive identity recurs across states")
    return State(
        bucket_count=left.bucket_count, rows=left.rows + right.rows - shared, groups=left.groups + right.groups - shared,
        witnesses=left.witnesses + right.witnesses, first=left.first, last=right.last,
        identities=left.identities.union(right.identities).distinct(),
    )


@record
class Trailing(Record):
    fact_id: str
    measurement_field: str
    trailing_width_ms: int

    def check(self):
        self._whole("trailing_width_ms", 1)


@record
class Future(Record):
    fact_id: str
    measurement_field: str
    start_offset_ms: int
    end_offset_ms: int
    min_block_exclusive: int

    def check(self):
        self._whole("start_offset_ms", 0)
        self._whole("end_offset_ms", 0)
        self._need(self.end_offset_ms >= self.start_offset_ms, "end_offset_ms must not precede start_offset_ms")


@record
class EventWindow(Record):
    symbol: str
    symbol_column: str
    block_column: str
    timestamp_column: str
    decision_timestamp_ms: int
    causal_cutoff_block: int
    as_of_measurement_field: str
    profile: Profile
    as_of_offsets_ms: tuple[int, ...] = (0,)
    trailing_windows: tuple[Trailing, ...] = ()
    future_windows: tuple[Future, ...] = ()
    tie_break_columns: tuple[str, ...] = ("timestamp_ms",)

    def check(self):
        self._set("profile", Profile.of(self.profile))
        self._records("trailing_windows", Trailing)
        self._records("future_windows", Future)
        self._names("tie_break_columns", 1)
        self._set("as_of_offsets_ms", tuple(self.as_of_offsets_ms))

    def measurements(self) -> tuple[str, ...]:
        return (self.as_of_measurement_field, *(w.measurement_field for w in (*self.trailing_windows, *self.future_windows)))


def melt_facts(wide: DataFrame, names: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, fact_id, value) rows from one column for each fact."""
    facts = F.array(*[F.struct(F.lit(n).alias("fact_id"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])
    return wide.select(*keys, F.explode(facts).alias("f")).select(*keys, "f.fact_id", "f.value")


def event_window(df: DataFrame, params) -> DataFrame:
    """(fact_id, value) of one symbol at one decision time.

    All symbols are validated. Of each identity the last row counts. Trailing windows are open
    at their start; a null measurement adds 0 and is counted. As-of takes the greatest tuple of
    tie-break columns among rows early enough, future the least, the earlier row on ties.
    """
    p = EventWindow.of(params)
    canonicalize(df, p.profile)
    marked = checked(df, p.profile, (p.symbol_column, p.block_column, p.timestamp_column, *p.tie_break_columns, *p.measurements()))
    place = F.struct(FILE, ROW)
    rows = marked.where((F.col(p.symbol_column) == p.symbol) & ~F.col("_witness"))
    fields = {
        "_ts": F.col(p.timestamp_column).try_cast("bigint"), "_block": F.col(p.block_column).try_cast("bigint"), "_place": place,
        "_tie": F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(p.tie_break_columns)]),
        **{f"_m_{m}": F.col(m).cast("double") for m in dict.fromkeys(p.measurements())},
    }
    one = rows.groupBy("_identity").agg(F.max_by(F.struct(*[c.alias(n) for n, c in fields.items()]), place).alias("r")).select("r.*")
    ts, block, d = F.col("_ts"), F.col("_block"), p.decision_timestamp_ms
    causal = block <= p.causal_cutoff_block
    latest = F.struct("_tie", (-F.col(f"_place.{FILE}")).alias("f"), (-F.col(f"_place.{ROW}")).alias("r"))
    earliest = F.struct("_tie", "_place")
    facts: dict[str, Column] = {}
    for w in p.trailing_windows:
        inside = causal & (ts > d - w.trailing_width_ms) & (ts <= d)
        facts[f"{w.fact_id}.sum"] = F.coalesce(F.sum(F.when(inside, F.coalesce(f"_m_{w.measurement_field}", F.lit(0.0)))), F.lit(0.0))
        facts[f"{w.fact_id}.count"] = F.count_if(inside)
    for offset in p.as_of_offsets_ms:
        facts[f"as_of.{offset}"] = F.max_by(f"_m_{p.as_of_measurement_field}", F.when(causal & (ts <= d - offset), latest))
    for w in p.future_windows:
        inside = (ts >= d + w.start_offset_ms) & (ts <= d + w.end_offset_ms) & (block > w.min_block_exclusive)
        facts[w.fact_id] = F.min_by(f"_m_{w.measurement_field}", F.when(inside, earliest))
    return melt_facts(one.agg(*[c.alias(n) for n, c in facts.items()]), list(facts))
