"""Shards, waves, and which shards of a run are done, missing, retryable or exhausted.

Plans and attempts are tables, so a run of millions of shards is planned and judged by joins.
Ranges are half-open; time ranges are in microseconds since the epoch.

Shards: (run_id, shard_id, ordinal, start, end, input_digest, fingerprint).
Attempts: (shard_id, attempt_id, status, input_digest, fingerprint, started_at, finished_at).
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.contracts import ContractError, Record, record


@record
class Extents(Record):
    """What a shard reads beyond its own range, in rows or microseconds alike."""

    lookback: int = 0
    lookforward: int = 0
    halo_before: int = 0
    halo_after: int = 0

    def check(self):
        for name in ("lookback", "lookforward", "halo_before", "halo_after"):
            self._whole(name, 0)


@record
class Policy(Record):
    max_attempts_per_shard: int = 3
    resume_enabled: bool = True

    def check(self):
        self._whole("max_attempts_per_shard", 1)


def instant(text: str) -> datetime:
    """An ISO instant with a zone."""
    try:
        t = datetime.fromisoformat(text)
    except (TypeError, ValueError) as e:
        raise ContractError("time boundaries must be ISO 8601") from e
    if t.tzinfo is None:
        raise ContractError("time boundaries must carry a zone")
    return t


def micros(t: datetime) -> int:
    return (t - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def plan_shards(spark: SparkSession, run_id: str, start, end, size, input_digest: str = "", fingerprint: str = "", partition_key: str | None = None, affinity: bool = False) -> DataFrame:
    """Equal shards of an index range, or of a time range given as ISO instants.

    ``size`` is a count of rows, or a timedelta or seconds. The last shard may be shorter.
    """
    if affinity and not partition_key:
        raise ContractError("partition_key is required for partition affinity")
    if isinstance(start, str) or isinstance(end, str):
        lo, hi = micros(instant(start)), micros(instant(end))
        if isinstance(size, bool) or not isinstance(size, (int, float, timedelta)):
            raise ContractError("time shards need a duration")
        step = (size if isinstance(size, timedelta) else timedelta(seconds=size)) // timedelta(microseconds=1)
    else:
        for x in (start, end, size):
            if isinstance(x, bool) or not isinstance(x, int):
                raise ContractError("index ranges and sizes are whole numbers")
        lo, hi, step = start, end, size
        if lo < 0:
            raise ContractError("index boundaries must not be negative")
    if step <= 0:
        raise ContractError("the shard size must be positive")
    if hi < lo:
        raise ContractError("range end precedes start")
    n = -(-(hi - lo) // step)
    begin = (F.col("id") * step + lo).cast("bigint")
    return spark.range(n).select(
        F.lit(run_id).alias("run_id"), F.format_string("shard-%06d", "id").alias("shard_id"), F.col("id").alias("ordinal"),
        F.lit(partition_key).cast("string").alias("partition_key"), begin.alias("start"), F.least(begin + step, F.lit(hi)).alias("end"),
        F.lit(input_digest).alias("input_digest"), F.lit(fingerprint).alias("fingerprint"),
    )


def expanded(shards: DataFrame, extents, index: bool = True) -> DataFrame:
    """Adds ``read_start`` and ``read_end``; an index never goes below 0."""
    e = Extents.of(extents)
    first = F.col("start") - (e.lookback + e.halo_before)
    return shards.withColumns({
        "read_start": F.greatest(first, F.lit(0)).cast("bigint") if index else first,
        "read_end": F.col("end") + (e.lookforward + e.halo_after),
    })


def plan_waves(shards: DataFrame, max_per_wave: int | None = None, backend_limit: int | None = None) -> DataFrame:
    """Adds ``wave_id`` and ``wave``: shards in order of ordinal and id, in groups of the lower limit.

    Places are found from how many shards come before each block of ordinals, so that no task
    orders all shards.
    """
    limits = [x for x in (max_per_wave, backend_limit) if x is not None]
    if not limits or min(limits) <= 0:
        raise ContractError("a positive wave limit is required")
    if shards.groupBy("shard_id").count().where("count > 1").limit(1).count():
        raise ContractError("shard ids must be unique")
    block = F.floor(F.col("ordinal") / 65_536)
    placed = shards.withColumn("_block", block)
    before = placed.groupBy("_block").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    inside = F.row_number().over(Window.partitionBy("_block").orderBy("ordinal", "shard_id")) - 1
    wave = F.floor((F.col("_before") + F.col("_inside")) / min(limits)).cast("bigint")
    return (
        placed.withColumn("_inside", inside).join(before, "_block").withColumn("wave", wave)
        .withColumn("wave_id", F.format_string("wave-%04d", "wave")).drop("_block", "_n", "_before", "_inside")
    )


def _current(shards: DataFrame, attempts: DataFrame) -> DataFrame:
    """Each shard with its attempts on the same input and fingerprint: (shard_id, ordinal, tried, won, first)."""
    same = ["shard_id", "input_digest", "fingerprint"]
    won = F.col("status") == "succeeded"
    counts = attempts.groupBy(*same).agg(
        F.count(F.lit(1)).alias("tried"), F.count_if(won).alias("won"),
        F.min_by("attempt_id", F.when(won, F.struct("finished_at", "started_at", "attempt_id"))).alias("canonical_attempt"),
    )
    return shards.join(counts, same, "left").na.fill(0, ["tried", "won"])


def completeness(shards: DataFrame, attempts: DataFrame) -> DataFrame:
    """(shard_id, ordinal, state, canonical_attempt): canonical with exactly one success on the
    current input and fingerprint, missing with none, duplicate with more."""
    won = F.col("won")
    state = F.when(won == 0, "missing").when(won == 1, "canonical").otherwise("duplicate")
    return _current(shards, attempts).select("shard_id", "ordinal", state.alias("state"), F.when(won == 1, F.col("canonical_attempt")).alias("canonical_attempt"))


def retryable(shards: DataFrame, attempts: DataFrame, policy=Policy()) -> DataFrame:
    """Shards that may be tried again: attempts left, and no success unless resume is off."""
    p = Policy.of(policy)
    open_ = (F.col("won") == 0) if p.resume_enabled else F.lit(True)
    return _current(shards, attempts).where(open_ & (F.col("tried") < p.max_attempts_per_shard)).select("shard_id", "ordinal", "tried")


def exhausted(shards: DataFrame, attempts: DataFrame, policy=Policy()) -> DataFrame:
    """Shards without a success that have no attempt left."""
    p = Policy.of(policy)
    return _current(shards, attempts).where((F.col("won") == 0) & (F.col("tried") >= p.max_attempts_per_shard)).select("shard_id", "ordinal", "tried")


def can_finalize(shards: DataFrame, attempts: DataFrame) -> bool:
    return completeness(shards, attempts).where("state <> 'canonical'").isEmpty()


#: Which kind of worker an operation needs: fixed values.
PROFILES: dict[str, tuple[str, tuple[str, ...]]] = {
    "tabular": ("tabular-batch", ("tabular.normalize", "tabular.cast", "tabular.sort", "tabular.dedup", "tabular.window", "tabular.rolling", "tabular.statistics", "tabular.join", "tabular.pit_join")),
    "ml": ("ml-batch", ("ml.char_wb_tfidf_logistic_score", "ml.cosine_similarity_matrix")),
    "distilbert": ("ml-batch", ("ml.distilbert_pair_binary_scores",)),
    "media": ("media-batch", ("media.asr_normalize_flac",)),
    "replay": ("replay-batch", ("replay.structural_canonicalize", "replay.structural_canonicalize_merge", "replay.event_window_extract", "replay.causal_grid_extract")),
    "replay-eval": ("replay-eval-batch", ("replay_eval.external_api_evaluation",)),
}


def worker_profile(pack: str, operation: str) -> str:
    for name, (owner, operations) in PROFILES.items():
        if owner == pack and operation in operations:
            return name
    raise ContractError("no worker profile supports this operation")
