"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash. A source that must give r times its size gives each
document floor(r) times, and once more those below a hash threshold. The threshold is found
from sums of sizes by source and hash bucket: the bucket in which the running sum passes the
budget is cut into finer buckets, and so on until it holds one document or the hash is used
up. Larger budgets take supersets of what smaller ones take. Documents are never sorted;
what moves is at most one row for each source, bucket and task.

Weights 5, 2, 1 go to sources in code-point order, null last, repeating. All targets add up
to the size of all sources; none is above ``max_repeat`` times its source, and what a source
cannot give is shared among the others by weight.

Defined results: a null text has size 0; null ids take part by their text; rows equal in id and
text share a hash, so they are taken alike; a source of size 0 has target 0; a very long text
counts whole, and is taken if that comes nearer to the target; an empty table gives an empty
result; other columns are untouched and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm._common import cut, small, words

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
HASH_BITS, STEP_BITS = 60, 12


def hash60(doc_id: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target for (source, source_size): one row per source throughout."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod(place, F.lit(len(weights))))
    everything = Window.partitionBy()
    ranked = by_source.withColumn("w", weight).withColumn("cap", F.col("source_size") * max_repeat)
    # the sources that reach their cap are a prefix by cap per weight
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    level = ranked.select(
        "source", "source_size", "w", "cap",
        F.sum("source_size").over(everything).alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("cap").over(before), zero).alias("caps"),
        F.coalesce(F.sum("w").over(before), zero).alias("ws"),
    ).withColumn("full", F.col("cap") * (F.col("all_w") - F.col("ws")) <= F.col("w") * (F.col("total") - F.col("caps")))
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(zero)).over(everything)
    used = F.sum(F.when(F.col("full"), F.col("w")).otherwise(zero)).over(everything)
    share = (F.col("w") * (F.col("total") - F.col("spent"))).cast("double") / (F.col("all_w") - F.col("used")).cast("double")
    return (
        level.withColumn("spent", spent)
        .withColumn("used", used)
        .select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))
    )


def thresholds(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, int]:
    """Per source its target, whole copies and hash threshold; and the number of sources.

    ``sizes`` has source, size and hash. A document gets one copy more if its hash, shifted
    right by ``shift``, is below ``prefix``, or equals it and ``last`` is true.
    """
    by_source = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    rows = by_source.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets(by_source, weights, max_repeat).withColumn("whole", whole)
    state = cut(
        plan.select(
            "source", "source_size", "target", "whole",
            (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
            F.expr("0L").alias("prefix"), F.lit(HASH_BITS).alias("shift"), F.lit(False).alias("last"),
            F.expr("0L").alias("below"), (F.col("source_size") > 0).alias("open"),
        )
    )
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        live = state.where("open").select(F.col("source").alias("s"), "prefix", "shift", "budget", "below")
        near = sizes.where("size > 0").join(small(live, rows), F.col("source").eqNullSafe(F.col("s")))
        near = near.where(_above(F.col("hash"), F.col("shift")) == F.col("prefix"))
        cells = near.groupBy("s", "budget", "below", F.shiftright("hash", shift).alias("cell")).agg(
            F.sum("size").alias("cell_size"), F.min("hash").alias("lo"), F.max("hash").alias("hi")
        )
        up_to = F.sum("cell_size").over(Window.partitionBy("s").orderBy("cell"))
        passed = cells.withColumn("end", F.col("below") + up_to).where(F.col("end") > F.col("budget"))
        first = passed.groupBy("s").agg(
            F.min(F.struct("cell", (F.col("end") - F.col("cell_size")).alias("start"), "cell_size", "lo", "hi")).alias("c")
        )
        at = first.select(
            "s", F.col("c.cell").alias("cell"), F.col("c.start").alias("start"), F.col("c.cell_size").alias("cell_size"),
            (F.col("c.lo") < F.col("c.hi")).alias("more"),
        )
        moved = state.join(at, F.col("source").eqNullSafe(F.col("s")), "left")
        # no bucket passes the budget: all of the source is within it
        goes = F.col("open") & F.col("cell").isNotNull()
        state = cut(
            moved.select(
                "source", "source_size", "target", "whole", "budget",
                F.when(goes, F.col("cell")).when(F.col("open"), F.col("prefix") + 1).otherwise(F.col("prefix")).alias("prefix"),
                F.when(goes, F.lit(shift)).otherwise(F.col("shift")).alias("shift"),
                # the document on the boundary is taken if that comes nearer to the target
                F.when(goes, 2 * (F.col("budget") - F.col("start")) > F.col("cell_size")).otherwise(F.col("last")).alias("last"),
                F.when(goes, F.col("start")).otherwise(F.col("below")).alias("below"),
                (goes & F.col("more")).alias("open"),
            )
        )
        if state.where("open").isEmpty():
            break
    return state, rows


def _above(value: Column, shift: Column) -> Column:
    return F.call_function("shiftright", value, F.least(shift, F.lit(63)))


def _copies(hash_col: Column) -> Column:
    cell = _above(hash_col, F.col("shift"))
    extra = (cell < F.col("prefix")) | ((cell == F.col("prefix")) & F.col("last"))
    return F.col("whole") + extra.cast("long")


def op4_rows(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, size, source_size, target, taken; one row per document."""
    sizes = cut(
        docs.select(
            F.col("doc_id").alias("doc_id"), F.col("source").alias("source"),
            F.size(words(F.col("text"))).cast("long").alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash"),
        )
    )
    state, rows = thresholds(sizes, weights, max_repeat)
    plan = small(state.withColumnRenamed("source", "s"), rows)
    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("hash"))).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The mixed documents themselves, a document as often as it is taken, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id")
    size = F.size(words(F.col("text"))).cast("long")
    sizes = cut(docs.select("source", size.alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash")))
    state, rows = thresholds(sizes, weights, max_repeat)
    plan = small(state.withColumnRenamed("source", "s"), rows)
    wrapped = docs.select(row.alias("row"), F.col("source").alias("source"), hash60(F.col("doc_id"), F.col("text")).alias("hash"))
    copies = wrapped.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("row", _copies(F.col("hash")).alias("n"))
    return copies.where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("row.*")


#: op4 as SQL: the same targets, and the threshold as a running sum in hash order.
ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS w, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, sum(w) OVER ()::BIGINT AS all_w,
         coalesce(sum(cap) OVER f, 0)::BIGINT AS caps, coalesce(sum(w) OVER f, 0)::BIGINT AS ws
  FROM w WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), m AS (SELECT *, cap * (all_w - ws) <= w * (total - caps) AS is_full FROM l),
n AS (
  SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0)::BIGINT AS spent, coalesce(sum(w) FILTER (is_full) OVER (), 0)::BIGINT AS used FROM m
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * (total - spent))::DOUBLE / (all_w - used)::DOUBLE END AS target FROM n
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS up_to,
         sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN up_to <= budget OR (up_to - own <= budget AND 2 * (budget - (up_to - own)) > own) THEN 1 ELSE 0 END) AS taken
FROM r
"""
