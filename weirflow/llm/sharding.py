"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get global numbers 0..N-1, a keyed Feistel network over a rectangle just larger than
N permutes them, and values outside 0..N-1 walk on along their cycle. The permuted number
is the place in the shuffle: shard is its remainder and slot its quotient by the shard
count. Both can be computed, and inverted, from a row number, the seed and N alone.

The ``rows`` law holds: shard counts differ by one at most.

Defined results: a null text is 0 bytes; rows with equal id and text are interchangeable and
each gets a place of its own, however many there are; a very long text is only measured and
summed; other columns are not looked at and may have the names of the result's; an empty table
gives an empty result.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm._common import bind, cut

#: Rows are numbered within this many hash buckets; only their counts are ever scanned in order.
BUCKETS = 4096
#: Documents are numbered in as many buckets as hold so many each, up to a number whose counts the driver holds.
ROWS_PER_BUCKET, MAX_BUCKETS = 100_000, 65_536
#: Equal rows get their numbers in pieces of this many.
PIECE = 65_536
ROUNDS = 6
#: Under 1/sqrt(N) of the rectangle lies outside, so a walk this long is not met in practice.
WALK = 64


def rectangle(rows: int) -> tuple[int, int]:
    """Sides a >= b with a * b >= rows and fewer than a cells to spare."""
    a = max(1, isqrt(max(rows - 1, 0)) + 1)
    return a, max(1, -(-rows // a))


def _div(x: Column, n: Column) -> Column:
    """Whole quotient of longs, exact beyond 2 ** 53."""
    return F.call_function("div", x, n)


def _pass(x: Column, a: int, b: int, seed: int, sign: int) -> Column:
    """The network over x in 0..a*b-1: halves in turn get a keyed hash of the other added.

    sign -1 undoes it.
    """
    long = lambda n: F.lit(n).cast("long")

    def rounds(left: Column, right: Column, todo: list[int]) -> Column:
        if not todo:
            return right * long(a) + left
        k, rest = todo[0], todo[1:]
        noise = lambda other, side: F.pmod(F.xxhash64(other, long(seed), F.lit(k)), long(side))
        if k % 2 == 0:
            return bind(F.pmod(left + sign * noise(right, a), long(a)), lambda h: rounds(h, right, rest))
        return bind(F.pmod(right + sign * noise(left, b), long(b)), lambda h: rounds(left, h, rest))

    order = list(range(ROUNDS))[::sign]
    return bind(F.pmod(x, long(a)), lambda left: bind(_div(x, long(a)), lambda right: rounds(left, right, order)))


def _walk(x: Column, rows: int, seed: int, sign: int) -> Column:
    a, b = rectangle(rows)
    n = F.lit(rows).cast("long")
    first = _pass(x, a, b, seed, sign)
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), first,
        lambda v, _: F.when(v < n, v).otherwise(_pass(v, a, b, seed, sign)),
    )
    return F.when(found < n, found).otherwise(
        F.raise_error(F.lit("the walk left the row numbers; take another seed")).cast("long")
    )


def permute(x: Column, rows: int, seed: int = 0) -> Column:
    """The place in the shuffle of row number x, 0..rows-1."""
    return _walk(x, rows, seed, 1)


def unpermute(place: Column, rows: int, seed: int = 0) -> Column:
    """The row number at a place in the shuffle."""
    return _walk(place, rows, seed, -1)


def number(df: DataFrame, key: list[str], order: list[str], out: str = "row") -> tuple[DataFrame, int]:
    """Global row numbers from 0, and the number of rows.

    Rows are bucketed by a hash of ``key``, numbered within their bucket by ``order``, and
    shifted by the sizes of the buckets before: no sort over all rows, no single task.
    ``df`` is frozen first, so that a lost executor cannot change the numbers.
    """
    frozen = cut(df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).cast("int")))
    counts = {r["_bucket"]: r["n"] for r in frozen.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, rows = [], 0
    for bucket in range(BUCKETS):
        starts.append(rows)
        rows += counts.get(bucket, 0)
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)).cast("long") - 1
    start = F.get(F.lit(starts).cast("array<bigint>"), F.col("_bucket"))
    return frozen.withColumn(out, within + start).drop("_bucket"), rows


def _row_numbers(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """``columns`` and a global ``row`` from 0 of every row, and the number of rows.

    Equal rows are counted, not moved: one row for each stands in a bucket, and its numbers are
    made again in pieces. Numbers follow from the rows alone, so a lost task changes none.
    """
    counted = cut(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")))
    buckets = 64
    while buckets < MAX_BUCKETS and buckets * ROWS_PER_BUCKET < counted.count():
        buckets *= 2
    dealt = counted.withColumn("_bucket", F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int"))
    sums = sorted(tuple(r) for r in dealt.groupBy("_bucket").agg(F.sum("n"), F.max("n")).collect())
    starts, total = [], 0
    for bucket, n, _ in sums:
        starts.append((bucket, total))
        total += n
    start = F.broadcast(rows.sparkSession.createDataFrame(starts, "_bucket int, _start long"))
    before = Window.partitionBy("_bucket").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))).join(start, "_bucket")
    first, n, size = F.col("_start") + F.col("_before"), F.col("n"), F.lit(PIECE).cast("long")
    pieces = F.transform(
        F.sequence(F.lit(0).cast("long"), _div(n - 1, size)),
        lambda k: F.struct((first + k * size).alias("lo"), F.least(first + (k + 1) * size, first + n).alias("hi")),
    )
    piece = placed.select(*columns, F.explode(pieces).alias("x")).select(*columns, "x.lo", "x.hi")
    if max((m for _, _, m in sums), default=0) > PIECE:
        piece = piece.repartition(*columns, "lo")
    return piece.select(*columns, F.explode(F.sequence("lo", F.col("hi") - 1)).alias("row")), total


def shard(docs: DataFrame, shards: int = 24, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    light = docs.select(
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    numbered, rows = _row_numbers(light, ["doc_id", "text_crc32", "size"])
    placed = numbered.withColumn("_place", permute(F.col("row"), rows, seed))
    n = F.lit(shards).cast("long")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.pmod(F.col("_place"), n).cast("int").alias("shard"),
        _div(F.col("_place"), n).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
