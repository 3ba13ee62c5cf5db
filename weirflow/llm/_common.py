"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: ASCII space and the controls tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"

#: A table is only ever offered for broadcast below this many rows.
BROADCAST_ROWS = 20_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column, gap: str = GAP) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def checkpoint_path(spark: SparkSession) -> str:
    """This session's folder in the shared ``spark.checkpoint.dir``.

    Only where that is unset (tests, notebooks) a temporary one is made, and removed at exit.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = context.getConf().get("spark.checkpoint.dir", "")
        if not path:
            path = tempfile.mkdtemp(prefix="checkpoint-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
        context.setCheckpointDir(path)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_path(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Offer a table for broadcast only if its counted rows are within the limit."""
    return F.broadcast(df) if rows <= limit else df


#: Rows and bytes that a Python worker gets at once.
BATCH, BATCH_BYTES = 256, 8 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches bounded by rows and bytes, so that long texts do not gather in a worker.

    A plan reads these when it is made; another query of the session that is planned
    meanwhile gets small batches too, which changes none of its rows.
    """
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name) for name in bounds}
    for name, value in bounds.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: At most this many keys are hot: those with so many rows, or that share of all rows.
HOT_KEYS = 10_000


def lookup(many: DataFrame, one: DataFrame, key: str | list[str], rows: int, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``many`` with the columns of ``one``, which has ``rows`` rows, one for each key.

    Within ``limit`` rows ``one`` is sent out. Beyond it the two are shuffled, but for the keys
    that hold so many rows of ``many`` that one task would get too much: there are at most
    HOT_KEYS of those, and their part of ``one`` is sent out. ``many`` should be frozen.
    """
    if rows <= limit:
        return many.join(F.broadcast(one), key, how)
    names = [key] if isinstance(key, str) else key
    counts = many.dropna(subset=names).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut(counts.where(F.col("_n") >= max(HOT_KEYS, many.count() // HOT_KEYS)).select(*names))
    if hot.isEmpty():
        return many.join(one, key, how)
    heavy = F.broadcast(one.join(F.broadcast(hot), key, "left_semi"))
    rest = many.join(F.broadcast(hot), key, "left_anti").join(one, key, how)
    return rest.unionByName(many.join(F.broadcast(hot), key, "left_semi").join(heavy, key, how))


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on computed columns without computing them again.

    Spark pushes a filter below the projection that makes its columns, and writes each
    column's expression out wherever the condition uses it. It does not where a column of
    that projection is not deterministic, so the filter also asks for a row id.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).where(condition & (F.col("_at") >= 0)).drop("_at")


def text_key(text: Column) -> Column:
    """With doc_id, tells rows apart that share an id but not a text."""
    return F.xxhash64(text)


def bind(col: Column, f) -> Column:
    """f of a column that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(col), f), F.lit(0))


def running_sum(values: Column) -> Column:
    """The running sums of an array of longs.

    Appending copies the array, so sums are made in chunks of about the square root of its
    size and shifted by the sums of the chunks before.
    """
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<bigint>")
    grow = lambda a, x: F.concat(a, F.array(F.coalesce(F.element_at(a, -1), zero) + x))
    sums = lambda xs: F.aggregate(xs, none, lambda a, x: F.when(F.size(a) == 0, F.array(x)).otherwise(grow(a, x)))

    def by_chunk(width: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / width).cast("int"))
        inner = F.transform(starts, lambda k: sums(F.slice(values, k * width + 1, width)))
        return bind(
            inner,
            lambda chunks: bind(
                sums(F.transform(chunks, lambda c: F.element_at(c, -1))),
                lambda before: F.flatten(
                    F.transform(chunks, lambda c, k: F.transform(c, lambda x: x + F.coalesce(F.get(before, k - 1), zero)))
                ),
            ),
        )

    return F.when(F.size(values) == 0, none).otherwise(bind(F.ceil(F.sqrt(F.size(values))).cast("int"), by_chunk))
