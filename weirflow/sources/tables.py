"""Tables in and out: CSV, JSON arrays, JSON lines and Parquet, and ordered file lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.contracts import ContractError

#: Suffixes and the formats they stand for: fixed values.
SUFFIXES = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet"}
PARQUET_MEDIA_TYPES = ("application/vnd.apache.parquet", "application/x-parquet", "application/parquet")

#: Lines of a JSON array that a worker holds twice.
LINES = 256

#: Files in one ordered input list.
MAX_INPUTS = 64


def format_of(path: str, media_type: str | None = None) -> str:
    if media_type in PARQUET_MEDIA_TYPES:
        return "parquet"
    for suffix, kind in SUFFIXES.items():
        if path.rstrip("/").lower().endswith(suffix):
            return kind
    raise ContractError("unsupported table format")


def read(spark: SparkSession, source, schema: str | None = None, kind: str | None = None) -> DataFrame:
    """A table from a path, a ``{"uri": path}``, an object with ``uri``, records or a DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, dict) and set(source) >= {"uri"}:
        return read(spark, source["uri"], schema, kind or source.get("format"))
    if hasattr(source, "uri"):
        return read(spark, source.uri, schema, kind)
    if isinstance(source, (list, tuple)):
        return spark.createDataFrame(list(source), schema)
    if not isinstance(source, str):
        raise ContractError("unsupported table source")
    kind = kind or format_of(source)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.csv(source, header=True, inferSchema=schema is None)
    if kind == "json":
        return reader.json(source, multiLine=True)
    if kind == "jsonl":
        return reader.json(source)
    return reader.parquet(source)


def _array_lines(batches):
    """The lines of one JSON array, a row on each, as they come; no row becomes a Python object."""
    lead = "["
    for batch in batches:
        for at in range(0, batch.num_rows, LINES):
            lines = batch.column(0).slice(at, LINES)
            leads = pa.array([lead] + [","] * (len(lines) - 1), lines.type)
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(leads, lines, pa.scalar("", lines.type))], ["value"])
            lead = ","
    yield pa.RecordBatch.from_arrays([pa.array(["[]" if lead == "[" else "]"])], ["value"])


def write(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> str:
    """Write a table. As JSON, each partition is a file with an array of its own."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.csv(path, header=True)
    elif kind == "jsonl":
        writer.option("ignoreNullFields", "false").json(path)
    elif kind == "parquet":
        writer.parquet(path)
    elif kind == "json":
        rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
        # a limit of the session on a file's rows would cut an array
        rows.mapInArrow(_array_lines, "value string").write.mode(mode).option("maxRecordsPerFile", 0).text(path)
    else:
        raise ContractError("output_format must be one of csv, json, jsonl, parquet")
    return path


def read_ordered(spark: SparkSession, paths: Sequence[str], file_column: str = "_file", row_column: str = "_row") -> DataFrame:
    """Parquet files in the given order, each row with its file's place and its place in it."""
    if not paths:
        raise ContractError("at least one parquet input is required")
    if len(paths) > MAX_INPUTS:
        raise ContractError("parquet input count exceeds limit")
    each = [
        spark.read.parquet(p).withColumns({file_column: F.lit(i), row_column: F.col("_metadata.row_index")})
        for i, p in enumerate(paths)
    ]
    return reduce(DataFrame.unionByName, each)
