"""Identity buckets as binary payloads, and canonicalization states as files.

Parquet is how states travel here; the binary form is an export for readers of that format.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators.replay import RecordError, State, identity_bucket

#: The binary format: magic, version, header layout (magic, version, buckets, bucket, count) and limit. Fixed values.
MAGIC, VERSION, HEADER, MOST = b"PBEBKT01", 1, "<8sHIIQ", 1 << 20
HEADER_SIZE = struct.calcsize(HEADER)


def encode(identities: DataFrame, bucket_count: int) -> DataFrame:
    """(bucket, payload) of (bucket, identity), for buckets that hold any."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(pdf["identity"].tolist())
        if len(ids) > MOST:
            raise RecordError("a bucket holds more identities than its format allows")
        bucket = int(pdf["bucket"].iloc[0])
        payload = struct.pack(HEADER, MAGIC, VERSION, bucket_count, bucket, len(ids)) + struct.pack(f"<{len(ids)}Q", *ids)
        return pd.DataFrame({"bucket": [bucket], "payload": [payload]})

    return identities.groupBy("bucket").applyInPandas(one, "bucket int, payload binary")


def parse(payload: bytes, bucket_count: int) -> tuple[int, list[int]]:
    """(bucket, identities) of one payload; anything out of place raises."""
    if len(payload) < HEADER_SIZE:
        raise RecordError("bucket payload is truncated")
    magic, version, buckets, bucket, count = struct.unpack_from(HEADER, payload)
    if (magic, version, buckets) != (MAGIC, VERSION, bucket_count) or bucket >= buckets or count > MOST:
        raise RecordError("bucket payload has another header")
    if len(payload) != HEADER_SIZE + 8 * count:
        raise RecordError("bucket payload has another length")
    ids = list(struct.unpack_from(f"<{count}Q", payload, HEADER_SIZE))
    if any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or (ids and ids[0] <= 0):
        raise RecordError("bucket identities must ascend from 1")
    return bucket, ids


def decode(payloads: DataFrame, bucket_count: int) -> DataFrame:
    """(bucket, identity) of (payload); every identity must belong to its bucket."""

    def run(batches):
        for pdf in batches:
            rows = [(b, i) for p in pdf["payload"] for b, ids in [parse(bytes(p), bucket_count)] for i in ids]
            yield pd.DataFrame(rows, columns=["bucket", "identity"])

    found = payloads.select("payload").mapInPandas(run, "bucket int, identity bigint")
    right = identity_bucket(F.col("identity"), bucket_count)
    return found.select(
        F.when(F.col("bucket") == right, F.col("bucket")).otherwise(F.raise_error(F.lit("an identity is in another bucket")).cast("int")).alias("bucket"), "identity"
    )


def save(state: State, path: str) -> None:
    """A state as a folder: its identities by bucket, and one row of summary."""
    spark = state.identities.sparkSession
    state.identities.write.partitionBy("bucket").parquet(f"{path}/identities")
    summary = {k: getattr(state, k) for k in ("bucket_count", "rows", "groups", "witnesses", "first", "last")}
    spark.createDataFrame([(json.dumps(summary, sort_keys=True, default=str),)], "value string").write.text(f"{path}/summary")


def load(spark: SparkSession, path: str) -> State:
    """A saved state, checked before it is returned."""
    summary = json.loads(spark.read.text(f"{path}/summary").first()["value"])
    if summary["groups"]:
        identities = spark.read.schema("identity bigint, bucket int").parquet(f"{path}/identities").select("bucket", "identity")
    else:
        identities = spark.createDataFrame([], "bucket int, identity bigint")
    return State(identities=identities, **summary).validate()
