import struct

import pytest

from weirflow.operators import replay
from weirflow.operators.replay import RecordError
from weirflow.sources import buckets

PROFILE = {"identity_source_column": "identity", "identity_normalized_column": "norm", "measurement_core_fields": ["price"], "bucket_count": 8}


def state(spark, *ids):
    rows = [(0, i, x, str(x), 1.0) for i, x in enumerate(ids)]
    return replay.canonicalize(spark.createDataFrame(rows, "_file int, _row long, identity long, norm string, price double"), PROFILE)


def test_binary_round_trip(spark):
    s = state(spark, *range(5, 200))
    coded = buckets.encode(s.identities, 8)
    assert sorted(buckets.decode(coded, 8).collect()) == sorted(s.identities.collect())
    payload = bytes(coded.first().payload)
    assert buckets.parse(payload, 8)[1] == sorted(buckets.parse(payload, 8)[1])
    for bad, count in ((payload[:10], 8), (payload[:-1], 8), (payload, 16), (b"X" + payload[1:], 8), (payload[:26] + payload[34:42] + payload[26:34] + payload[42:], 8)):
        with pytest.raises(RecordError):
            buckets.parse(bad, count)
    wrong = spark.createDataFrame([(struct.pack(buckets.HEADER, buckets.MAGIC, 1, 8, (buckets.parse(payload, 8)[0] + 1) % 8, 1) + payload[26:34],)], "payload binary")
    with pytest.raises(Exception, match="another bucket"):
        buckets.decode(wrong, 8).collect()


def test_saved_states_merge(spark, tmp_path):
    buckets.save(state(spark, 1, 2, 3), str(tmp_path / "a"))
    buckets.save(state(spark, 3, 4), str(tmp_path / "b"))
    merged = replay.merge(buckets.load(spark, str(tmp_path / "a")), buckets.load(spark, str(tmp_path / "b")))
    assert (merged.rows, merged.groups) == (4, 4)
    empty = replay.State(8, 0, 0, 1, None, None, spark.createDataFrame([], "bucket int, identity bigint"))
    buckets.save(empty, str(tmp_path / "c"))
    assert replay.merge(buckets.load(spark, str(tmp_path / "c")), merged).groups == 4
