import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import sharding


def test_law_slots_and_sizes(docs):
    got = sharding.shard(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.get(k, 0) for k in range(24)) <= 1 and set(counts) <= set(range(24))
    for k, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    key = lambda i, t: (-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in got) == sorted(key(r.doc_id, r.text) for r in rows)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_reruns_and_partitioning_do_not_matter(docs):
    shape = lambda df: sorted(map(str, sharding.shard(df).collect()))
    assert shape(docs) == shape(docs.repartition(7)) == shape(docs.orderBy(F.rand(3)))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 24, 25, 100, 1000, 1024, 4097])
def test_permutation_is_one_to_one_and_inverts(spark, n):
    df = spark.range(n).select("id", sharding.permute(F.col("id"), n, 5).alias("p"))
    df = df.select("id", "p", sharding.unpermute(F.col("p"), n, 5).alias("back"))
    rows = df.collect()
    assert sorted(r.p for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)


def spark_hash(*values):
    """Spark's xxhash64 of longs ('q'), ints ('i') and nulls."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<" + kind, v), h)
    return h - (1 << 64) if h >> 63 else h


def feistel(x, n, seed):
    """The permutation in plain Python."""
    a = 1
    while a * a < n:
        a += 1
    b = -(-n // a)
    while True:
        left, right = x % a, x // a
        for k in range(6):
            if k % 2 == 0:
                left = (left + spark_hash(("q", right), ("q", seed), ("i", k)) % a) % a
            else:
                right = (right + spark_hash(("q", left), ("q", seed), ("i", k)) % b) % b
        x = right * a + left
        if x < n:
            return x


@pytest.mark.parametrize("n, seed", [(1, 0), (7, 0), (1000, 3), (4097, 9)])
def test_places_equal_a_feistel_network_in_python(spark, n, seed):
    got = {r.id: r.p for r in spark.range(n).select("id", sharding.permute(F.col("id"), n, seed).alias("p")).collect()}
    assert got == {x: feistel(x, n, seed) for x in range(n)}


@pytest.mark.parametrize("piece", [2, 65_536])
def test_rows_equal_brute_force(spark, docs, monkeypatch, piece):
    monkeypatch.setattr(sharding, "PIECE", piece)
    many = docs.union(docs.where("doc_id = 9").crossJoin(spark.range(30)).drop("id"))
    keys = []
    for r in many.collect():
        body = (r.text or "").encode()
        key = (r.doc_id, zlib.crc32(body), len(body) + 8)
        keys.append((spark_hash(*(("q", x) for x in key)) % 64, r.doc_id is not None, r.doc_id or 0, *key[1:], key))
    keys.sort(key=lambda x: x[:-1])
    want = []
    for row, (*_, (doc, crc, size)) in enumerate(keys):
        place = feistel(row, len(keys), 0)
        want.append((doc, size, crc, "rows", place % 24, place // 24, None))
    assert sorted(map(str, (tuple(r) for r in sharding.shard(many).collect()))) == sorted(map(str, want))


def test_seed_changes_the_order(spark):
    a, b = (spark.range(500).select(sharding.permute(F.col("id"), 500, s).alias("p")).collect() for s in (1, 2))
    assert a != b and sum(x.p == i for i, x in enumerate(a)) < 20


def test_big_row_numbers_stay_exact(spark):
    n = 3 * 10**15 + 7
    df = spark.range(n - 50, n).select("id", sharding.permute(F.col("id"), n, 1).alias("p")).select("id", "p", sharding.unpermute(F.col("p"), n, 1).alias("back"))
    assert all(r.id == r.back and 0 <= r.p < n for r in df.collect())


def test_empty_table(no_docs):
    assert sharding.shard(no_docs).count() == 0
