"""Near-duplicate documents by Order MinHash with alignment.

A document is its sequence of five-word shingles, each labelled with how often it has
occurred before. One Order MinHash value takes the ``PICKS`` labelled shingles that are least
under a hash function, in text order, so it agrees with a probability that follows edit
similarity rather than overlap alone. ``ROWS`` values make a band; documents that share a
band are candidates, and a banded alignment of their shingles decides: aligned shingles over
all shingles of the two must reach ``SIMILARITY``.

Exact copies are classes from the start, and only classes are compared. Within a band every
member is compared with the band's centre, the member whose bands are fullest, never all with
all. Where that leaves a band in several components, members of different components still
meet unless what is known from the centre rules a link out: two texts share at most what both
share with the centre, and of the rest only shingles that some other text compared with this
centre has too; and their Jaccard distances obey the triangle inequality. Both are bounds of
the alignment, so no link between candidates is lost, and a group of near copies costs about
its size.

At SIMILARITY two documents share a band with probability over 0.999.

Defined results: a null text is its own class and is kept; texts without a word are compared as
exact copies only; a text under five words is one shingle; a very long text is hashed and aligned
whole, a few hash functions at a time; class_id is the least doc_id of the
group, null only if all its ids are null; rows that repeat id and text get equal rows; empty
tables give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm._common import cut, lookup, small, small_batches, words
from weirflow.llm.components import components
from weirflow.llm.sharding import number

SHINGLE = 5
SIMILARITY = 0.8
PICKS, ROWS, BANDS = 2, 3, 32
#: Digests of documents are broadcast below this many rows of some 50 bytes; beyond it they are joined.
BROADCAST_DIGESTS = 100_000
#: Members that a copy of their centre's words is sent to.
MEMBERS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def labelled_shingles(word_hashes: np.ndarray) -> np.ndarray:
    """The shingles of a text in order, as 64-bit values that are distinct within the text."""
    w = word_hashes.astype(np.int64).astype(np.uint64)
    if not len(w):
        return w
    k = min(SHINGLE, len(w))
    s = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        s = _mix(s * np.uint64(31) + w[i : len(w) - k + 1 + i])
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    new = np.r_[True, ranked[1:] != ranked[:-1]]
    if not new.all():
        at = np.arange(len(s))
        occurrence = np.empty(len(s), np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        s = np.where(occurrence > 0, _mix(s + occurrence * np.uint64(0x9E3779B97F4A7C15)), s)
    return s


def _functions() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)
    odd = lambda salt: (_mix(n * np.uint64(salt)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return odd(0x51ED270B)[:, None], odd(0x2545F491)[:, None]


_A, _B = _functions()


def bands(s: np.ndarray) -> np.ndarray:
    """The band keys of a text's labelled shingles."""
    if not len(s):
        return np.zeros(0, np.int64)
    low = (s >> np.uint64(7)).astype(np.uint32)
    values = []
    for at in range(0, len(_A), max(1, 2_000_000 // len(s))):  # a long text takes a few functions at a time
        part = slice(at, at + max(1, 2_000_000 // len(s)))
        x = low[None, :] * _A[part]
        x ^= x >> np.uint32(15)
        x *= _B[part]
        rows = np.arange(len(x))
        picks = []
        for _ in range(min(PICKS, len(s))):
            best = x.argmin(axis=1)
            picks.append(best)
            x[rows, best] = np.uint32(0xFFFFFFFF)
        in_order = np.sort(np.stack(picks, axis=1), axis=1)
        value = np.zeros(len(x), np.uint64)
        for column in in_order.T:
            value = _mix(value * np.uint64(31) + s[column])
        values.append(value)
    value = np.concatenate(values).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in value.T:
        key = _mix(key * np.uint64(31) + column)
    return key.astype(np.int64)


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(common, aligned): labelled shingles that two texts share, and those on the best alignment.

    The alignment keeps to the diagonals that SIMILARITY leaves open, and is only made where
    the shared shingles could reach it; elsewhere aligned is 0.
    """
    if not len(a) or not len(b):
        return 0, 0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both, common = len(a) + len(b), len(ia)
    if common < SIMILARITY * (both - common):
        return common, 0
    band = both * (1 - 2 * SIMILARITY / (1 + SIMILARITY))
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    near = np.abs(ia - ib) <= band
    chain = ib[near]
    if len(chain) < 2 or (np.diff(chain) > 0).all():
        return common, len(chain)
    from bisect import bisect_left

    tails: list[int] = []
    for j in chain.tolist():
        at = bisect_left(tails, j)
        tails[at : at + 1] = [j]
    return common, len(tails)


def _lists(column: pa.ChunkedArray | pa.Array) -> Iterator[np.ndarray]:
    """Each list of a column as a view of its values."""
    ends = column.offsets.to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    return (values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [bands(labelled_shingles(w)) for w in _lists(batch.column("w"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), batch.column("doc_id"), pa.array(keys, pa.list_(pa.int64()))], ["digest", "doc_id", "bands"]
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by centre, and a centre's own row, which has no b, before those of its members."""
    centre, sx = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b, shared, sizes_a, sizes_b, link, rest = ([] for _ in range(7))
        for x, y, w in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), _lists(batch.column("w")), strict=True):
            s = labelled_shingles(w)
            if y is None:
                centre, sx = x, s
                continue
            if x != centre:
                raise ValueError("a member came without its centre")
            common, on = aligned(sx, s)
            both = len(sx) + len(s)
            for column, value in zip((a, b, shared, sizes_a, sizes_b), (x, y, common, len(sx), len(s)), strict=True):
                column.append(value)
            link.append(both > 0 and on >= SIMILARITY * (both - on))
            rest.append(np.setdiff1d(s, sx, assume_unique=True).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in (a, b, shared, sizes_a, sizes_b)] + [pa.array(link, pa.bool_()), pa.array(rest, pa.list_(pa.int64()))],
            ["a", "b", "shared", "size_a", "size_b", "link", "rest"],
        )


def _word_hashes(docs: DataFrame) -> DataFrame:
    """(digest, doc_id, w) of the rows that have a text."""
    return docs.where("text IS NOT NULL").select(
        F.unhex(F.md5("text")).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"),
        F.transform(words(F.col("text")), lambda x: F.hash(x)).alias("w"),
    )


def _compare(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs of nodes (a, b), by their texts: shared shingles, sizes, whether they link, and b's ``rest``, which a lacks."""
    spark = docs.sparkSession
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = cut(texts.join(ends, "node").select("digest", "node", "rep"))
    rows = wanted.count()
    # one row of each class carries the words; repeats of that very row are dropped
    chosen = _word_hashes(docs).join(
        small(wanted.withColumnRenamed("digest", "g"), rows, BROADCAST_DIGESTS),
        (F.col("digest") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("rep")),
    )
    held = cut(chosen.select("node", "w").dropDuplicates(["node"]))
    sizes = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / MEMBERS)).cast("int")
    dealt = cut(lookup(pairs, sizes, "a", sizes.count()).select("a", "b", part.alias("part")))
    members = dealt.join(held.select(F.col("node").alias("b"), "w"), "b").select("a", "part", "b", "w")
    centres = dealt.select("a", "part").distinct().join(held.select(F.col("node").alias("a"), "w"), "a")
    stream = members.unionByName(centres.withColumn("b", F.lit(None).cast("long")))
    with small_batches(spark):
        by_centre = stream.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
        return cut(
            by_centre.select("a", "b", "w").mapInArrow(_verify, "a long, b long, shared long, size_a long, size_b long, link boolean, rest array<long>")
        )


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, edges): a node for each distinct text (digest, rep, node), and verified links (a, b)
    whose components are those of all links between candidates."""
    spark = docs.sparkSession
    with small_batches(spark):
        sketched = cut(_word_hashes(docs).mapInArrow(_sketch, "digest binary, doc_id long, bands array<long>"))
    distinct = sketched.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    numbered, _ = number(distinct, ["digest"], ["digest"], "node")
    texts = cut(numbered)
    keys = texts.select("node", F.explode("bands").alias("key"))
    full = cut(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    n_bands = full.count()
    inside = cut(lookup(keys, full, "key", n_bands))
    fullness = inside.groupBy("node").agg(F.sum("n").alias("fullness"))
    centre = cut(
        inside.select("key", "node").join(fullness, "node").groupBy("key").agg(F.max(F.struct("fullness", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    )
    members = cut(lookup(inside.select("key", "node"), centre, "key", n_bands).where("node <> centre"))
    texts = texts.select("digest", "rep", "node")
    tested = _compare(docs, texts, cut(members.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()))
    edges = tested.where("link").select("a", "b")
    more = _open_pairs(members, tested, components(edges))
    if not more.isEmpty():
        edges = edges.union(_compare(docs, texts, more).where("link").select("a", "b"))
    return texts, edges


def _open_pairs(members: DataFrame, tested: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b) of one band and different components that the comparisons with its centre leave open."""
    n_labels = label.count()
    of_centre = label.select(F.col("node").alias("centre"), F.col("label").alias("main"))
    named = (
        lookup(cut(lookup(members, label, "node", n_labels, "left")), of_centre, "centre", n_labels, "left")
        .select("key", "centre", "node", F.coalesce("label", "node").alias("label"), F.coalesce("main", "centre").alias("main"))
    )
    stray = cut(named.where("label <> main"))
    several = cut(stray.select("key").distinct())
    named = cut(lookup(cut(named), several, "key", several.count()))
    # of what a text has and its centre lacks, the part that another text has too
    compared = named.select("centre", "node").distinct()
    facts = tested.select(F.col("a").alias("centre"), F.col("b").alias("node"), "shared", "size_a", "size_b", "rest").join(compared, ["centre", "node"])
    lonely = (
        facts.select("centre", "node", F.explode("rest").alias("shingle"))
        .groupBy("centre", "shingle")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"))
        .where("n = 1")
        .groupBy("centre", "node")
        .agg(F.count(F.lit(1)).alias("own"))
    )
    known = cut(
        facts.select("centre", "node", "shared", "size_a", "size_b")
        .join(lonely, ["centre", "node"], "left")
        .select(
            "centre", "node", "shared", F.col("size_b").alias("size"),
            (F.col("size_b") - F.col("shared") - F.coalesce("own", F.lit(0).cast("long"))).alias("loose"),
            (1 - F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("distance"),
        )
    )
    part = SIMILARITY / (1 + SIMILARITY)  # of both sizes, that a link must align
    rows = cut(named.join(known, ["centre", "node"]).drop("centre"))
    least = cut(rows.groupBy("key").agg(F.min("size").alias("least")))
    # no partner in its band is small enough for what it can share
    able = F.col("shared") + F.col("loose") + 1e-6 >= part * (F.col("size") + F.col("least"))
    rows = cut(lookup(rows, least, "key", least.count()).where(able).drop("least"))  # cut, so that adaptive execution can split a full band
    s = rows.where("label <> main").select("key", *[F.col(c).alias(f"s_{c}") for c in ("node", "label", "shared", "size", "loose", "distance")])
    m = rows.select("key", F.col("main"), *[F.col(c).alias(f"m_{c}") for c in ("node", "label", "shared", "size", "loose", "distance")])
    most = F.least("s_shared", "m_shared") + F.least("s_loose", "m_loose")
    open_ = (
        (s["key"] == m["key"])
        & (F.col("s_label") != F.col("m_label"))
        & ((F.col("m_label") == F.col("main")) | (F.col("s_node") < F.col("m_node")))
        & (most + 1e-6 >= part * (F.col("s_size") + F.col("m_size")))
        & (F.abs(F.col("s_distance") - F.col("m_distance")) <= 1 - SIMILARITY + 1e-9)
    )
    return cut(s.join(m, open_).select(F.least("s_node", "m_node").alias("a"), F.greatest("s_node", "m_node").alias("b")).distinct())


def classes(docs: DataFrame) -> DataFrame:
    """(digest, copy_of, class_id): for every distinct text the least id of its copies and of its group."""
    texts, edges = links(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")))
    label = components(edges)
    n_labels = label.count()
    grouped = cut(lookup(texts, label, "node", n_labels, "left").select("digest", "rep", "label"))
    linked = grouped.where("label IS NOT NULL")
    least = cut(linked.groupBy("label").agg(F.min("rep").alias("class_id")))
    alone = grouped.where("label IS NULL").select("digest", F.col("rep").alias("copy_of"), F.col("rep").alias("class_id"))
    return cut(lookup(linked, least, "label", n_labels).select("digest", F.col("rep").alias("copy_of"), "class_id").union(alone))


def op1_rows(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, copy_of, kept; one row per document."""
    found = classes(docs)
    light = docs.select(F.col("doc_id").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"))
    joined = light.join(found, "digest", "left")
    alone = F.col("digest").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        (alone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group, with its own columns only; documents without a text stay.

    What goes is told to the texts, not what stays: it is the smaller side. Only rows that
    repeat id and text are brought together, if there are any.
    """
    found = classes(docs)
    key = ["digest", "doc_id"]
    light = cut(docs.where("text IS NOT NULL").select(F.unhex(F.md5("text")).alias("digest"), F.col("doc_id").alias("doc_id")))
    gone = cut(light.join(found, "digest").where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(*key))
    twice = cut(light.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key))

    def by_key(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
        side = small(other.withColumnsRenamed({"digest": "g", "doc_id": "d"}), other.count(), BROADCAST_DIGESTS)
        return df.join(side, (F.col("digest") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("d")), how)

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wrapped = docs.select(row.alias("row"), F.col("doc_id").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"))
    kept = by_key(wrapped, gone, "left_anti")
    if not twice.isEmpty():
        kept = by_key(kept, twice, "left_anti").union(by_key(kept, twice, "left_semi").dropDuplicates(key))
    return kept.select("row.*")
