"""Line deduplication across documents, within one edit.

A line is dropped if an earlier line, in order of doc_id and line number, equals it or is one
character away (substituted, added or removed). Lines are compared without the whitespace
around them; blank ones stay. One edit makes another line of a short one, so below
``fuzzy_chars`` characters only exact copies are dropped.

The lines are hashed once; what moves from then on are hashes and places. Two lines within one
edit share a prefix or a suffix of nearly half their length, and of several segments all but the
one with the edit, so only lines that share such hashed parts with another emit their deletion
neighbourhood: the variants with one character of that segment removed, under two kinds of
hashed key. Lines that share a variant and the place of removal differ by a substitution; a line
that equals another's variant differs by a removal. Per key only the earliest line is kept,
never pairs of the group, and the edit distance of each line and its earliest partner is
verified on the texts, character by character.

A line's hash is a sum over its characters of a mix of character and place, so from running
sums every variant and every segment has its key in constant time, whatever the line's length.

Defined results: null text has no lines; null ids come last; rows equal in id and text are one
document and get equal results; a line may be as long as a text, its cost is proportional to its
length; an empty table gives an empty result; other columns are kept by ``dedup`` and may have
any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm._common import bind, cut, lookup, small, small_batches, text_key

#: A line of fewer characters is only compared for equality.
FUZZY_CHARS = 20
#: Lines to fetch or to drop are broadcast below this many rows of some 40 bytes; beyond it they are joined.
BROADCAST_LINES = 200_000
#: Lines whose variants one task makes.
LINES_PER_TASK = 20_000
#: Rows of variants that a task hands on at once.
ROWS_AT_ONCE = 100_000
EDGE = " \t\n\x0b\x0c\r"


def _halves(line: Column) -> dict[str, Column]:
    """Keys of which two lines within one edit share one: a prefix and a suffix of a length
    that lines of eight neighbouring lengths have in common; where the next shorter length
    has another, for that too."""
    n = F.length(line)
    own, less = F.floor(n / 8).cast("int") * 4, F.floor((n - 1) / 8).cast("int") * 4
    head = lambda h: F.xxhash64(F.substring(line, F.lit(1), h), h, F.lit("a"))
    tail = lambda h: F.xxhash64(F.substring(line, n - h + 1, h), h, F.lit("z"))
    return {"a1": head(own), "z1": tail(own), "a2": F.when(n % 8 == 0, head(less)), "z2": F.when(n % 8 == 0, tail(less))}


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"), F.split(F.col("text"), "\n").alias("raw"))


def hashed_lines(docs: DataFrame, min_chars: int = 1, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """(doc_id, key, ln, h1, h2, a1, z1, a2, z2) of every line that takes part, frozen."""
    # the key is made first: beside a generator it would be made, and the text carried, for every line
    each = _keyed(docs).select("doc_id", "key", F.posexplode("raw").alias("ln", "line")).withColumn("line", F.btrim("line", F.lit(EDGE)))
    line = F.col("line")
    long = F.length(line) >= max(fuzzy_chars, 8)
    return cut(
        each.where(F.length(line) >= max(min_chars, 1)).select(
            "doc_id", "key", "ln", F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2"),
            *[F.when(long, c).alias(k) for k, c in _halves(line).items()],
        )
    )


#: Salts of the two halves of a 128-bit key.
_SALTS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Running sums of a line's hash: ``own`` with each character at its place, ``moved`` one place
    to the left, both from 0 and for both salts."""

    def __init__(self, utf32: bytes):
        codes = np.frombuffer(utf32, ">u4").astype(np.uint64)
        self.size = len(codes)
        at = np.arange(self.size, dtype=np.uint64)
        sums = lambda place, salt: np.concatenate(([np.uint64(0)], np.cumsum(_mix((codes << np.uint64(40)) + place * salt + salt), dtype=np.uint64)))
        self.own = [sums(at, s) for s in _SALTS]
        self.moved = [sums(at - np.uint64(1), s) for s in _SALTS]

    def variants(self, places: np.ndarray) -> list[np.ndarray]:
        """Keys of the line without the character at each place."""
        return [o[places] + (m[-1] - m[places + 1]) for o, m in zip(self.own, self.moved, strict=True)]

    def segments(self, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """For the line read as one of ``size`` characters, its own number or one less: keys of
        all that stands around each segment, and the places (first, past the last) inside it."""
        n = max(8, isqrt(size) // 2)
        border = np.arange(n + 1) * size // n
        head, tail = border[:-1], size - border[1:]
        after = self.size - tail
        kept = [o[head] + ((o if size == self.size else m)[-1] - (o if size == self.size else m)[after]) for o, m in zip(self.own, self.moved, strict=True)]
        tag = np.arange(n, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(size)
        return [_mix(k + _mix(tag ^ s)) for k, s in zip(kept, _SALTS, strict=True)], head, after


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64), pa.int64())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, k1, k2, first, past) of every segment of every line, for its size and the next shorter one."""
    for batch in batches:
        found: list[tuple] = []
        for rank, utf32 in zip(batch.column("rank").to_pylist(), batch.column("utf32"), strict=True):
            line = Hashed(utf32.as_py())
            for size in (line.size, line.size - 1):
                (k1, k2), first, past = line.segments(size)
                found.append((np.full(len(k1), rank), k1, k2, first, past))
        if found:
            yield pa.RecordBatch.from_arrays([_longs(np.concatenate(c)) for c in zip(*found, strict=True)], ["rank", "k1", "k2", "first", "past"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, k1, k2, kind): kind 0 is a variant and its place, 1 the line itself, 2 a variant anywhere."""
    for batch in batches:
        for rank, utf32, ranges in zip(batch.column("rank").to_pylist(), batch.column("utf32"), batch.column("ranges").to_pylist(), strict=True):
            line = Hashed(utf32.as_py())
            places = np.unique(np.concatenate([np.arange(r["first"], r["past"]) for r in ranges]))
            keys = line.variants(places)
            placed = [_mix(k + _mix(places.astype(np.uint64) + s)) for k, s in zip(keys, _SALTS, strict=True)]
            k1, k2 = (np.concatenate((p, [o[-1]], k)) for p, o, k in zip(placed, line.own, keys, strict=True))
            kind = np.concatenate((np.zeros(len(places), np.int64), [1], np.full(len(places), 2)))
            for at in range(0, len(kind), ROWS_AT_ONCE):
                some = slice(at, at + ROWS_AT_ONCE)
                yield pa.RecordBatch.from_arrays(
                    [_longs(np.full(len(kind[some]), rank)), _longs(k1[some]), _longs(k2[some]), _longs(kind[some])], ["rank", "k1", "k2", "kind"]
                )


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one edit at most turns a line into the other: what follows the first difference must agree."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    unlike = a[:n] != b[:n]
    at = int(unlike.argmax()) if unlike.any() else n
    return bool(np.array_equal(a[at + (len(a) >= len(b)) :], b[at + (len(b) >= len(a)) :]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ranks of the pairs of texts that are within one edit; ``levenshtein`` takes the square of their length."""
    codes = lambda x: np.frombuffer(x.as_py(), ">u4")
    for batch in batches:
        near = [within_one(codes(a), codes(b)) for a, b in zip(batch.column("utf32"), batch.column("said"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("rank").filter(pa.array(near, pa.bool_()))], ["rank"])


def _same_document() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))


def _fetched(docs: DataFrame, ranked: DataFrame, rows: int) -> DataFrame:
    """(rank, line) of ranked places (rank, doc_id, key, ln): only those lines leave their texts."""
    by_doc = ranked.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("ln", "rank")).alias("asked"))
    held = _keyed(docs).join(small(by_doc, rows, BROADCAST_LINES), _same_document())
    picked = bind(F.col("raw"), lambda raw: F.transform("asked", lambda x: F.struct(x["rank"].alias("rank"), F.btrim(F.get(raw, x.ln), F.lit(EDGE)).alias("line"))))
    tasks = max(rows // LINES_PER_TASK, docs.sparkSession.sparkContext.defaultParallelism)
    return cut(held.select(F.explode(picked).alias("x")).select("x.*").repartition(tasks, "rank").dropDuplicates(["rank"]))


def repeated(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(h1, h2, fuzzy) of the distinct lines that occur more than once or, fuzzy, have an earlier
    line one edit away. ``lines`` are the hashed lines of ``docs``."""
    half = ("a1", "z1", "a2", "z2")
    # only longs are aggregated, so this stays a hash aggregate; a line's halves are alike wherever it occurs
    distinct = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), *[F.min(k).alias(k) for k in half]))
    halves = distinct.select("h1", "h2", F.explode(F.array(*half)).alias("half")).where("half IS NOT NULL")
    shared = cut(halves.groupBy("half").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1").select("half"))
    near = cut(lookup(halves, shared, "half", shared.count(), limit=BROADCAST_LINES).select("h1", "h2").distinct())
    rows = near.count()
    many = distinct.where("n > 1").select("h1", "h2")
    if rows == 0:
        return many.withColumn("fuzzy", F.lit(False))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "ln")
    first = lookup(lines.select("doc_id", "key", "ln", "h1", "h2"), near, ["h1", "h2"], rows, limit=BROADCAST_LINES).groupBy("h1", "h2").agg(F.min(place).alias("p"))
    # the sort deals places out by range, so these ids ascend with the place
    ranked = cut(first.orderBy("p").select(F.monotonically_increasing_id().alias("rank"), "h1", "h2", "p.doc_id", "p.key", "p.ln"))
    texts = _fetched(docs, ranked, rows)
    coded = texts.select("rank", F.encode("line", "UTF-32").alias("utf32"))
    with small_batches(docs.sparkSession):
        parts = cut(coded.mapInArrow(_parts, "rank long, k1 long, k2 long, first long, past long"))
    several = parts.groupBy("k1", "k2").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi")).where("lo < hi").select("k1", "k2")
    several = cut(several)
    ranges = lookup(parts, several, ["k1", "k2"], several.count(), limit=BROADCAST_LINES).select("rank", "first", "past").distinct()
    asked = ranges.groupBy("rank").agg(F.collect_list(F.struct("first", "past")).alias("ranges"))
    tasks = max(rows // LINES_PER_TASK, docs.sparkSession.sparkContext.defaultParallelism)
    with small_batches(docs.sparkSession):
        emitted = cut(coded.join(asked, "rank").repartition(tasks, "rank").mapInArrow(_variants, "rank long, k1 long, k2 long, kind long"))
    of = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("rank")))
    groups = cut(
        emitted.groupBy("k1", "k2").agg(of(0).alias("m0"), of(1).alias("m1"), of(2).alias("m2"), F.min("rank").alias("lo"), F.max("rank").alias("hi"))
        .where("lo < hi").drop("lo", "hi")
    )
    partner = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    pairs = cut(
        lookup(emitted, groups, ["k1", "k2"], groups.count(), limit=BROADCAST_LINES).select("rank", partner.alias("other")).where("other < rank").distinct()
    )
    both = lookup(pairs, coded.select(F.col("rank").alias("other"), F.col("utf32").alias("said")), "other", rows, limit=0).join(coded, "rank")
    with small_batches(docs.sparkSession):
        verified = cut(both.select("rank", "utf32", "said").mapInArrow(_verified, "rank long").distinct())
    fuzzy = ranked.join(verified, "rank", "left_semi").select("h1", "h2")
    told = many.withColumn("fuzzy", F.lit(False)).union(fuzzy.withColumn("fuzzy", F.lit(True)))
    return told.groupBy("h1", "h2").agg(F.max("fuzzy").alias("fuzzy"))


def dropped(docs: DataFrame, min_chars: int = 1, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """(doc_id, key, dropped): for documents that lose lines, their numbers from 0, ascending."""
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    lines = hashed_lines(docs, min_chars, fuzzy_chars)
    told = cut(repeated(docs, lines))
    places = lines.select("doc_id", "key", "ln", "h1", "h2")
    seen = cut(lookup(places, told, ["h1", "h2"], told.count(), limit=BROADCAST_LINES))
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "ln")
    first = cut(seen.where("NOT fuzzy").groupBy("h1", "h2").agg(F.min(place).alias("least")))
    # a fuzzy line goes everywhere, another everywhere but at its first place
    exact = seen.where("NOT fuzzy").withColumn("p", place)
    placed = lookup(exact, first, ["h1", "h2"], first.count(), limit=BROADCAST_LINES).where("p <> least")
    gone = placed.select("doc_id", "key", "ln").union(seen.where("fuzzy").select("doc_id", "key", "ln"))
    return cut(gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("ln")).alias("dropped")))


def _with_dropped(docs: DataFrame, lost: DataFrame, *columns: Column) -> DataFrame:
    lost = lost.withColumnsRenamed({"doc_id": "d", "key": "k"})
    light = docs.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"), *columns)
    return light.join(lost, _same_document(), "left")


def op9_rows(docs: DataFrame, min_chars: int = 1, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers, comma-joined); one row per document."""
    ends = F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    n = F.when(F.col("text").isNull(), 0).otherwise(ends + 1).cast("long")
    lost = F.coalesce("dropped", F.array().cast("array<int>"))
    return _with_dropped(docs, dropped(docs, min_chars, fuzzy_chars), n.alias("n_lines")).select(
        "doc_id", "n_lines", F.size(lost).cast("long").alias("n_dropped"), F.array_join(lost.cast("array<string>"), ",").alias("dropped")
    )


def dedup(docs: DataFrame, min_chars: int = 1, fuzzy_chars: int = FUZZY_CHARS) -> DataFrame:
    """The documents without their dropped lines, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    kept = F.array_join(
        F.filter(F.split(F.col("row.text"), "\n"), lambda x, i: ~F.array_contains(F.coalesce("dropped", F.array().cast("array<int>")), i)), "\n"
    )
    found = _with_dropped(docs, dropped(docs, min_chars, fuzzy_chars), row.alias("row"))
    return found.withColumn("row", F.when(F.col("dropped").isNull(), F.col("row")).otherwise(F.col("row").withField("text", kept))).select("row.*")


#: op9 as SQL: every line that is not blank, by comparing all distinct lines of 20 characters and more that share a half.
ORACLE = r"""
WITH raw AS (
  SELECT doc_id, i::INT AS ln, regexp_replace(string_split(text, chr(10))[i + 1], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line
  FROM documents, unnest(range(len(string_split(text, chr(10))))) AS r(i)
), li AS (SELECT * FROM raw WHERE line <> ''),
f AS (SELECT line, min((doc_id, ln)) AS p FROM li GROUP BY line),
k AS (
  SELECT DISTINCT line, p, unnest([(h, 'a', left(line, h)), (h, 'z', right(line, h))]) AS half
  FROM (SELECT line, p, unnest([length(line) // 2, (length(line) - 1) // 2]) AS h FROM f WHERE length(line) >= 20)
), fuzzy AS (
  SELECT DISTINCT x.line FROM k x JOIN k y ON x.half = y.half AND y.p < x.p WHERE levenshtein(x.line, y.line) = 1
), gone AS (
  SELECT li.doc_id, li.ln FROM li JOIN f USING (line) WHERE (li.doc_id, li.ln) <> f.p OR li.line IN (SELECT line FROM fuzzy)
), g AS (SELECT doc_id, count(*)::BIGINT AS n_dropped, string_agg(ln::VARCHAR, ',' ORDER BY ln) AS dropped FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines,
       coalesce(n_dropped, 0) AS n_dropped, coalesce(dropped, '') AS dropped
FROM documents LEFT JOIN g USING (doc_id)
"""
