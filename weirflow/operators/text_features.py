"""Text features: TF-IDF, hashing, character embeddings, n-gram scoring, and similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.contracts import ContractError
from weirflow.functions.scalars import sigmoid

#: A word of a text: two word characters or more.
WORD = r"(?U)\b\w\w+\b"

#: A small side of a pairwise product is broadcast below this many rows.
BROADCAST_ROWS = 10_000


def tokens(text: Column, lowercase: bool = True, ngram_range: tuple[int, int] = (1, 1), stop_words: Sequence[str] = ()) -> Column:
    """Words of a text, then their n-grams joined by spaces."""
    lowest, highest = ngram_range
    if not 1 <= lowest <= highest:
        raise ContractError("ngram_range must rise from 1")
    words = F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(WORD), 0)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    if (lowest, highest) == (1, 1):
        return words

    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        joined = F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(n) for n in range(lowest, highest + 1)])


#: Characters of the texts that are weighed together, which bounds a Python worker.
BUCKET_CHARS = 1 << 23


def _counted(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Different ids and terms, and each pair of them that occurs, as places of both, with its count."""
    lists = rows.column("terms").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy()
    terms = pc.dictionary_encode(lists.values[ends[0] : ends[-1]])
    ids = rows.column("id").combine_chunks()
    ids = pc.dictionary_encode(ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids, null_encoding="encode")
    row = np.repeat(ids.indices.to_numpy(), np.diff(ends)).astype(np.int64)
    pairs, tf = np.unique(row * max(len(terms.dictionary), 1) + terms.indices.to_numpy(), return_counts=True)
    return ids.dictionary, terms.dictionary, *np.divmod(pairs, max(len(terms.dictionary), 1)), tf


def _bucket_terms(rows: pa.Table) -> pa.Table:
    """A bucket's terms with the ids that hold each and its occurrences."""
    _, terms, _, term, tf = _counted(rows)
    total = np.bincount(term, weights=tf, minlength=len(terms)).astype(np.int64)
    b = pa.array(np.full(len(terms), rows.column("b")[0].as_py(), np.int64))
    return pa.table({"b": b, "term": terms, "df": pa.array(np.bincount(term, minlength=len(terms))), "total": pa.array(total)})


def _bucket_weights(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """The weights of a bucket's terms, given the idf of those that count."""
    if not rows.num_rows:
        return pa.table({"id": rows.column("id"), "term": pa.array([], pa.string()), "tf": pa.array([], pa.int64()), "weight": pa.array([], pa.float64())})
    ids, terms, row, term, tf = _counted(rows)
    place = pc.fill_null(pc.index_in(terms, asked.column("term").combine_chunks()), -1).to_numpy()[term]
    row, term, tf, place = (x[place >= 0] for x in (row, term, tf, place))
    raw = tf * asked.column("idf").to_numpy()[place]
    length = np.sqrt(np.bincount(row, weights=raw * raw, minlength=len(ids)))
    return pa.table({"id": ids.take(pa.array(row)), "term": terms.take(pa.array(term)), "tf": pa.array(tf), "weight": pa.array(raw / length[row])})


def tfidf(df: DataFrame, id_col: str = "row_id", text_col: str = "text", max_features: int | None = None, **options) -> DataFrame:
    """(id, term, tf, weight): counts times ``ln((1+n)/(1+df)) + 1``, each row of length 1.

    ``max_features`` keeps the terms that occur most, in alphabetical order among equals.
    Texts move once, into buckets by id. A bucket counts its terms and asks for the idf of each
    once, so what moves by term is a bucket's terms, not those of every row; rows without a term
    have no output.
    """
    n, chars = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()
    bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(chars // BUCKET_CHARS + 1))
    texts = df.select(bucket.alias("b"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).repartition("b")
    rows = texts.select("b", "id", F.coalesce(tokens(F.col("text"), **options), F.array().cast("array<string>")).alias("terms"))
    held = rows.groupBy("b").applyInArrow(_bucket_terms, "b long, term string, df long, total long")
    terms = held.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    if max_features is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(max_features)
    idf = terms.select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    asked = held.select("b", "term").join(idf, "term")
    kind = df.schema[id_col].dataType.simpleString()
    out = rows.groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(_bucket_weights, f"id {kind}, term string, tf long, weight double")
    return out.withColumnRenamed("id", id_col)


def murmur3(words: Sequence[bytes]) -> np.ndarray:
    """The published 32-bit hash MurmurHash3 x86 with seed 0, signed, of many words at once."""
    out = np.zeros(len(words), np.uint32)
    sizes = np.array([len(w) for w in words])
    c1, c2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    rotated = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        whole = -(-int(size) // 4) * 4
        table = np.frombuffer(b"".join(words[i].ljust(whole, b"\0") for i in at), "<u4").reshape(len(at), whole // 4)
        h = np.zeros(len(at), np.uint32)
        for n, block in enumerate(table.T):
            k = rotated(block * c1, 15) * c2
            h ^= k
            if 4 * (n + 1) <= size:
                h = rotated(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(size)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        out[at] = h ^ (h >> np.uint32(16))
    return out.astype(np.int32)


def unit_vectors(n: int, size: int, row: np.ndarray, slot: np.ndarray, value: np.ndarray) -> pa.StructArray:
    """Sparse vectors of length 1, as Spark stores them, from sums of values by row and slot; none of the slots is 0."""
    keys, back = np.unique(row * size + slot, return_inverse=True)
    sums = np.bincount(back, weights=value, minlength=len(keys))
    keys, sums = keys[sums != 0], sums[sums != 0]
    row, slot = keys // max(size, 1), keys % max(size, 1)
    length = np.sqrt(np.bincount(row, weights=sums * sums, minlength=n))
    ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    indices = pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32)))
    values = pa.ListArray.from_arrays(ends, pa.array(sums / length[row]))
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, values], ["type", "size", "indices", "values"])


def hashing_vectorizer(df: DataFrame, text_col: str = "text", n_features: int = 4096, output: str = "features", **options) -> DataFrame:
    """Term counts hashed into ``n_features`` slots, each row of length 1.

    A term's slot is the absolute value of its hash modulo the slots; where the hash is
    negative it counts -1, so that terms which share a slot tend to cancel out.
    """

    @F.arrow_udf(VectorUDT())
    def hashed(rows: pa.Array) -> pa.Array:
        # each word of a batch is hashed once, and only those become Python objects
        ends = rows.offsets.to_numpy()
        coded = pc.dictionary_encode(rows.values[ends[0] : ends[-1]])
        h = murmur3([t.encode() for t in coded.dictionary.to_pylist()]).astype(np.int64)
        code = coded.indices.to_numpy()
        row = np.repeat(np.arange(len(rows)), np.diff(ends))
        return unit_vectors(len(rows), n_features, row, (np.abs(h) % n_features)[code], np.where(h >= 0, 1.0, -1.0)[code])

    return df.withColumn(output, hashed(tokens(F.coalesce(F.col(text_col), F.lit("")), **options)))


def embedding(df: DataFrame, text_col: str = "text", dimensions: int = 16, output: str = "embedding") -> DataFrame:
    """Counts of a text's lower-case characters by code point modulo ``dimensions``, of length 1.

    Arrow batches: counting into slots has no array function that passes a text once.
    """
    if dimensions < 1:
        raise ContractError("dimensions must be positive")

    @F.pandas_udf("array<double>")
    def counted(texts: pd.Series) -> pd.Series:
        def one(utf32: bytes) -> np.ndarray:
            v = np.bincount(np.frombuffer(utf32, ">u4") % dimensions, minlength=dimensions).astype(float)
            n = np.sqrt(v @ v)
            return v / n if n else v

        return texts.map(one)

    return df.withColumn(output, counted(F.encode(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "UTF-32")))


#: Vectors that meet at once: a task makes the pairs of two blocks in one go.
BLOCK = 512


def _blocks(df: DataFrame, id_col: str, vector_col: str, side: str) -> DataFrame:
    """A row for each block of vectors: their ids and values, and the size of each, -1 where a vector or a part of it is null."""
    v = F.col(vector_col)
    whole = F.coalesce(~F.exists(v, lambda x: x.isNull()), F.lit(False))
    size, values = F.when(whole, F.size(v)).otherwise(-1), F.when(whole, v.cast("array<double>")).otherwise(F.array().cast("array<double>"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                ids, sizes, vectors = batch.slice(at, BLOCK).columns
                ends = vectors.offsets.to_numpy()
                flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
                one = pa.array([0, len(ids)], pa.int32())
                columns = [pa.ListArray.from_arrays(one, ids), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes.to_numpy().astype(np.int64), flat))]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "sizes", "flat"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), size, values).mapInArrow(packed, f"ids array<{kind}>, sizes binary, flat binary")
    return rows.toDF(*(f"{side}_{c}" for c in rows.columns))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every pair of two blocks; null where sizes differ or a vector has no length."""

    def read(batch: pa.RecordBatch, k: int, side: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.frombuffer(batch.column(f"{side}_sizes")[k].as_buffer(), np.int64)
        return batch.column(f"{side}_ids")[k].values, sizes, np.append(0, np.cumsum(np.maximum(sizes, 0))), np.frombuffer(batch.column(f"{side}_flat")[k].as_buffer())

    for batch in batches:
        for k in range(batch.num_rows):
            (a_ids, a_sizes, a_at, a), (b_ids, b_sizes, b_at, b) = read(batch, k, "left"), read(batch, k, "right")
            out, known = np.zeros((len(a_ids), len(b_ids))), np.zeros((len(a_ids), len(b_ids)), bool)
            for size in np.intersect1d(a_sizes[a_sizes > 0], b_sizes):
                i, j = np.flatnonzero(a_sizes == size), np.flatnonzero(b_sizes == size)
                x, y = (v[at[w, None] + np.arange(size)] for v, at, w in ((a, a_at, i), (b, b_at, j)))
                with np.errstate(all="ignore"):
                    lengths = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))
                    out[np.ix_(i, j)] = np.where(lengths == 0, 0.0, x @ y.T / np.where(lengths == 0, 1.0, lengths))
                known[np.ix_(i, j)] = lengths != 0
            left = a_ids.take(pa.array(np.repeat(np.arange(len(a_ids)), len(b_ids))))
            right = b_ids.take(pa.array(np.tile(np.arange(len(b_ids)), len(a_ids))))
            yield pa.RecordBatch.from_arrays([left, right, pa.array(out.ravel(), mask=~known.ravel())], ["left_id", "right_id", "similarity"])


def _pairs(left: DataFrame, right: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(left_id, right_id, similarity) of every pair, as the operation asks for the full matrix; the left side is sent out if it is small."""
    few = left.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    a, b = _blocks(left, id_col, vector_col, "left"), _blocks(right, id_col, vector_col, "right")
    b = b.repartition(4 * right.sparkSession.sparkContext.defaultParallelism)
    kinds = (d.schema[id_col].dataType.simpleString() for d in (left, right))
    met = b.crossJoin(F.broadcast(a) if few else a)
    return met.mapInArrow(_cosines, "left_id {}, right_id {}, similarity double".format(*kinds))


def similarity(left: DataFrame, right: DataFrame | None = None, id_col: str = "row_id", vector_col: str = "vector") -> DataFrame:
    """(left_id, right_id, similarity) by cosine; 0 where a vector has no length."""
    return _pairs(left, left if right is None else right, id_col, vector_col).fillna(0.0, "similarity")


def _check_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[int | None, bool]:
    v = F.col(vector_col)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | x.cast("double").isin(float("inf"), float("-inf")))
    r = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("ids"), F.count_if(F.col(id_col).isNull() | (F.col(id_col).cast("string") == "")).alias("no_id"),
        F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high"), F.count_if(v.isNull() | F.coalesce(odd, F.lit(True))).alias("odd"),
    ).first()
    if r["no_id"] or r["ids"] != r["n"]:
        raise ContractError("row ids must be unique and not empty")
    if r["odd"]:
        raise ContractError("vectors must hold finite numbers")
    if r["low"] != r["high"]:
        raise ContractError("vectors must share one dimension")
    return r["low"], bool(r["n"])


def cosine_similarity_matrix(left: DataFrame, right: DataFrame, id_col: str = "row_id", vector_col: str = "vector") -> DataFrame:
    """(left_id, right_id, similarity); null where either vector has no length."""
    (a, some), (b, more) = (_check_vectors(d, id_col, vector_col) for d in (left, right))
    if some and more and a != b:
        raise ContractError("vectors must share one dimension")
    return _pairs(left, right, id_col, vector_col)


#: Character n-grams inside words: fixed values.
NGRAM_MIN, NGRAM_MAX = 2, 4


def char_wb_ngrams(text: Column) -> Column:
    """n-grams inside each word padded by spaces; a padded word no longer than n gives itself once."""
    collapsed = F.regexp_replace(F.lower(text), r"(?U)\s{2,}", " ")
    words = F.filter(F.split(collapsed, r"(?U)\s+"), lambda w: w != "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        size = F.length(padded)
        none = F.array().cast("array<string>")

        def grams(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
            cut = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
            # once a size has taken the whole word, larger ones add nothing
            return cut if n == NGRAM_MIN else F.when(size > n - 1, cut).otherwise(none)

        return F.concat(*[grams(n) for n in range(NGRAM_MIN, NGRAM_MAX + 1)])

    return F.flatten(F.transform(words, of))


def _word_ngrams(word: str) -> list[str]:
    """``char_wb_ngrams`` of one word."""
    padded = f" {word} "
    sizes = [n for n in range(NGRAM_MIN, NGRAM_MAX + 1) if n == NGRAM_MIN or len(padded) > n - 1]
    return [padded[i : i + n] for n in sizes for i in range(max(len(padded) - n + 1, 1))]


def char_wb_score(df: DataFrame, features: Sequence[Mapping], intercept: float, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id, score): logistic score of character n-grams under a small fixed model.

    ``features`` has feature, idf and coefficient. Weights are ``(1 + ln tf) * idf``, of
    length 1 over the model's features. The model is sent to all tasks; its size is the
    caller's parameter, not data.
    """
    names = [f["feature"] for f in features]
    if len(set(names)) != len(names):
        raise ContractError("duplicate feature token")
    if not all(isinstance(n, str) for n in names):
        raise ContractError("feature token must be a string")
    numbers = [intercept, *(f[k] for f in features for k in ("idf", "coefficient"))]
    if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in numbers):
        raise ContractError("model numbers must be finite")
    spark = df.sparkSession
    model = spark.createDataFrame([(k, float(f["idf"]), float(f["coefficient"])) for k, f in enumerate(features)], "k int, idf double, coefficient double")
    place = {name: k for k, name in enumerate(names)}

    @F.arrow_udf("array<struct<k:int,n:bigint>>")
    def found(rows: pa.Array) -> pa.Array:
        # each word of a batch is cut into n-grams once
        ends = rows.offsets.to_numpy()
        coded = pc.dictionary_encode(rows.values[ends[0] : ends[-1]])
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(len(rows)), np.diff(ends))
        own = [[place[g] for g in _word_ngrams(w) if g in place] for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in own], np.int64)
        flat = np.array([k for x in own for k in x], np.int64)
        times = sizes[code]
        first = np.repeat((np.cumsum(sizes) - sizes)[code], times)
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        pairs, n = np.unique(np.repeat(row, times) * max(len(place), 1) + flat[first + step], return_counts=True)
        row, k = np.divmod(pairs, max(len(place), 1))
        counts = pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array(n)], ["k", "n"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32)), counts)

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    counts = df.select(F.col(id_col).alias("id"), F.inline(found(words)))
    known = counts.groupBy("id", "k").agg(F.sum("n").alias("tf")).join(F.broadcast(model), "k")
    weight = (1 + F.log("tf")) * F.col("idf")
    sums = known.groupBy("id").agg(F.sum(weight * F.col("coefficient")).alias("dot"), F.sqrt(F.sum(weight * weight)).alias("length"))
    logit = F.lit(float(intercept)) + F.coalesce(F.col("dot") / F.nullif("length", F.lit(0.0)), F.lit(0.0))
    ids = df.select(F.col(id_col).alias("id"))
    return ids.join(sums, "id", "left").select(F.col("id").alias(id_col), sigmoid(logit).alias("score"))
