"""Benchmark decontamination over a positional inverted index.

Benchmark items are cut into windows of ``width`` consecutive words (a shorter item is one
window). Counts of the benchmark's terms over all training text tell which two terms of a
window are rarest there; only for those is a posting (term, document, position) stored. The
postings, moved back by the term's offset in the window, are intersected: a start that both
lists name is a candidate, and the document's own words decide it. With ``slop`` above 0 the
rarest term names the starts, and a window also matches where every term stands within
``slop`` words of its place.

Matches are keyed by document, so a passage that many documents share makes no hot key there.
The postings of a frequent term share a key: they are joined with the broadcast terms while
those are few, and beyond that by two plain exchanges, which adaptive execution splits. Which
items hold a window is only looked up for the windows that a document holds.

Defined results: null text has no words; a null or wordless item has no window; a null item_id
reads as an empty string; items that share an id count once; rows that share doc_id but not
text are told apart by a hash of the text; repeated rows give repeated results; very long texts
are indexed whole; empty tables give no hits or no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm._common import cut, lookup, small, text_key, words

WIDTH = 8
#: Ids of documents are broadcast below this many rows of two longs; beyond it they are joined.
BROADCAST_IDS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Everything between words: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """The words of a text, case as written."""
    return words(text, BETWEEN)


def fold(word: Column) -> Column:
    """A-Z to lower case, and nothing else."""
    return F.translate(word, UPPER, LOWER)


def item_windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(wid, terms, item): the windows of every item, each once."""
    t = F.col("t")
    starts = F.when(F.size(t) >= width, F.sequence(F.lit(0), F.size(t) - width)).when(F.size(t) > 0, F.array(F.lit(0)))
    folded = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), tokens(fold(F.col("text"))).alias("t")
    )
    cuts = folded.select("item", F.explode(F.transform(starts, lambda i: F.slice(t, i + 1, width))).alias("terms"))
    return cuts.withColumn("wid", F.unhex(F.md5(F.concat_ws(" ", "terms")))).dropDuplicates(["wid", "item"])


def _matching(tokens_table: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """Rows of (…, word) whose folded word is a term, with the term.

    Spark's own lower() finds the term, since equal folded words are equal in lower case;
    the slower exact folding then runs on what is left.
    """
    keyed = small(terms.withColumn("low", F.lower("term")), rows)
    found = tokens_table.withColumn("low", F.lower("word")).join(keyed, "low").drop("low")
    return found.where((F.col("word") == F.col("term")) | (fold(F.col("word")) == F.col("term"))).drop("word")


def term_counts(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """(term, n): occurrences in all documents of each term; terms that never occur are absent."""
    stream = docs.select(F.explode(tokens(F.col("text"))).alias("word"))
    return _matching(stream, terms, rows).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame, rows: int) -> DataFrame:
    """The positional index for ``terms``: (doc_id, key, term, pos)."""
    # the key is made first: beside a generator it would be made, and the text carried, for every word
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("key"), tokens(F.col("text")).alias("t"))
    stream = keyed.select("doc_id", "key", F.posexplode("t").alias("pos", "word"))
    return _matching(stream, terms, rows)


def matches(docs: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, key, n, found): for documents with a match, the word count and its matches.

    ``items`` are the windows of ``item_windows``. ``found`` is an array of (start, length,
    exact, wid). ``key`` is a hash of the text.
    """
    docs = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    wins = cut(items.select("wid", "terms").dropDuplicates(["wid"]))
    placed = wins.select("wid", F.size("terms").alias("len"), F.posexplode("terms").alias("off", "term"))
    vocabulary = cut(placed.select("term").distinct())
    counts = cut(term_counts(docs, vocabulary, vocabulary.count()))
    # a window with a term that training text lacks cannot occur
    ranked = placed.join(counts, "term").groupBy("wid", "len").agg(
        F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("by_n")
    ).where(F.size("by_n") == F.col("len"))
    anchors = F.slice("by_n", 1, 1 if slop else 2)
    anchored = cut(
        ranked.select("wid", F.size(anchors).alias("need"), F.posexplode(anchors).alias("slot", "a")).select(
            "wid", "need", "slot", F.col("a.off").alias("off"), F.col("a.term").alias("term")
        )
    )
    terms = cut(anchored.select("term").distinct())
    index = cut(postings(docs, terms, terms.count()))
    n_anchors = anchored.count()
    first = F.col("pos") - F.col("off")
    starts = F.explode(F.sequence(first - slop, first + slop)) if slop else first
    votes = index.join(small(anchored, n_anchors), "term").select("doc_id", "key", "wid", "need", starts.alias("start"), "slot")
    if not slop:
        votes = votes.where("start >= 0")
    agreed = (
        votes.groupBy("doc_id", "key", "wid", "need", "start")
        .agg(F.bit_or(F.when(F.col("slot") == 0, 1).otherwise(2)).alias("slots"))
        .where(F.bit_count("slots") == F.col("need"))
    )
    n_windows = wins.count()
    by_doc = cut(
        agreed.join(small(wins, n_windows), "wid")
        .groupBy("doc_id", "key")
        .agg(F.collect_list(F.struct("start", "terms", "wid")).alias("c"))
    )
    ids = by_doc.select(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    n_ids = ids.count()
    keyed = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    held = keyed.join(small(ids, n_ids, BROADCAST_IDS), same, "left_semi").dropDuplicates(["doc_id", "key"])
    bare = by_doc.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "c")
    both = held.join(bare, same).select("doc_id", "key", tokens(fold(F.col("text"))).alias("t"), "c")
    t = F.col("t")
    span = lambda x: F.size(x.terms)
    exact = lambda x: (x.start >= 0) & (F.slice(t, F.greatest(x.start, F.lit(0)) + 1, span(x)) == x.terms)

    def near(x: Column) -> Column:
        at = lambda i: F.greatest(x.start + i - slop, F.lit(0))
        return F.forall(
            F.transform(x.terms, lambda w, i: (x.start + i + slop >= 0) & F.array_contains(
                F.slice(t, at(i) + 1, F.greatest(x.start + i + slop + 1 - at(i), F.lit(0))), w)),
            lambda ok: ok,
        )

    found = F.transform(
        F.filter("c", near if slop else exact),
        lambda x: F.struct(
            x.start.alias("start"), span(x).alias("length"), (exact(x) if slop else F.lit(True)).alias("exact"), x.wid.alias("wid")
        ),
    )
    # frozen, or the filter would look for the matches a second time
    decided = cut(both.select("doc_id", "key", F.size(t).alias("n"), found.alias("found")))
    return decided.where(F.size("found") > 0)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, key, n_hit, items): hit words and the sorted ids of matched items, for documents with a match."""
    inside = F.flatten(F.transform("found", lambda x: F.sequence(x.start, x.start + x.length - 1)))
    windows = cut(item_windows(benchmark, width))
    found = cut(
        matches(docs, windows).select(
            "doc_id", "key", F.size(F.array_distinct(inside)).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("found", lambda x: x.wid)).alias("wids"),
        )
    )
    held = cut(found.select("doc_id", "key", "n_hit", F.explode("wids").alias("wid")))
    named = lookup(held, windows.select("wid", "item"), "wid", windows.count())
    return named.groupBy("doc_id", "key", "n_hit").agg(F.array_sort(F.collect_set("item")).alias("items"))


def op6_rows(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per document."""
    sha = lambda items: F.sha2(F.encode(F.array_join(items, ","), "UTF-8"), 256)
    found = hits(docs, benchmark).select("doc_id", "key", "n_hit", F.size("items").cast("long").alias("n_items"), sha(F.col("items")).alias("items_sha256"))
    found = cut(found.withColumnsRenamed({"doc_id": "d", "key": "k"}))
    found = small(found, found.count())
    light = docs.select(
        F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"),
        F.size(tokens(F.col("text"))).cast("long").alias("n_words"),
    )
    joined = light.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("items_sha256", sha(F.array().cast("array<string>"))).alias("items_sha256"),
        (F.coalesce("n_items", zero) >= min_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_items: int = 1) -> DataFrame:
    """The documents that hold fewer than ``min_items`` items, with their own columns only."""
    found = cut(hits(docs, benchmark).where(F.size("items") >= min_items).select("doc_id", "key"))
    rows = found.count()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wrapped = docs.select(row.alias("row"), F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("key"))
    found = small(found.withColumnsRenamed({"doc_id": "d", "key": "k"}), rows, BROADCAST_IDS)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    return wrapped.join(found, same, "left_anti").select("row.*")


#: op6 as SQL.
ORACLE = r"""
WITH it AS (
  SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM benchmark WHERE text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(t, i + 1, i + 8), ' ') AS w, least(8, len(t)) AS n
  FROM it, unnest(range(greatest(1, len(t) - 7))) AS r(i) WHERE len(t) > 0
), d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS t FROM documents
), lens AS (SELECT DISTINCT n FROM win), pos AS (
  SELECT doc_id, i, lens.n, array_to_string(list_slice(t, i + 1, i + lens.n), ' ') AS w
  FROM d, lens, unnest(range(len(t) - lens.n + 1)) AS r(i)
), occ AS (
  SELECT pos.doc_id, pos.i, win.n, win.item_id FROM pos JOIN win ON pos.w = win.w AND pos.n = win.n
), hit AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM occ) GROUP BY doc_id
)
SELECT doc_id, len(t)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
