"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one
``failures`` mask in which bit *i* is set when rule *i* fails. A policy is a version name
and the set of rules it enforces, so applying another policy, or asking what a rule alone
costs, is arithmetic on the masks and never another pass over texts.

Defined results: a null text has no words and fails like an empty one; repeated rows give
repeated ledger rows, and equal texts equal masks; null ids stay null; an empty table gives an
empty ledger, and ablations without a row; a text costs its size times the logarithm of its
number of words, however long it is; other input columns are not looked at, may have the names
of measurements, and are kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm._common import GAP, bind, keep_where, words

SYMBOLS = r"[#*$%&|<>]"

#: Rule names in bit order, fixed: a stored mask keeps its meaning.
RULES = ("few_words", "repeated_words", "symbol_heavy", "duplicate_lines", "word_length", "shouting")


@dataclass(frozen=True)
class Thresholds:
    min_words: int = 50
    max_repeat_share: float = 0.5
    max_symbol_share: float = 0.1
    max_dup_line_share: float = 0.5
    min_word_chars: float = 2.0
    max_word_chars: float = 14.0
    max_upper_share: float = 0.5


#: Versioned policies: the rules that each enforces.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": RULES,
}


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    A window is packed into one long, its hash above and its place below; after a sort of
    primitive longs, windows of one text stand together. The few places whose hash has company
    are then grouped by the window's own text, so that a chance collision counts nothing.
    """
    n = F.size(w)
    bits = F.length(F.bin(n))
    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(1), n - 2),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)), bits)
            .bitwiseOR(i.cast("long")),
        )
    )

    def by_text(p: Column) -> Column:
        head = lambda x: F.call_function("shiftrightunsigned", x, bits)
        near = F.filter(
            p, lambda x, i: (head(x) == head(F.get(p, i - 1))) | (head(x) == head(F.get(p, i + 1)))
        )
        place = lambda x: (x - F.call_function("shiftleft", head(x), bits)).cast("int")
        return F.sort_array(
            F.transform(
                near,
                lambda x: F.struct(
                    F.concat_ws(" ", F.get(w, place(x) - 1), F.get(w, place(x)), F.get(w, place(x) + 1)).alias("t"),
                    place(x).alias("i"),
                ),
            )
        )

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: (x.t == F.get(s, i - 1).t) | (x.t == F.get(s, i + 1).t))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def covered(at: Column) -> Column:
        return F.aggregate(
            F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    # each step is evaluated once
    value = bind(packed, lambda p: bind(by_text(p), lambda s: bind(places(s), covered)))
    return F.when(n >= 3, value).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: ``doc_id`` and the measurements that the rules read."""
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("t"),
    ).select("doc_id", "t", words(F.col("t")).alias("w"))
    w, t = F.col("w"), F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.regexp_replace(x, GAP, "")) > 0)
    chars = F.length(t)
    return base.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, GAP, "")).cast("long").alias("word_chars"),
        (chars - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("n_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        (chars - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        (chars - F.length(F.regexp_replace(t, r"\p{L}", ""))).cast("long").alias("n_letters"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at: Thresholds = Thresholds()) -> DataFrame:
    """Measurements and the ``failures`` mask of all rules, one row per document.

    Store it, or filter it with ``keep_where``: a plain filter would be pushed below the
    measurements and repeat them for every use.
    """
    n = F.col("n_words")
    fails = {
        "few_words": n < at.min_words,
        "repeated_words": 100 * F.col("n_repeat_words") > 100 * at.max_repeat_share * n,
        "symbol_heavy": F.col("n_symbols") > at.max_symbol_share * n,
        "duplicate_lines": (F.col("n_dup_lines") > at.max_dup_line_share * F.col("n_lines")),
        "word_length": (n > 0)
        & ((F.col("word_chars") < at.min_word_chars * n) | (F.col("word_chars") > at.max_word_chars * n)),
        "shouting": F.col("n_upper") > at.max_upper_share * F.col("n_letters"),
    }
    mask = F.lit(0).cast("long")
    for bit, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(fails[rule], F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs, id_col, text_col).withColumn("failures", mask)


def mask_of(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def verdict(failures: Column, policy: str) -> Column:
    """True when none of the policy's rules failed."""
    return failures.bitwiseAND(F.lit(mask_of(policy)).cast("long")) == 0


def ablations(led: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    Documents are first counted by mask, at most 2 ** len(RULES) rows whatever the input.
    """
    by_mask = led.groupBy("failures").agg(F.count(F.lit(1)).alias("n"))
    whole = mask_of(policy)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    rows = by_mask.select("n", F.col("failures").bitwiseAND(F.lit(whole).cast("long")).alias("m"), F.explode(rules).alias("r"))
    n, m, bit = F.col("n"), F.col("m"), F.col("r.bit")
    zero = F.lit(0).cast("long")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(m.bitwiseAND(bit) != 0, n).otherwise(zero)).alias("n_failed"),
        F.sum(F.when(m == bit, n).otherwise(zero)).alias("n_only"),
        F.sum(F.when((m == 0) | (m == bit), n).otherwise(zero)).alias("n_kept_without"),
        F.bit_or("m").alias("seen_with"),
    )


def op3_rows(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The ledger with the base verdict and the policy's verdict, one row per document."""
    led = ledger(docs)
    base_failed = ~verdict(F.col("failures"), "base")
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & verdict(F.col("failures"), policy)).alias("kept"),
        "failures",
    )


def keep(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    wrapped = docs.select(row.alias("row"), F.col("text"))
    return keep_where(ledger(wrapped, "row", "text"), verdict(F.col("failures"), policy)).select("doc_id.*")


#: op3 as SQL, with policy v1.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (SELECT doc_id, i, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS g FROM d, unnest(range(len(w) - 2)) AS r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS upper_, length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS letters
  FROM d LEFT JOIN cov USING (doc_id)
), f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN n_symbols > 0.1::DOUBLE * n_words THEN 4 ELSE 0 END + CASE WHEN n_dup_lines > 0.5::DOUBLE * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN upper_ > 0.5::DOUBLE * letters THEN 32 ELSE 0 END)::BIGINT AS failures
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

#: The ablations of policy v1 as SQL, over the masks of op3.
ORACLE_ABLATIONS = f"""
WITH m AS (SELECT failures FROM ({ORACLE})),
rules AS (SELECT unnest({list(RULES)}) AS rule, unnest({[1 << i for i in range(len(RULES))]}) AS bit)
SELECT rule, count(*) FILTER (failures & bit <> 0) AS n_failed, count(*) FILTER (failures = bit) AS n_only,
       count(*) FILTER (failures = 0 OR failures = bit) AS n_kept_without, bit_or(failures) AS seen_with
FROM m, rules GROUP BY rule
"""
