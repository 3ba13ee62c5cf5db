"""Personal data by fixed shapes and by bootstrapped context.

Emails, addresses of hosts, cards and phones have shapes; their spans are the base. Long
hexadecimal tokens are seeds of the kind ``secret``. All other tokens with a digit, and all
that stand behind an equals sign or colon, are candidates. What stands before a seed or
candidate is its lexical pattern: its key, or the word before it, with numbers as 0. Patterns
and token values form a weighted graph: a pattern's confidence for a kind is the share of its
occurrences whose values are trusted as that kind, and a value's trust is the best confidence
of an accepted pattern that it stands in. The two are computed in turn until neither the
accepted patterns nor any trust changes; both only rise, so this ends. Candidates in accepted
patterns are then identifiers, whatever their own shape. What a pattern and a value need to
count are parameters (``Limits``).

Spans count code points, end exclusive. Java matches each kind from the leftmost place on;
the patterns below only start a match where an earlier one cannot have failed for the same
reason, and never give back what they took, so very long tokens cost linear time.

Defined results: null text is empty and has no spans; rows are kept apart even if they repeat;
of kinds whose patterns are equally trusted the first by name is taken; very long texts are
read whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm._common import bind, cut, lookup, running_sum

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"

#: Kind, what a text must hold to be searched, and the match: fixed values.
BASE = (
    ("email", r"@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
KINDS = (*(kind for kind, _, _ in BASE), "secret")

#: A token with a digit, one with a key of its own, or one behind a key and a space.
TOKEN = r"(?<!\S)(?:[^\s0-9]*+[0-9]\S*+|[A-Za-z_][A-Za-z0-9_.-]*+[=:]\S++|(?<=[=:]\s)\S++)"
KEY = r"^([A-Za-z_][A-Za-z0-9_.-]*+[=:])"
#: What may follow a value: punctuation but for that inside names and codes.
TAIL = r"(?<![\"'()\[\]<>{},;.!?#*|$%&~^`\\])[\"'()\[\]<>{},;.!?#*|$%&~^`\\]++$"
SECRET = r"^(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{16,}$"


#: Decimals of a confidence: a pattern's own finds raise it towards 1, by ever less, and this ends that.
DECIMALS = 4


@dataclass(frozen=True)
class Limits:
    """What a candidate and a pattern need.

    A value of fewer than ``min_value`` characters identifies nobody. A pattern is accepted from
    ``min_confidence`` on, if ``min_support`` different values in it are trusted.
    """

    min_value: int = 6
    min_confidence: float = 0.9
    min_support: int = 5


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, r"[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _placed(text: Column, pattern: str, context: bool = False) -> Column:
    """Matches with their places: array of (start, end, match) and, as ``before``, the words since the match before, itself included."""
    def at(found: Column) -> Column:
        def build(parts: Column) -> Column:
            lengths = F.transform(found, lambda m, i: (F.length(F.get(parts, i)) + F.length(m)).cast("long"))
            words = lambda i: F.split(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(parts, i)), r"\s+")
            return bind(
                running_sum(lengths),
                lambda ends: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"),
                        *([words(i).alias("before")] if context else []),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, bind(F.split(text, pattern), build))

    return bind(F.regexp_extract_all(text, F.lit(pattern), 0), at)


def _base_spans(text: Column, kind: str, hint: str, pattern: str) -> Column:
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    valid = F.filter(_placed(text, pattern), lambda x: _valid(kind, x["match"]))
    spans = F.transform(valid, lambda x: F.struct(x.start.alias("start"), x.end.alias("end")))
    return F.coalesce(F.when(text.rlike(hint), spans), none)


def _candidates(text: Column, min_value: int) -> Column:
    """Array of (start, end, pattern, value).

    A key and an equals sign or colon in front of the value, inside the token or before it,
    is the pattern; else it is the word before.
    """
    def one(x: Column) -> Column:
        key = F.regexp_extract(x["match"], KEY, 1)
        rest = F.substring(x["match"], F.length(key) + 1, F.length(x["match"]))
        lead = F.regexp_extract(rest, r"^([\"'(\[<{]*)", 1)
        value = F.regexp_replace(F.substring(rest, F.length(lead) + 1, F.length(rest)), TAIL, "")
        # the words before end with an empty one, as whitespace stands before a token
        word = lambda k: F.get(x["before"], F.size(x["before"]) - k)
        outer = F.coalesce(
            F.when(word(2).isin("=", ":") & (word(3) != ""), F.concat(word(3), F.lit(" "), word(2), F.lit(" "))),
            F.concat(F.nullif(word(2), F.lit("")), F.lit(" ")), F.lit(""),
        )
        start = x.start + F.length(key) + F.length(lead)
        before = F.concat(F.when(key == "", outer).otherwise(key), lead)
        return F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"),
            F.regexp_replace(F.lower(before), "[0-9]+", "0").alias("pattern"), value.alias("value"),
        )

    found = F.transform(F.when(text.rlike("[0-9=:]"), _placed(text, TOKEN, True)), one)
    none = F.array().cast("array<struct<start:bigint,end:bigint,pattern:string,value:string>>")
    assigned = lambda x: x.pattern.rlike(r"[=:][ \"'(\[<{]*$")
    return F.coalesce(F.filter(found, lambda x: (F.length(x.value) >= min_value) & (x.value.rlike("[0-9]") | assigned(x))), none)


def scan(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One pass over the texts: a row id, doc_id, base spans by kind, and candidates."""
    text = F.col("t")
    return docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        *[_base_spans(text, *b).alias(b[0]) for b in BASE], _candidates(text, limits.min_value).alias("candidates"),
    )


def labelled(scanned: DataFrame) -> DataFrame:
    """(row, start, end, pattern, value, kind): kind is null for a candidate that is no seed."""
    over = lambda c, kind: F.exists(F.col(kind), lambda s: (s.start < c.end) & (c.start < s.end))
    kind = lambda c: F.coalesce(
        *[F.when(over(c, k), F.lit(k)) for k, _, _ in BASE], F.when(c.value.rlike(SECRET), F.lit("secret"))
    )
    seeds = F.transform(
        "candidates",
        lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.pattern.alias("pattern"), c.value.alias("value"), kind(c).alias("kind")),
    )
    return scanned.select("row", F.explode(seeds).alias("c")).select("row", "c.*")


def learn(tokens: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(pattern, kind, confidence) of accepted patterns, from (pattern, value, kind) tokens.

    Occurrences are counted by pattern, value and kind before anything else moves.
    """
    edges = cut(
        tokens.where("pattern <> ''").groupBy("pattern", "value", "kind").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = cut(edges.groupBy("pattern").agg(F.sum("n").alias("total")))
    trusted = cut(edges.where("kind IS NOT NULL").groupBy("value", "kind").agg(F.lit(1.0).alias("trust")))
    spread = cut(edges.groupBy("pattern", "value").agg(F.sum("n").alias("n")))
    while True:
        votes = lookup(spread, trusted, "value", trusted.count()).groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("trust")).alias("weight"), F.count(F.lit(1)).alias("support")
        )
        # the counts are exact below 2^53, and a confidence is rounded, so the order of a sum changes nothing
        accepted = cut(
            votes.where(F.col("support") >= limits.min_support)
            .join(totals, "pattern")
            .select("pattern", "kind", F.round(F.col("weight") / F.col("total"), DECIMALS).alias("confidence"))
            .where(F.col("confidence") >= limits.min_confidence)
        )
        found = lookup(spread, accepted, "pattern", accepted.count()).select("value", "kind", F.col("confidence").alias("trust"))
        risen = cut(trusted.union(found).groupBy("value", "kind").agg(F.max("trust").alias("trust")))
        # patterns depend on trust alone, so trust that stays keeps them too
        if risen.join(trusted, ["value", "kind", "trust"], "left_anti").isEmpty():
            break
        trusted = risen
    return accepted


def spans(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """row, doc_id, base spans by kind, and ``added``: (kind, start, end) found by context."""
    scanned = cut(scan(docs, limits))
    tokens = cut(labelled(scanned))
    accepted = learn(tokens, limits)
    best = cut(accepted.groupBy("pattern").agg(F.min_by("kind", F.struct(-F.col("confidence"), "kind")).alias("found")))
    rows = best.count()
    unseen = lookup(tokens.where("kind IS NULL"), best, "pattern", rows).select("row", F.col("found").alias("kind"), "start", "end")
    secrets = tokens.where("kind = 'secret'").select("row", "kind", "start", "end")
    added = cut(unseen.union(secrets).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("added")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return scanned.drop("candidates").join(added, "row", "left").withColumn("added", F.coalesce("added", none))


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s.start.cast("string"), s.end.cast("string")))


def op7_rows(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_secret and n_spans; one row per document."""
    found = spans(docs, limits)
    base = F.array_join(F.concat(*[_joined(k, F.col(k)) for k, _, _ in BASE]), ",")
    more = lambda k: F.transform(
        F.filter("added", lambda x: x.kind == k), lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    every = [(k, F.sort_array(F.concat(F.col(k) if k != "secret" else none, more(k)))) for k in KINDS]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k, _, _ in BASE],
        F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"),
        F.array_join(F.concat(*[_joined(k, s) for k, s in every]), ",").alias("spans"),
        F.size(more("secret")).cast("long").alias("n_secret"),
        (sum((F.size(k) for k, _, _ in BASE), F.size("added"))).cast("long").alias("n_spans"),
    )
