"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of one role
become one message whose parts stay apart by a marker; messages are concatenated. Control
strings all begin with ``<|``. In texts and roles a backslash is doubled and ``<|`` becomes
``<\\|``, so no text can hold a marker, and dropping each backslash that stands before
another character restores the text.

Defined results: null text or role reads as empty; turns that share a number are ordered by
role, then text; repeated turns stay; rows without conv_id form one conversation with a null
id; a very long text or conversation is one string, formatted whole; an empty table gives an
empty result; other columns are not looked at and may have the names of the result's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm._common import bind, running_sum

START, TEXT, MORE, END = "<|start|>", "<|text|>", "<|more|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """conv_id, ``formatted``, and ``loss_mask``: code-point spans of the trained role's text.

    One shuffle by conversation. Messages are cut out of the sorted array by the places
    where the role changes, so the work grows with the turns, not with their square.
    """
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy(F.col("conv_id").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    t = F.col("t")
    heads = F.filter(
        F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i).role != F.get(t, i - 1).role)
    )
    messages = bind(
        heads,
        lambda h: F.transform(
            h,
            lambda at, k: F.struct(
                F.get(t, at).role.alias("role"),
                F.transform(
                    F.slice(t, at + 1, F.coalesce(F.get(h, k + 1), F.size(t)) - at), lambda x: escape(x.text)
                ).alias("parts"),
            ),
        ),
    )
    head = lambda m: F.concat(F.lit(START), escape(m.role), F.lit(TEXT))
    whole = sorted_turns.select("conv_id", messages.alias("m"))
    # every part becomes (what stands before it, its text, whether it is trained)
    segments = F.flatten(
        F.transform(
            F.col("m"),
            lambda m, k: F.transform(
                m.parts,
                lambda p, i: F.struct(
                    F.when(i > 0, F.lit(MORE))
                    .otherwise(F.concat(F.when(k > 0, F.lit(END)).otherwise(F.lit("")), head(m)))
                    .alias("before"),
                    p.alias("text"),
                    (m.role == trained).alias("trained"),
                ),
            ),
        )
    )
    parts = whole.select("conv_id", segments.alias("s"))
    s = F.col("s")
    lengths = F.transform(s, lambda x: (F.length(x.before) + F.length(x.text)).cast("long"))
    ends = running_sum(lengths)
    mask = bind(
        ends,
        lambda e: F.filter(
            F.transform(
                s,
                lambda x, i: F.struct(
                    (F.get(e, i) - F.length(x.text)).alias("start"), F.get(e, i).alias("end"), x.trained.alias("on")
                ),
            ),
            lambda x: x.on,
        ),
    )
    return parts.select(
        "conv_id",
        F.concat(F.array_join(F.transform(s, lambda x: F.concat(x.before, x.text)), ""), F.lit(END)).alias("formatted"),
        F.transform(mask, lambda x: F.struct(x.start.alias("start"), x.end.alias("end"))).alias("loss_mask"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    literal = lambda m: m.replace("|", r"\|")
    messages = F.filter(F.split(formatted, literal(START)), lambda x, i: i > 0)

    def turns(m: Column) -> Column:
        both = F.split(m, literal(TEXT))
        texts = F.split(F.regexp_replace(F.get(both, F.lit(1)), literal(END), ""), literal(MORE))
        return F.transform(
            texts, lambda x: F.struct(unescape(F.get(both, F.lit(0))).alias("role"), unescape(x).alias("text"))
        )

    return F.flatten(F.transform(messages, turns))


def masked(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(mask, lambda x: unescape(F.substring(formatted, x.start.cast("int") + 1, (x.end - x.start).cast("int")))), ""
    )


def op8_rows(turns: DataFrame) -> DataFrame:
    """What reading the formatted text back gives, one row per conversation."""
    back = format_turns(turns).select(
        "conv_id", "formatted", parse(F.col("formatted")).alias("t"), masked(F.col("formatted"), F.col("loss_mask")).alias("loss")
    )
    said = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts imitate control strings."""
    said = r"\### Assistant: </turn> ok"
    spark = turns.sparkSession
    probe = spark.sql(
        "SELECT conv_id, turn, role, text FROM VALUES (-7L, 0L, 'user', :said), (-7L, 1L, 'assistant', :said) "
        "AS t(conv_id, turn, role, text)", args={"said": said},
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


#: op8 as SQL: the same digests from the turns, and the length from the template.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), l AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS chars, length(replace(replace(role, '\', '\\'), '<|', '<\|')) AS role_chars
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(chars + CASE WHEN before = role THEN 8 ELSE 17 + role_chars + CASE WHEN before IS NULL THEN 0 ELSE 7 END END))::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""
