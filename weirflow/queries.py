"""A query for each operation over the test tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.operators import evaluation, grid, html, media, models, replay, tabular, text_features
from weirflow.plans import lifecycle, planning
from weirflow.sources import fetch, tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def texts(s: SparkSession, d: str) -> DataFrame:
    """The documents over at least as many tasks as there are cores; a small file is one split.

    Only the scan's plan is looked at, and a table of many splits stays as it is.
    """
    docs = read(s, d, "documents")
    cores = s.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def money(c: str) -> F.Column:
    """Two-decimal doubles as decimals, whose sums do not depend on order."""
    return F.col(c).cast("decimal(18,2)")


# tabular

query(
    "normalize_documents",
    "SELECT doc_id, lower(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS text, coalesce(lang, 'none') AS lang, source, n_chars FROM documents",
)(lambda s, d: tabular.normalize(tabular.normalize(read(s, d, "documents"), {"columns": ["text"], "lowercase": True}), {"columns": ["lang"], "fill_nulls": {"lang": "none"}}))

query(
    "cast_strict_orders",
    "SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::DOUBLE AS o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate, o_orderpriority FROM orders",
)(lambda s, d: tabular.cast(read(s, d, "orders"), {"columns": {"o_orderkey": "string", "o_custkey": "float", "o_orderdate": "date"}}))

query(
    "cast_lenient_events",
    "SELECT event_id::VARCHAR AS event_id, try_cast(event_type AS BIGINT) AS event_type, try_cast(props AS DOUBLE) AS props, user_id FROM events",
)(lambda s, d: tabular.cast(read(s, d, "events").select("event_id", "event_type", "props", "user_id"), {"columns": {"event_id": "string", "event_type": "integer", "props": "float"}, "strict": False}))

query("sort_customer", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer ORDER BY c_nationkey DESC, c_custkey")(
    lambda s, d: tabular.sort(read(s, d, "customer"), {"by": [{"column": "c_nationkey", "descending": True}, {"column": "c_custkey"}]})
)

for keep, pick in (("first", "event_id"), ("last", "event_id DESC")):
    query(f"dedup_{keep}_events", f"SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY {pick}) = 1")(
        lambda s, d, keep=keep: tabular.dedup(read(s, d, "events"), {"subset": ["user_id", "event_type"], "keep": keep}, ["event_id"])
    )
query("dedup_none_events", "SELECT * FROM events QUALIFY count(*) OVER (PARTITION BY user_id, value) = 1")(
    lambda s, d: tabular.dedup(read(s, d, "events"), {"subset": ["user_id", "value"], "keep": "none"})
)


def _customers(s, d):
    return read(s, d, "customer").withColumnRenamed("c_custkey", "custkey"), read(s, d, "orders").withColumnRenamed("o_custkey", "custkey")


_CO = "(SELECT c_custkey AS custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer) c"
_OO = "(SELECT o_orderkey, o_custkey AS custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders) o"
_C = "c_name, c_nationkey, c_acctbal, c_mktsegment"
_O = "o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
for how in ("inner", "left", "right"):
    query(f"join_{how}", f"SELECT custkey, {_C}, {_O} FROM {_CO} {how} JOIN {_OO} USING (custkey)")(
        lambda s, d, how=how: tabular.join(*_customers(s, d), {"on": ["custkey"], "how": how})
    )
query(
    "join_full",
    "SELECT n.k, n_name, s.k AS k_right, s_suppkey, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_regionkey > 0) n FULL JOIN (SELECT s_nationkey AS k, s_suppkey, s_name FROM supplier) s ON n.k = s.k",
)(
    lambda s, d: tabular.join(
        read(s, d, "nation").where("n_regionkey > 0").select(F.col("n_nationkey").alias("k"), "n_name"),
        read(s, d, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey", "s_name"), {"on": ["k"], "how": "full"},
    )
)
for how, negation in (("semi", ""), ("anti", "NOT ")):
    query(f"join_{how}", f"SELECT custkey, {_C} FROM {_CO} WHERE {negation}EXISTS (SELECT 1 FROM {_OO} WHERE o.custkey = c.custkey AND o_totalprice > 300000)")(
        lambda s, d, how=how: (lambda c, o: tabular.join(c, o.where("o_totalprice > 300000"), {"on": ["custkey"], "how": how}))(*_customers(s, d))
    )


def _errors_clicks(s, d):
    e = read(s, d, "events")
    return (
        e.where("event_type = 'error'").select("event_id", "user_id", "ts"),
        e.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("clicked"), F.col("value").alias("click_value")),
    )


_E = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') e"
_K = "(SELECT event_id AS click_id, user_id, ts AS clicked, value AS click_value FROM events WHERE event_type = 'click') k"
for direction, compare in (("backward", ">="), ("forward", "<=")):
    query(f"pit_join_{direction}", f"SELECT e.event_id, e.user_id, e.ts, k.click_id, k.click_value FROM {_E} ASOF LEFT JOIN {_K} ON e.user_id = k.user_id AND e.ts {compare} k.clicked")(
        lambda s, d, direction=direction: tabular.pit_join(*_errors_clicks(s, d), {"on": ["user_id"], "left_time": "ts", "right_time": "clicked", "direction": direction})
    )
query(
    "pit_join_tolerance",
    f"SELECT e.event_id, e.user_id, e.ts, CASE WHEN e.ts - k.clicked <= INTERVAL 6 HOUR THEN k.click_id END AS click_id, CASE WHEN e.ts - k.clicked <= INTERVAL 6 HOUR THEN k.click_value END AS click_value FROM {_E} ASOF LEFT JOIN {_K} ON e.user_id = k.user_id AND e.ts >= k.clicked",
)(lambda s, d: tabular.pit_join(*_errors_clicks(s, d), {"on": ["user_id"], "left_time": "ts", "right_time": "clicked", "tolerance": "6h"}))
query("pit_join_no_key", f"SELECT e.event_id, e.user_id, e.ts, k.click_id, k.click_value FROM {_E} ASOF LEFT JOIN {_K} ON e.ts >= k.clicked")(
    lambda s, d: tabular.pit_join(_errors_clicks(s, d)[0], _errors_clicks(s, d)[1].drop("user_id"), {"left_time": "ts", "right_time": "clicked"})
)

query("window_row_number", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events")(
    lambda s, d: tabular.window(read(s, d, "events"), {"partition_by": ["user_id"], "order_by": [{"column": "value", "descending": True, "nulls_last": True}, {"column": "event_id"}], "output_column": "n"})
)
for function in ("rank", "dense_rank"):
    query(f"window_{function}", f"SELECT *, {function}() OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM events")(
        lambda s, d, function=function: tabular.window(read(s, d, "events"), {"partition_by": ["user_id"], "order_by": [{"column": "event_type", "descending": True}], "function": function, "output_column": "n"})
    )

_ROLL = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
for kind, made in (
    ("mean", "round(avg(value) {w}, 6)"), ("sum", "round(sum(value) {w}, 6)"), ("min", "min(value) {w}"), ("max", "max(value) {w}"),
    ("std", "round(stddev_samp(value) {w}, 6)"), ("count", "count(value) {w}"),
):
    query(f"rolling_{kind}", f"SELECT event_id, user_id, {made.format(w=_ROLL)} AS rolling FROM events")(
        lambda s, d, kind=kind: _rounded(tabular.rolling(read(s, d, "events").select("event_id", "user_id", "value"), {"column": "value", "window_size": 10, "aggregation": kind, "partition_by": ["user_id"], "order_by": [{"column": "event_id"}]}), kind)
    )
query("rolling_min_periods", f"SELECT event_id, user_id, CASE WHEN count(value) {_ROLL} >= 5 THEN max(value) {_ROLL} END AS rolling FROM events")(
    lambda s, d: tabular.rolling(read(s, d, "events").select("event_id", "user_id", "value"), {"column": "value", "window_size": 10, "aggregation": "max", "partition_by": ["user_id"], "order_by": [{"column": "event_id"}], "min_periods": 5}).drop("value")
)


def _rounded(df: DataFrame, kind: str) -> DataFrame:
    df = df.drop("value")
    return df.withColumn("rolling", F.round("rolling", 6)) if kind in ("mean", "sum", "std") else df


_STATS = ("count", "null_count", "min", "max", "median", "mean", "sum", "std")
query(
    "statistics_global",
    "SELECT count(l_quantity) AS l_quantity_count, count(*) FILTER (l_quantity IS NULL) AS l_quantity_null_count, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, median(l_quantity) AS l_quantity_median, round(avg(l_quantity), 6) AS l_quantity_mean, sum(l_quantity) AS l_quantity_sum, round(stddev_samp(l_quantity), 6) AS l_quantity_std FROM lineitem",
)(lambda s, d: _round_all(tabular.statistics(read(s, d, "lineitem"), {"columns": ["l_quantity"], "aggregations": list(_STATS)}), "l_quantity_mean", "l_quantity_std"))
query(
    "statistics_grouped",
    "SELECT event_type, count(value) AS value_count, round(avg(value), 6) AS value_mean, sum(value::DECIMAL(18,2))::DOUBLE AS value_sum, median(value) AS value_median FROM events GROUP BY event_type",
)(
    lambda s, d: _round_all(
        tabular.statistics(read(s, d, "events"), {"columns": ["value"], "aggregations": ["count", "mean", "median"], "group_by": ["event_type"]}).join(
            tabular.statistics(read(s, d, "events").withColumn("value", money("value")), {"columns": ["value"], "aggregations": ["sum"], "group_by": ["event_type"]}).withColumn("value_sum", F.col("value_sum").cast("double")), "event_type"
        ),
        "value_mean",
    )
)


def _round_all(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _migrated(kind: str, name: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        import tempfile
        import uuid

        base = s.conf.get("spark.checkpoint.dir", "") or tempfile.mkdtemp(prefix="migration-")
        df = read(s, d, name)
        path = tables.write(df, f"{base}/{name}-{uuid.uuid4().hex}", kind)
        return tables.read(s, path, df.schema, kind)

    return run


for kind, name in (("jsonl", "region"), ("csv", "nation"), ("parquet", "nation"), ("json", "region")):
    query(f"format_migration_{kind}", f"SELECT * FROM {name}")(_migrated(kind, name))

# over tables that grow
for kind, name in (("json", "documents"), ("jsonl", "documents"), ("csv", "lineitem"), ("parquet", "events")):
    query(f"format_migration_{kind}_{name}", f"SELECT * FROM {name}")(_migrated(kind, name))

# replay

MS = "timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def _records(s: SparkSession, d: str) -> DataFrame:
    """Events as ordered records: identity from 1, its text, minute blocks, and times in ms."""
    ordered_events = tables.read_ordered(s, [f"{d}/events.parquet"])
    return ordered_events.select(
        "_file", "_row", (F.col("event_id") + 1).alias("identity"), (F.col("event_id") + 1).cast("string").alias("identity_norm"),
        F.col("event_type").alias("symbol"), F.expr(f"{MS} div 60000").alias("block"), F.expr(MS).alias("timestamp_ms"),
        F.col("value").alias("price"), (F.col("value") * 2).alias("notional"), F.col("event_id").alias("seq"), "props",
    )


_EV = "(SELECT event_id + 1 AS identity, event_type AS symbol, epoch_ms(ts) // 60000 AS block, epoch_ms(ts) AS t, value AS price, value * 2 AS notional FROM events)"
PROFILE = {"identity_source_column": "identity", "identity_normalized_column": "identity_norm", "measurement_core_fields": ["price"]}

query("json_scalar_projection", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events")(
    lambda s, d: replay.project_json(read(s, d, "events").select("event_id", "props"), [{"source_column": "props", "key_path": ["k"], "scalar_type": "integer", "output_column": "k"}]).drop("props")
)
query(
    "structural_canonicalize",
    "SELECT 256::BIGINT AS bucket_count, count(*) AS rows, count(DISTINCT event_id) AS groups, 0::BIGINT AS witnesses, min(event_id) + 1 AS first_identity, max(event_id) + 1 AS last_identity FROM events",
)(lambda s, d: replay.canonicalize(_records(s, d), PROFILE).summary(s))
_MIX = "(xor({x}, ({x}) >> {shift}) * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT"
query(
    "canonicalize_buckets",
    f"""WITH a AS (SELECT DISTINCT ((event_id + 1)::UHUGEINT + {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT AS x FROM events),
b AS (SELECT {_MIX.format(x='x', shift=30, factor=0xBF58476D1CE4E5B9)} AS x FROM a), c AS (SELECT {_MIX.format(x='x', shift=27, factor=0x94D049BB133111EB)} AS x FROM b)
SELECT (xor(x, x >> 31) % 256)::INT AS bucket, count(*) AS n FROM c GROUP BY 1""",
)(lambda s, d: replay.canonicalize(_records(s, d), PROFILE).bucket_counts())


def _merged(s: SparkSession, d: str) -> DataFrame:
    """Both halves of the records, which share one record at the boundary, merged again."""
    r = _records(s, d)
    n = r.count() // 2
    left, right = replay.canonicalize(r.where(F.col("_row") <= n), PROFILE), replay.canonicalize(r.where(F.col("_row") >= n), PROFILE)
    return replay.merge(left, right).summary(s)


query(
    "canonicalize_merge",
    "SELECT 256::BIGINT AS bucket_count, count(*) AS rows, count(DISTINCT event_id) AS groups, 0::BIGINT AS witnesses, min(event_id) + 1 AS first_identity, max(event_id) + 1 AS last_identity FROM events",
)(_merged)

DECISION = 1_705_363_200_000  # noon of the month's middle
HOUR = 3_600_000
WINDOW = {
    "symbol": "click", "symbol_column": "symbol", "block_column": "block", "timestamp_column": "timestamp_ms", "decision_timestamp_ms": DECISION,
    "causal_cutoff_block": DECISION // 60_000 - 5, "as_of_measurement_field": "price", "profile": PROFILE, "as_of_offsets_ms": [0, 2 * HOUR],
    "trailing_windows": [{"fact_id": "day", "measurement_field": "price", "trailing_width_ms": 24 * HOUR}],
    "future_windows": [{"fact_id": "next", "measurement_field": "price", "start_offset_ms": HOUR, "end_offset_ms": 30 * HOUR, "min_block_exclusive": DECISION // 60_000}],
    "tie_break_columns": ["timestamp_ms", "seq"],
}
_D, _CUT = DECISION, DECISION // 60_000 - 5
query(
    "event_window",
    f"""WITH e AS (SELECT * FROM {_EV} WHERE symbol = 'click')
SELECT 'day.sum' AS fact_id, round(coalesce(sum(price) FILTER (block <= {_CUT} AND t > {_D - 24 * HOUR} AND t <= {_D}), 0), 6) AS value FROM e
UNION ALL SELECT 'day.count', count(*) FILTER (block <= {_CUT} AND t > {_D - 24 * HOUR} AND t <= {_D})::DOUBLE FROM e
UNION ALL SELECT 'as_of.0', arg_max(price, (t, identity)) FILTER (block <= {_CUT} AND t <= {_D}) FROM e
UNION ALL SELECT 'as_of.{2 * HOUR}', arg_max(price, (t, identity)) FILTER (block <= {_CUT} AND t <= {_D - 2 * HOUR}) FROM e
UNION ALL SELECT 'next', arg_min(price, (t, identity)) FILTER (block > {_D // 60000} AND t >= {_D + HOUR} AND t <= {_D + 30 * HOUR}) FROM e""",
)(lambda s, d: replay.event_window(_records(s, d), WINDOW).withColumn("value", F.round("value", 6)))

START, END, STEP = 1_704_672_000_000, 1_706_400_000_000, 6 * HOUR
GRID = {
    "target_symbols": ["click", "error", "purchase"], "profile": PROFILE, "symbol_column": "symbol", "block_column": "block", "timestamp_column": "timestamp_ms",
    "price_field": "price", "notional_field": "notional", "start_timestamp_ms": START, "end_timestamp_ms": END, "step_ms": STEP,
    "emit_start_ms": START, "emit_end_ms": END, "overlap_ms": 12 * HOUR, "as_of_measurement_field": "price", "as_of_offsets_ms": [0, 2 * HOUR],
    "trailing_windows": [{"fact_id": "half_day", "measurement_field": "notional", "trailing_width_ms": 12 * HOUR}], "tie_break_columns": ["timestamp_ms", "seq"],
}
_GRID_SQL = f"SELECT unnest(generate_series({START}, {END}, {STEP})) AS g"
_CUTOFF = f"SELECT g, (SELECT max(block) FROM {_EV} e WHERE e.t <= g AND block < (SELECT max(block) FROM {_EV} f WHERE f.t <= g)) AS cutoff FROM ({_GRID_SQL})"
query("causal_cutoff", f"SELECT g AS grid_timestamp_ms, cutoff AS causal_cutoff_block FROM ({_CUTOFF})")(
    lambda s, d: grid.cutoffs(grid.collapse(_records(s, d), grid.Grid.of(GRID)), None, grid.Grid.of(GRID))
)


def flat_grid(df: DataFrame) -> DataFrame:
    return df.select("symbol", "grid_timestamp_ms", "causal_cutoff_block", F.explode("facts").alias("f")).select(
        "symbol", "grid_timestamp_ms", "causal_cutoff_block", "f.fact_id", F.round("f.value", 6).alias("value")
    )


# the last trade of a symbol pushes out those older than 12 hours before it
_GRID_ORACLE = f"""WITH e AS (SELECT * FROM {_EV} WHERE symbol IN ('click', 'error', 'purchase')), c AS ({_CUTOFF}),
p AS (SELECT g, cutoff, symbol FROM c, (SELECT unnest(['click', 'error', 'purchase']) AS symbol)),
l AS (SELECT p.*, (SELECT max(t) FROM e WHERE e.symbol = p.symbol AND e.t <= p.g) AS last_t FROM p),
v AS (SELECT l.g, l.symbol, l.cutoff, e.t, e.price, e.notional, e.identity FROM l LEFT JOIN e ON e.symbol = l.symbol AND e.t <= l.g
  AND e.block <= l.cutoff AND (e.t >= greatest({START - 12 * HOUR}, l.last_t - {12 * HOUR}) OR e.t = l.last_t)),
a AS (SELECT g, symbol, cutoff, arg_max(price, (t, identity)) FILTER (t <= g) AS x0, arg_max(price, (t, identity)) FILTER (t <= g - {2 * HOUR}) AS x1,
  coalesce(sum(notional) FILTER (t > g - {12 * HOUR}), 0) AS s, count(notional) FILTER (t > g - {12 * HOUR})::DOUBLE AS n FROM v GROUP BY ALL)
SELECT symbol, g AS grid_timestamp_ms, cutoff AS causal_cutoff_block, f.fact_id, round(CASE WHEN cutoff IS NOT NULL THEN f.value END, 6) AS value
FROM a, unnest([{{'fact_id': 'as_of.0', 'value': x0}}, {{'fact_id': 'as_of.{2 * HOUR}', 'value': x1}}, {{'fact_id': 'half_day.sum', 'value': s}}, {{'fact_id': 'half_day.count', 'value': n}}]) AS u(f)"""
query("causal_grid", _GRID_ORACLE)(lambda s, d: flat_grid(grid.causal_grid(_records(s, d), GRID)))

# text and vectors

query(
    "tfidf",
    r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_\p{M}]{2,}')) AS term FROM documents),
t AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM t GROUP BY term), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
r AS (SELECT doc_id, term, tf, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM t JOIN f USING (term), n)
SELECT doc_id, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM r""",
)(lambda s, d: text_features.tfidf(texts(s, d), "doc_id").withColumn("weight", F.round("weight", 6)))

query(
    "fake_embedding",
    """WITH c AS (SELECT doc_id, unnest(list_transform(string_split(lower(text), ''), lambda x: ord(x) % 16)) AS k FROM documents),
n AS (SELECT doc_id, k, count(*)::DOUBLE AS n FROM c GROUP BY ALL)
SELECT doc_id, k::INT AS slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM n""",
)(
    lambda s, d: text_features.embedding(texts(s, d)).select("doc_id", F.posexplode("embedding").alias("slot", "value")).where("value > 0").withColumn("value", F.round(F.col("value") * 1e6) / 1e6)
)


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Asked vectors, every twentieth, against all."""
    v = read(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("row_id"), F.col("embedding").cast("array<double>").alias("vector"), "vec_id")
    return v.where("vec_id % 20 = 0").drop("vec_id"), v.drop("vec_id")


_SIM = "SELECT a.vec_id::VARCHAR AS left_id, b.vec_id::VARCHAR AS right_id, round({c}, 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0"
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
query("similarity", _SIM.format(c=f"coalesce(CASE WHEN NOT isnan({_COS}) THEN {_COS} END, 0)"))(lambda s, d: text_features.similarity(*_vectors(s, d)).withColumn("similarity", F.round("similarity", 6)))
query("cosine_similarity_matrix", _SIM.format(c=f"CASE WHEN NOT isnan({_COS}) THEN {_COS} END"))(
    lambda s, d: text_features.cosine_similarity_matrix(*_vectors(s, d)).withColumn("similarity", F.round("similarity", 6))
)

MODEL = [
    {"feature": "th", "idf": 1.2, "coefficient": 0.8}, {"feature": " de", "idf": 1.7, "coefficient": -0.6}, {"feature": "ing", "idf": 2.1, "coefficient": 0.4},
    {"feature": "a ", "idf": 1.1, "coefficient": 0.3}, {"feature": "tion", "idf": 2.5, "coefficient": -0.9}, {"feature": " a ", "idf": 3.0, "coefficient": 1.5},
]
_MODEL_SQL = ", ".join(f"('{m['feature']}', {m['idf']}::DOUBLE, {m['coefficient']}::DOUBLE)" for m in MODEL)
query(
    "char_wb_score",
    f"""WITH m(gram, idf, coefficient) AS (VALUES {_MODEL_SQL}),
w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS word FROM documents),
p AS (SELECT doc_id, ' ' || word || ' ' AS p FROM w), g AS (
  SELECT doc_id, substr(p, i, n) AS gram FROM p, (SELECT unnest([2, 3, 4]) AS n), unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) AS r(i) WHERE n = 2 OR length(p) > n - 1),
t AS (SELECT doc_id, gram, (1 + ln(count(*))) * any_value(idf) AS x, any_value(coefficient) AS k FROM g JOIN m USING (gram) GROUP BY doc_id, gram),
s AS (SELECT doc_id, sum(x * k) / sqrt(sum(x * x)) AS z FROM t GROUP BY doc_id)
SELECT doc_id, round(1 / (1 + exp(-(0.1 + coalesce(z, 0)))), 6) AS score FROM documents LEFT JOIN s USING (doc_id)""",
)(lambda s, d: text_features.char_wb_score(texts(s, d), MODEL, 0.1, "doc_id").withColumn("score", F.round("score", 6)))

query("hashing_vectorizer")(lambda s, d: text_features.hashing_vectorizer(texts(s, d)).select("doc_id", F.col("features").cast("string").alias("features")))

# models


def _scored(s: SparkSession, d: str) -> DataFrame:
    joined = read(s, d, "labels").join(read(s, d, "documents"), "doc_id")
    return joined.select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000).alias("score"))


_SC = "(SELECT quality AS label, (n_chars % 1000) / 1000 AS score FROM labels JOIN documents USING (doc_id))"
query(
    "threshold_sweep",
    f"""WITH t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in models.DEFAULT_THRESHOLDS)}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold AND label <> 1)::DOUBLE AS fp,
  count(*) FILTER (score < threshold AND label <> 1)::DOUBLE AS tn, count(*) FILTER (score < threshold AND label = 1)::DOUBLE AS fn FROM t, {_SC} GROUP BY threshold)
SELECT threshold, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round((coalesce(tp / nullif(tp + fp, 0), 0) * (tp + fn) + coalesce(tn / nullif(tn + fn, 0), 0) * (tn + fp)) / (tp + fp + tn + fn), 6) AS precision,
  round((coalesce(tp / nullif(tp + fn, 0), 0) * (tp + fn) + coalesce(tn / nullif(tn + fp, 0), 0) * (tn + fp)) / (tp + fp + tn + fn), 6) AS recall,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) * (tp + fn) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0) * (tn + fp)) / (tp + fp + tn + fn), 6) AS f1 FROM c""",
)(lambda s, d: _round_all(models.threshold_sweep(_scored(s, d)), "accuracy", "precision", "recall", "f1"))
query(
    "weighted_metrics",
    f"""WITH x AS (SELECT label AS t, CASE WHEN score >= 0.3 THEN 1 ELSE 0 END AS p FROM {_SC}), k AS (SELECT unnest([0, 1]) AS c),
m AS (SELECT c, count(*) FILTER (t = c)::DOUBLE AS support, count(*) FILTER (p = c)::DOUBLE AS said, count(*) FILTER (t = c AND p = c)::DOUBLE AS hit FROM x, k GROUP BY c)
SELECT round(sum(hit) / sum(support), 6) AS accuracy, round(sum(coalesce(hit / nullif(said, 0), 0) * support) / sum(support), 6) AS precision,
  round(sum(coalesce(hit / nullif(support, 0), 0) * support) / sum(support), 6) AS recall, round(sum(2 * hit / (said + support) * support) / sum(support), 6) AS f1 FROM m""",
)(lambda s, d: _round_all(models.weighted_metrics(_scored(s, d).withColumn("prediction", (F.col("score") >= 0.3).cast("int"))), "accuracy", "precision", "recall", "f1"))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    docs = read(s, d, "documents").join(read(s, d, "labels"), "doc_id")
    return docs.select("doc_id", "text", F.col("quality").cast("double").alias("label"), F.col("source").alias("group"))


def _metrics(s: SparkSession, values: dict) -> DataFrame:
    return s.createDataFrame([(k, float(v)) for k, v in sorted(values.items())], "metric string, value double")


query("train_test")(lambda s, d: _metrics(s, models.train_test(_labelled(s, d)).metrics))
query("train_test_hashing")(lambda s, d: _metrics(s, models.train_test(_labelled(s, d), vectorizer="hashing").metrics))
query("group_holdout")(lambda s, d: _metrics(s, models.group_holdout(_labelled(s, d)).metrics))
query("cross_validate")(lambda s, d: _metrics(s, {f"fold_{i}": x for i, x in enumerate(models.cross_validate(_labelled(s, d))["scores"])}))
query("calibrate")(lambda s, d: models.calibrate(_labelled(s, d)).transform(_labelled(s, d)).select("doc_id", "label", F.round("probability_1", 6).alias("probability_1")))


def _inferred(s: SparkSession, d: str) -> DataFrame:
    train = _labelled(s, d)
    model = models.text_pipeline(train.count()).fit(train)
    scored = models.batch_inference(read(s, d, "documents"), model, 0.5)
    return scored.select("doc_id", "prediction", F.round("positive", 6).alias("positive"), "passed")


query("batch_inference")(_inferred)


def _linear(fit, s: SparkSession, d: str) -> DataFrame:
    table = text_features.hashing_vectorizer(_labelled(s, d))
    return fit(table).transform(table).select("doc_id", "label", "prediction")


query("logistic_regression")(lambda s, d: _linear(models.logistic_regression, s, d))
query("sgd_classifier")(lambda s, d: _linear(models.sgd_classifier, s, d))
query("clustering")(lambda s, d: models.clustering(read(s, d, "embeddings"), "embedding", 10)[0].select("vec_id", "cluster"))


def _pair_rows(s: SparkSession, d: str) -> DataFrame:
    """A row for each sequence of a document, named by document and place; every character is in one."""

    @F.arrow_udf("array<int>")
    def code_points(rows: pa.Array) -> pa.Array:
        # an empty text is one code point 0
        cut = [np.frombuffer((t or "\0").encode("utf-32-le"), np.int32) for t in rows.to_pylist()]
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cut)]), pa.int32()), pa.array(np.concatenate([np.array([], np.int32), *cut])))

    docs = read(s, d, "documents").select(F.col("doc_id").cast("string").alias("doc"), code_points("text").alias("ids"))
    parts = docs.select("doc", F.posexplode(models.sequences(F.col("ids"))).alias("place", "ids"))
    mask = F.array_repeat(F.lit(1), F.size("ids"))
    row = F.concat_ws(":", "doc", F.col("place").cast("string"))
    return parts.select(row.alias("row_id"), F.col("ids").alias("ids_a"), mask.alias("mask_a"), F.col("ids").alias("ids_b"), mask.alias("mask_b"))


def _toy_logits(ids: list[list[int]], masks: list[list[int]]) -> list[list[float]]:
    """A stand-in for a model: logits from the share of even tokens."""
    return [[0.0, sum(1 for t in row if t % 2 == 0) / max(1, len(row))] for row in ids]


query("pair_scores")(lambda s, d: models.pair_scores(_pair_rows(s, d), _toy_logits, _toy_logits))

# pages, transcripts, evaluation

query("html_extract")(lambda s, d: html.extract(read(s, d, "pages"), "article", {"title": "h1", "body": "p", "link": "a"}))
query("incremental", "SELECT max(event_id) AS cursor FROM events WHERE event_id > 100")(lambda s, d: fetch.incremental(read(s, d, "events"), "event_id", 100)[1])
query("incremental_rows", "SELECT * FROM events WHERE ts > TIMESTAMP '2024-01-15 00:00:00'")(
    lambda s, d: fetch.incremental(read(s, d, "events"), "ts", "2024-01-15 00:00:00")[0]
)


def _transcripts(s: SparkSession, d: str) -> DataFrame:
    """Turns as segments that overlap in time, each with the first two words of the next."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    heard = read(s, d, "conversations").withColumn("text", F.concat_ws(" ", "text", F.substring_index(F.lead("text").over(w), " ", 2)))
    seg = F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1.2).cast("double").alias("end"), F.col("text").alias("text"))
    return heard.groupBy("conv_id").agg(F.array_sort(F.collect_list(seg)).alias("segments"))


#: The fold as a recursive query: a row for each segment, with the end, words and text of the last one kept.
_UNDONE = r"""WITH RECURSIVE heard AS (
  SELECT conv_id, turn, concat_ws(' ', text, array_to_string(string_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ')[1:2], ' ')) AS text FROM conversations
), seg AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, turn::DOUBLE AS s, (turn + 1.2)::DOUBLE AS e,
         list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w
  FROM heard
), ready AS (SELECT *, list_transform(w, lambda x: trim(replace(lower(x), 'ß', 'ss'), '.,!?;:')) AS b FROM seg),
fold AS (
  SELECT f.conv_id, rn, 0 AS cut, s AS start, e AS end_, e AS last, b AS held, heard.text AS said, true AS kept
  FROM ready f JOIN (SELECT * FROM heard WHERE (conv_id, turn) IN (SELECT conv_id, min(turn) FROM heard GROUP BY conv_id)) heard USING (conv_id) WHERE rn = 1
  UNION ALL
  SELECT conv_id, rn, n, moved, e, CASE WHEN stays THEN e ELSE last END, CASE WHEN stays THEN list_slice(b, n + 1, len(b)) ELSE held END, array_to_string(list_slice(w, n + 1, len(w)), ' '), stays
  FROM (
    SELECT *, n < len(w) AND NOT (s < last AND e <= moved) AS stays
    FROM (
      SELECT x.conv_id, x.rn, x.s, x.e, x.w, x.b, f.last, f.held, greatest(x.s, f.last) AS moved,
             coalesce(list_max(list_filter(range(1, least(len(f.held), len(x.b)) + 1), lambda k: list_slice(f.held, len(f.held) - k + 1, len(f.held)) = list_slice(x.b, 1, k))), 0) AS n
      FROM fold f JOIN ready x ON x.conv_id = f.conv_id AND x.rn = f.rn + 1
    )
  )
)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY rn) - 1)::INT AS place, start, end_ AS "end", said AS text FROM fold WHERE kept"""

_flat = lambda df: df.select("conv_id", F.posexplode("segments").alias("place", "x")).select("conv_id", "place", "x.*")
query("overlap_remove", _UNDONE)(lambda s, d: _flat(media.overlap_remove(_transcripts(s, d), "conv_id")))
query("asr_merge", _UNDONE)(lambda s, d: _flat(media.asr_merge(_transcripts(s, d), "conv_id")))


def _series(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "events").select(F.col("event_type").alias("group"), F.col("event_id").alias("t"), "value")


def _gains(lag: int = 1, value: str = "value") -> str:
    """Gains as SQL, to stand in front of a query as ``g``."""
    return f"""WITH m AS (SELECT event_type AS "group", event_id AS t, {value} AS value FROM events),
s AS (SELECT *, value - lag(value, {lag}) OVER w AS step, lead(value) OVER w - value AS next FROM m WINDOW w AS (PARTITION BY "group" ORDER BY t)),
g AS (SELECT *, sign(step) * next AS gain FROM s WHERE step IS NOT NULL AND next IS NOT NULL)"""


_SUM = 'count(*) AS n, round(sum(gain), 4) AS gain, round(avg(gain), 4) AS mean_gain'
_FOLDS = ', f AS (SELECT *, ntile(2) OVER (PARTITION BY "group" ORDER BY t) AS fold FROM g)'
_EVALUATIONS = {
    "benchmark": f'{_gains()} SELECT "group", count(*) AS n, round(sum(gain), 4) AS gain, round(sum(next), 4) AS held FROM g GROUP BY "group"',
    "compare": f"""SELECT "group", gain_a, gain_b, round(gain_b - gain_a, 4) AS difference FROM ({_gains(1)} SELECT "group", round(sum(gain), 4) AS gain_a FROM g GROUP BY "group")
JOIN ({_gains(2)} SELECT "group", round(sum(gain), 4) AS gain_b FROM g GROUP BY "group") USING ("group")""",
    "parameter_sweep": " UNION ALL ".join(f'SELECT * FROM ({_gains(k)} SELECT "group", {_SUM}, {k}::BIGINT AS lag FROM g GROUP BY "group")' for k in (1, 2)),
    "regression": f'{_gains()} SELECT "group", count(*) AS n, round(regr_slope(next, step), 4) AS slope, round(regr_intercept(next, step), 4) AS intercept FROM g GROUP BY "group"',
    "walk_forward": f'{_gains()}{_FOLDS} SELECT "group", fold, {_SUM} FROM f GROUP BY "group", fold',
    "oos": f'{_gains()}{_FOLDS} SELECT "group", {_SUM} FROM f WHERE fold = 2 GROUP BY "group"',
    "backtest": f"""{_gains()}, r AS (SELECT *, sum(gain) OVER o AS running FROM g WINDOW o AS (PARTITION BY "group" ORDER BY t)),
p AS (SELECT *, greatest(max(running) OVER o, 0) - running AS fall FROM r WINDOW o AS (PARTITION BY "group" ORDER BY t))
SELECT "group", count(*) AS n, round(sum(gain), 4) AS gain, round(max(fall), 4) AS drawdown FROM p GROUP BY p."group" """,
    "control": f'{_gains()} SELECT "group", count(*) AS n, round(-sum(gain), 4) AS gain, round(-avg(gain), 4) AS mean_gain FROM g GROUP BY "group"',
    "robustness": f'{_gains(1, "value * 1.01::DOUBLE")} SELECT "group", {_SUM} FROM g GROUP BY "group"',
}


def _evaluated(s: SparkSession, d: str, name: str) -> DataFrame:
    df = evaluation.evaluate(evaluation.SeriesAdapter(), f"replay_eval.{name}", _series(s, d), {})
    return df.withColumns({c: F.round(c, 4) for c, kind in df.dtypes if kind == "double"})


for name, sql in _EVALUATIONS.items():
    query(f"evaluation_{name}", sql)(lambda s, d, name=name: _evaluated(s, d, name))
query(
    "evaluation_replay",
    """WITH x AS (SELECT event_type AS "group", event_id AS t, value, sign(value - lag(value) OVER w)::DOUBLE AS signal, lead(value) OVER w - value AS next
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT "group", t, value, signal, round(next, 6) AS next, round(signal * next, 6) + 0.0 AS gain FROM x WHERE signal IS NOT NULL AND next IS NOT NULL""",
)(lambda s, d: _round_all(evaluation.evaluate(evaluation.SeriesAdapter(), "replay_eval.replay", _series(s, d), {}), "next", "gain"))

# plans

_SHARDS = "SELECT 'run' AS run_id, format('shard-{:06d}', i) AS shard_id, i AS ordinal, i * 10 AS start, least(i * 10 + 10, 6005) AS \"end\" FROM range(601) r(i)"


def _shards(s: SparkSession) -> DataFrame:
    return planning.plan_shards(s, "run", 0, 6005, 10, "d", "f")


query("plan_shards", _SHARDS)(lambda s, d: _shards(s).select("run_id", "shard_id", "ordinal", "start", "end"))
query("expanded_range", f"SELECT shard_id, greatest(start - 15, 0) AS read_start, \"end\" + 7 AS read_end FROM ({_SHARDS})")(
    lambda s, d: planning.expanded(_shards(s), {"lookback": 10, "halo_before": 5, "halo_after": 7}).select("shard_id", "read_start", "read_end")
)
query("plan_waves", f"SELECT shard_id, ordinal // 256 AS wave, format('wave-{{:04d}}', ordinal // 256) AS wave_id FROM ({_SHARDS})")(
    lambda s, d: planning.plan_waves(_shards(s), 300, 256).select("shard_id", "wave", "wave_id")
)


def _attempts(s: SparkSession, d: str) -> DataFrame:
    """Orders as attempts at shards: status from the order's, some on old input."""
    o = read(s, d, "orders")
    return o.select(
        F.format_string("shard-%06d", F.col("o_custkey") % 700).alias("shard_id"), F.col("o_orderkey").cast("string").alias("attempt_id"),
        F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, "d").otherwise("old").alias("input_digest"), F.lit("f").alias("fingerprint"),
        F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("finished_at"),
    )


_JUDGED = f"""SELECT s.shard_id, s.ordinal, count(o_orderkey) AS tried, count(*) FILTER (o_orderstatus = 'F') AS won
FROM ({_SHARDS}) s LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) o ON s.ordinal = o.o_custkey % 700 GROUP BY ALL"""
query("completeness", f"SELECT shard_id, ordinal, CASE WHEN won = 0 THEN 'missing' WHEN won = 1 THEN 'canonical' ELSE 'duplicate' END AS state FROM ({_JUDGED})")(
    lambda s, d: planning.completeness(_shards(s), _attempts(s, d)).drop("canonical_attempt")
)
query("retryable", f"SELECT shard_id, ordinal, tried FROM ({_JUDGED}) WHERE won = 0 AND tried < 3")(lambda s, d: planning.retryable(_shards(s), _attempts(s, d)))
query("exhausted", f"SELECT shard_id, ordinal, tried FROM ({_JUDGED}) WHERE won = 0 AND tried >= 3")(lambda s, d: planning.exhausted(_shards(s), _attempts(s, d)))


def _collection(s: SparkSession, d: str):
    """Parts as artifacts, suppliers' lines as requests, ships as deliveries."""
    from datetime import datetime

    artifacts = read(s, d, "part").select(F.col("p_partkey").cast("string").alias("digest"), F.col("p_size").cast("bigint").alias("size_bytes"), F.lit(datetime(1995, 1, 1)).alias("modified_at"))
    li = read(s, d, "lineitem")
    requests = li.select(F.col("l_orderkey").cast("string").alias("request_id"), F.col("l_partkey").cast("string").alias("digest")).distinct()
    deliveries = li.where("l_orderkey % 10 > 0").groupBy(F.col("l_orderkey").cast("string").alias("request_id")).agg(F.max(F.col("l_shipdate").cast("timestamp")).alias("delivered_at"))
    holds = read(s, d, "part").where("p_size > 45").select(F.col("p_partkey").cast("string").alias("digest"), F.lit("hold:large").alias("reason"))
    return artifacts, lifecycle.reachability([holds]), requests, deliveries, datetime(1998, 6, 1)


_REQ = "SELECT DISTINCT l_orderkey AS r, l_partkey AS p FROM lineitem"
_DEL = "SELECT l_orderkey AS r, max(l_shipdate) AS shipped FROM lineitem WHERE l_orderkey % 10 > 0 GROUP BY l_orderkey"
query(
    "gc_normal",
    f"""SELECT p_partkey::VARCHAR AS digest, p_size::BIGINT AS size_bytes, p_size <= 45 AND n > 0 AND late = 0 AS eligible
FROM part JOIN (SELECT p_partkey AS p, count(r) AS n, count(*) FILTER (r IS NOT NULL AND (shipped IS NULL OR TIMESTAMP '1998-06-01' < shipped + INTERVAL 7 DAY)) AS late
FROM part LEFT JOIN ({_REQ}) q ON q.p = p_partkey LEFT JOIN ({_DEL}) USING (r) GROUP BY p_partkey) ON p = p_partkey""",
)(lambda s, d: (lambda a, r, q, v, now: lifecycle.plan_normal(a, r, q, v, now, 604_800).drop("reasons"))(*_collection(s, d)))
query(
    "gc_legacy",
    f"""SELECT p_partkey::VARCHAR AS digest, p_size::BIGINT AS size_bytes, p_size <= 45 AND NOT EXISTS (SELECT 1 FROM ({_REQ}) q JOIN ({_DEL}) USING (r) WHERE q.p = p_partkey) AS eligible FROM part""",
)(
    lambda s, d: (lambda a, r, q, v, now: lifecycle.plan_legacy(a, r, q, v, a.select("digest", F.col("modified_at").alias("used_at")), now, 86_400).drop("reasons"))(*_collection(s, d))
)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
