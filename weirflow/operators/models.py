"""Classifiers, splits, calibration, metrics, inference and clustering on Spark ML.

Logistic models of two classes are fitted by ``linear``, others by Spark's optimisers; objectives,
splits and metrics are as named.
Splits are by hash, so they repeat for a seed whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.contracts import ContractError
from weirflow.operators.linear import Hashed, RidgeLogistic, WordWeights
from weirflow.operators.text_features import WORD


def check_labels(df: DataFrame, label: str = "label") -> int:
    """Rows of a labelled table; raises without two classes or with a missing label."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes"), F.count_if(F.col(label).isNull()).alias("missing")).first()
    if r["missing"]:
        raise ContractError("a label is missing")
    if r["classes"] < 2:
        raise ContractError("at least two label classes are required")
    return r["n"]


def _classes(df: DataFrame, label: str) -> int:
    return df.select(label).distinct().count()


def logistic_regression(df: DataFrame, features: str = "features", label: str = "label", max_iter: int = 500, C: float = 1.0) -> Model:
    """Ridge-penalised logistic regression; ``C`` is the inverse penalty on the summed loss.

    Labels 0 and 1 take our own solver; more classes take Spark's.
    """
    n = check_labels(df, label)
    if _classes(df, label) == 2:
        return RidgeLogistic(features, label, 1 / (C * n), max_iter).fit(df)
    return LogisticRegression(featuresCol=features, labelCol=label, maxIter=max_iter, regParam=1 / (C * n), elasticNetParam=0.0, standardization=False).fit(df)


def sgd_classifier(df: DataFrame, features: str = "features", label: str = "label", loss: str = "log_loss", alpha: float = 1e-4, max_iter: int = 1000, tol: float = 1e-3) -> Model:
    """The objective of a stochastic-gradient linear classifier, fitted by full-batch descent: it
    ends at the least loss, where steps one row at a time end near it."""
    check_labels(df, label)
    if loss == "log_loss" and _classes(df, label) == 2:
        return RidgeLogistic(features, label, alpha, max_iter, tol).fit(df)
    kind = {"log_loss": LogisticRegression, "hinge": LinearSVC}.get(loss)
    if kind is None:
        raise ContractError("loss must be log_loss or hinge")
    return kind(featuresCol=features, labelCol=label, maxIter=max_iter, tol=tol, regParam=alpha, standardization=False).fit(df)


def text_pipeline(n: int, text: str = "text", label: str = "label", vectorizer: str = "tfidf", classifier: str = "logistic_regression", n_features: int = 4096, max_features: int | None = None, C: float = 1.0, max_iter: int = 500, alpha: float = 1e-4, tol: float = 1e-3) -> Pipeline:
    """Words to a unit vector to a linear classifier of labels 0 and 1, fitted on ``n`` rows.

    Every word counts unless ``max_features`` is given. The driver holds a hash, a weight and a
    coefficient of each word.
    """
    if vectorizer == "tfidf":
        words = SQLTransformer(statement=f"SELECT *, regexp_extract_all(lower(coalesce({text}, '')), '{WORD.replace(chr(92), chr(92) * 2)}', 0) AS _words FROM __THIS__")
        stages = [words, WordWeights("_words", "_features", max_features)]
    elif vectorizer == "hashing":
        stages = [Hashed(text, "_features", n_features)]
    else:
        raise ContractError("vectorizer must be tfidf or hashing")
    if classifier == "logistic_regression":
        last = RidgeLogistic("_features", label, 1 / (C * max(n, 1)), max_iter)
    elif classifier == "sgd_classifier":
        last = RidgeLogistic("_features", label, alpha, 1000, tol)
    else:
        raise ContractError("classifier must be logistic_regression or sgd_classifier")
    return Pipeline(stages=[*stages, last])


def weighted_metrics(df: DataFrame, truth: str = "label", predicted: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall and f1, averaged by class size; 0 where a class has no prediction.

    Everything comes from the confusion counts, one small row for each pair of classes.
    """
    t, p = F.col(truth).cast("string"), F.col(predicted).cast("string")
    confusion = df.groupBy(*by, t.alias("t"), p.alias("p")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = confusion.select(*by, F.explode(F.array(
        F.struct(F.col("t").alias("c"), F.col("n").alias("support"), F.lit(0.0).alias("said"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0.0).alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0.0).alias("support"), F.col("n").alias("said"), F.lit(0.0).alias("hit")),
    )).alias("x"))
    classes = cells.groupBy(*by, "x.c").agg(F.sum("x.support").alias("support"), F.sum("x.said").alias("said"), F.sum("x.hit").alias("hit"))
    zero = F.lit(0.0)
    precision = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(zero)
    recall = F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(zero)
    f1 = F.when(F.col("hit") > 0, 2 * F.col("hit") / (F.col("said") + F.col("support"))).otherwise(zero)
    total = F.sum("support")
    return classes.groupBy(*by).agg(
        (F.sum("hit") / total).alias("accuracy"), (F.sum(precision * F.col("support")) / total).alias("precision"),
        (F.sum(recall * F.col("support")) / total).alias("recall"), (F.sum(f1 * F.col("support")) / total).alias("f1"),
    )


#: 0.00, 0.05, ... 1.00
DEFAULT_THRESHOLDS = tuple(round(k * 0.05, 2) for k in range(21))


def threshold_sweep(df: DataFrame, score: str = "score", label: str = "label", thresholds: Sequence[float] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Weighted metrics of ``score >= threshold`` at each threshold, for labels 0 and 1.

    One pass: a row adds 1 to the cell of its label and the number of thresholds at or under
    its score; what each threshold needs is a running sum over at most that many cells.
    """
    cuts = sorted(float(t) for t in thresholds)
    r = df.agg(F.count_if(F.col(score).isNull() | ~F.col(score).between(0, 1)).alias("bad")).first()
    if r["bad"]:
        raise ContractError("scores must be probabilities in [0, 1]")
    check_labels(df, label)
    passed = reduce(lambda a, b: a + b, [(F.col(score) >= t).cast("int") for t in cuts])
    cells = df.groupBy(passed.alias("k")).agg(F.count_if(F.col(label).cast("int") == 1).alias("pos"), F.count_if(F.col(label).cast("int") != 1).alias("neg"))
    grid = df.sparkSession.createDataFrame(list(enumerate(cuts, 1)), "k int, threshold double")
    table = grid.select("k", "threshold", F.lit(0).cast("bigint").alias("pos"), F.lit(0).cast("bigint").alias("neg")).unionByName(
        cells.select("k", F.lit(None).cast("double").alias("threshold"), "pos", "neg")
    )
    above, everything = Window.orderBy("k").rangeBetween(0, Window.unboundedFollowing), Window.partitionBy()
    d = lambda c: c.cast("double")
    counted = table.select(
        "threshold", d(F.sum("pos").over(above)).alias("tp"), d(F.sum("neg").over(above)).alias("fp"),
        d(F.sum("pos").over(everything)).alias("p"), d(F.sum("neg").over(everything)).alias("n"),
    ).where("threshold IS NOT NULL")
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "p", "n"))
    tn, fn = neg - fp, pos - tp
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    total = pos + neg
    mean = lambda one, zero: (one * pos + zero * neg) / total
    return counted.select(
        "threshold", ((tp + tn) / total).alias("accuracy"),
        mean(safe(tp, tp + fp), safe(tn, tn + fn)).alias("precision"), mean(safe(tp, pos), safe(tn, neg)).alias("recall"),
        mean(safe(2 * tp, 2 * tp + fp + fn), safe(2 * tn, 2 * tn + fp + fn)).alias("f1"),
    )


def best_threshold(swept: DataFrame, metric: str = "f1") -> DataFrame:
    """The row with the greatest metric, the smallest threshold on ties."""
    return swept.orderBy(F.desc(metric), "threshold").limit(1)


def _hash_order(id_col: str, seed: int) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))


def train_test_split(df: DataFrame, id_col: str = "doc_id", label: str | None = "label", test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """Adds ``is_test``: the rounded-up share of each label (or of all rows) that hashes lowest."""
    by = [label] if label else []
    # ids alone are put in order; the texts stay where they are
    window = Window.partitionBy(*by)
    place = F.row_number().over(window.orderBy(_hash_order(id_col, seed), id_col))
    sides = df.select(id_col, *by).withColumn("is_test", place <= F.ceil(F.count(F.lit(1)).over(window) * test_size))
    return df.join(sides.groupBy(id_col).agg(F.min("is_test").alias("is_test")), id_col)


@dataclass
class Fitted:
    model: PipelineModel
    metrics: dict
    predictions: DataFrame


def _fit_and_score(train: DataFrame, test: DataFrame, label: str, **options) -> Fitted:
    model = text_pipeline(train.count(), label=label, **options).fit(train)
    predicted = model.transform(test)
    return Fitted(model, weighted_metrics(predicted, label).first().asDict(), predicted)


def train_test(df: DataFrame, id_col: str = "doc_id", label: str = "label", test_size: float = 0.25, seed: int = 0, stratify: bool = True, **options) -> Fitted:
    """Fit on the training part, weighted metrics and predictions on the rest."""
    check_labels(df, label)
    split = train_test_split(df, id_col, label if stratify else None, test_size, seed)
    return _fit_and_score(split.where("NOT is_test"), split.where("is_test"), label, **options)


def group_holdout(df: DataFrame, group: str = "group", label: str = "label", test_size: float = 0.25, seed: int = 0, splits: int = 16, **options) -> Fitted:
    """Hold out whole groups; of up to ``splits`` shuffles the first with both classes on both sides."""
    check_labels(df, label)
    # classes by group are small: one row for each pair
    sides = df.select(group, label).distinct()
    groups = sides.select(group).distinct()
    n = groups.count()
    for k in range(splits):
        taken = groups.withColumn("is_test", F.row_number().over(Window.orderBy(_hash_order(group, seed + k), group)) <= max(1, round(n * test_size)))
        classes = sides.join(taken, group).groupBy("is_test").agg(F.count_distinct(label).alias("c")).collect()
        if len(classes) == 2 and min(r["c"] for r in classes) > 1:
            split = df.join(F.broadcast(taken), group)
            return _fit_and_score(split.where("NOT is_test"), split.where("is_test"), label, **options)
    raise ContractError("groups cannot produce a holdout with both label classes")


def with_folds(df: DataFrame, folds: int, id_col: str = "doc_id", label: str = "label", seed: int = 0) -> DataFrame:
    """Adds ``fold``: labels dealt out in turn in hash order."""
    if folds < 2:
        raise ContractError("cv must be at least 2")
    place = F.row_number().over(Window.partitionBy(label).orderBy(_hash_order(id_col, seed), id_col))
    dealt = df.select(id_col, label).withColumn("fold", F.pmod(place, F.lit(folds)))
    return df.join(dealt.groupBy(id_col).agg(F.min("fold").alias("fold")), id_col)


def cross_validate(df: DataFrame, cv: int = 3, scoring: str = "accuracy", id_col: str = "doc_id", label: str = "label", **options) -> dict:
    """scores of each fold, their mean, and the number of folds."""
    check_labels(df, label)
    dealt = with_folds(df, cv, id_col, label).persist()
    scores = [
        _fit_and_score(dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k), label, **options).metrics[scoring] for k in range(cv)
    ]
    dealt.unpersist()
    return {"scores": scores, "mean_score": sum(scores) / cv, "folds": cv}


@dataclass
class Calibrated:
    """Averages the calibrated probabilities of one model for each fold."""

    parts: list[tuple[PipelineModel, Model, str]]

    def transform(self, df: DataFrame, output: str = "probability_1") -> DataFrame:
        scored = df
        names = []
        for k, (model, link, method) in enumerate(self.parts):
            extra = [c for c in model.transform(df.limit(0)).columns if c not in df.columns]
            raw = model.transform(scored).withColumn("_score", vector_to_array("rawPrediction")[1]).drop(*extra)
            name = f"_p{k}"
            names.append(name)
            if method == "sigmoid":
                a, b = link.coefficients[0], link.intercept
                scored = raw.withColumn(name, 1 / (1 + F.exp(-(F.col("_score") * float(a) + float(b))))).drop("_score")
            else:
                scored = link.transform(raw).withColumnRenamed("prediction", name).drop("_score")
        mean = reduce(lambda x, y: x + y, [F.col(n) for n in names]) / len(names)
        return scored.withColumn(output, mean).drop(*names)


def calibrate(df: DataFrame, method: str = "sigmoid", cv: int = 3, id_col: str = "doc_id", label: str = "label", **options) -> Calibrated:
    """Out-of-fold scores to probabilities by a sigmoid or an isotonic step function."""
    check_labels(df, label)
    dealt = with_folds(df, cv, id_col, label).cache()
    parts = []
    for k in range(cv):
        train, rest = dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k)
        model = text_pipeline(train.count(), label=label, **options).fit(train)
        scored = model.transform(rest).select(F.col(label).cast("double").alias("y"), vector_to_array("rawPrediction")[1].alias("_score"))
        if method == "sigmoid":
            table = VectorAssembler(inputCols=["_score"], outputCol="x").transform(scored)
            parts.append((model, LogisticRegression(featuresCol="x", labelCol="y").fit(table), method))
        elif method == "isotonic":
            parts.append((model, IsotonicRegression(featuresCol="_score", labelCol="y").fit(scored), method))
        else:
            raise ContractError("method must be sigmoid or isotonic")
    dealt.unpersist()
    return Calibrated(parts)


def batch_inference(df: DataFrame, model: Model, threshold: float | None = None) -> DataFrame:
    """Adds ``prediction`` and ``probabilities``; with a threshold also ``passed``.

    The probability that meets the threshold is that of class 1, or the greatest of several.
    """
    scored = model.transform(df).withColumn("probabilities", vector_to_array("probability"))
    if threshold is None:
        return scored
    positive = F.when(F.size("probabilities") == 2, F.col("probabilities")[1]).otherwise(F.array_max("probabilities"))
    return scored.withColumn("positive", positive).withColumn("passed", F.col("positive") >= threshold)


def clustering(df: DataFrame, vector: str = "vector", n_clusters: int = 2, n_init: int = 10, seed: int = 0) -> tuple[DataFrame, list]:
    """(rows with ``cluster``, centres) of the best of ``n_init`` seeds."""
    from pyspark.ml.functions import array_to_vector

    n = df.count()
    if not 1 <= n_clusters <= n:
        raise ContractError("n_clusters must be between 1 and the number of samples")
    table = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))).cache()
    if n_clusters == 1:
        width = table.select(F.size(vector)).first()[0]
        centre = table.agg(*[F.avg(F.col(vector)[i]) for i in range(width)]).first()
        return table.drop("_v").withColumn("cluster", F.lit(0)), [list(centre)]
    fits = [KMeans(featuresCol="_v", predictionCol="cluster", k=n_clusters, seed=seed + i).fit(table) for i in range(n_init)]
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(table).drop("_v"), [c.tolist() for c in best.clusterCenters()]


#: Bounds of one request to the pair scorer: fixed values.
MAX_PAIR_ROWS, MAX_SEQUENCE, PAIR_BATCH = 512, 256, 128


def sequences(ids: Column) -> Column:
    """Token ids cut into consecutive sequences of at most ``MAX_SEQUENCE``; none for no token."""
    starts = F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / MAX_SEQUENCE).cast("int"))
    cut = F.transform(starts, lambda k: F.slice(ids, k * MAX_SEQUENCE + 1, F.lit(MAX_SEQUENCE)))
    return F.when(F.size(ids) > 0, cut).otherwise(F.array().cast("array<array<int>>"))


def check_pairs(payload: dict) -> None:
    """Row ids and two models' padded token ids and masks, within the request's bounds."""
    ids = payload.get("row_ids")
    if not isinstance(ids, list) or not 1 <= len(ids) <= MAX_PAIR_ROWS or len(set(ids)) != len(ids) or not all(isinstance(i, str) and i for i in ids):
        raise ContractError(f"row_ids must be 1 to {MAX_PAIR_ROWS} unique names")
    for name in ("model_a", "model_b"):
        part = payload.get(name) or {}
        tokens, masks = part.get("input_ids"), part.get("attention_mask")
        if not tokens or not masks or len(tokens) != len(ids) or len(masks) != len(ids):
            raise ContractError(f"{name} needs a sequence and mask for each row")
        size = len(tokens[0])
        if not 1 <= size <= MAX_SEQUENCE or any(len(t) != size or len(m) != size for t, m in zip(tokens, masks, strict=True)):
            raise ContractError(f"{name} sequences must share a length of at most {MAX_SEQUENCE}")
        if any(x not in (0, 1) for m in masks for x in m) or any(isinstance(x, bool) or not isinstance(x, int) or x < 0 for t in tokens for x in t):
            raise ContractError(f"{name} has bad token ids or masks")


def pair_scores(df: DataFrame, score_a: Callable, score_b: Callable) -> DataFrame:
    """(row_id, score_a, score_b): softmax of class 1 by two injected models.

    Rows have row_id, ids_a, mask_a, ids_b, mask_b. A scorer takes lists of ids and masks, cut
    to the longest mask of its batch, and returns two logits a row.
    """

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ends = column.offsets.to_numpy()
        return ends - ends[0], column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIR_BATCH):
                part = batch.slice(at, PAIR_BATCH)
                out = [part.column("row_id")]
                for name, score in (("a", score_a), ("b", score_b)):
                    (ends, masks), (starts, ids) = lists(part.column(f"mask_{name}")), lists(part.column(f"ids_{name}"))
                    set_at = np.flatnonzero(masks)
                    # places of the set parts of masks in their rows
                    longest = max(1, int((set_at - ends[np.searchsorted(ends, set_at, "right") - 1]).max(initial=0)) + 1)
                    ids, masks = ids.tolist(), masks.tolist()
                    logits = np.asarray(score([ids[i : min(i + longest, j)] for i, j in pairwise(starts)], [masks[i : min(i + longest, j)] for i, j in pairwise(ends)]), dtype=float)
                    e = np.exp(logits - logits.max(axis=1, keepdims=True))
                    out.append(pa.array(e[:, 1] / e.sum(axis=1)))
                yield pa.RecordBatch.from_arrays(out, ["row_id", "score_a", "score_b"])

    columns = ("row_id", "ids_a", "mask_a", "ids_b", "mask_b")
    return df.select(*columns).mapInArrow(run, "row_id string, score_a double, score_b double")
