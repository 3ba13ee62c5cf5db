"""Ridge-penalised logistic regression by L-BFGS, and the stages of a text pipeline.

Spark's own solver scales every feature by its deviation and, for a penalty on the coefficients
as they are, scales the penalty back. Rare words then get penalties that differ by many orders
of magnitude, and its 500 iterations end before it converges. This one descends on the features
as they are. The rows are packed once into blocks of plain arrays, and a pass over the blocks sums
loss and gradient; what meets the driver is one number for each coefficient, and the result is an
ordinary Spark model. Words are known by 64-bit hashes, so that neither driver nor tasks hold them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators import text_features

#: Steps whose curvature is remembered; each is two vectors of coefficients on the driver.
MEMORY = 5


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """Where a smooth convex function is least: until no part of the gradient is above ``tol``."""
    value, g = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max(initial=0.0) <= tol:
            break
        d, weights = g.copy(), []
        for s, y in reversed(steps):
            weights.append((s @ d) / (s @ y))
            d -= weights[-1] * y
        if steps:
            s, y = steps[-1]
            d *= (s @ y) / (y @ y)
        else:
            d /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(steps, reversed(weights), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        slope, t = -(g @ d), 1.0
        while True:
            new = x - t * d
            new_value, new_g = f(new)
            if new_value <= value + 1e-4 * t * slope or t < 1e-10:
                break
            t /= 2
        s, y = new - x, new_g - g
        if s @ y > 1e-12 * (y @ y):
            steps = [*steps, (s, y)][-MEMORY:]
        if new_value >= value and t < 1e-10:
            break
        x, value, g = new, new_value, new_g
    return x


#: Coefficients that are summed as one piece; a larger gradient meets the driver only when summed.
PIECE = 1 << 16


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row of a column of arrays ends, and the values, both from 0."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, i, v, size) as a block for each batch: the arrays' bytes, its rows and the largest size."""
    for batch in batches:
        if batch.num_rows:
            ends, at = _flat(batch.column("i"))
            arrays = batch.column("y").to_numpy(zero_copy_only=False), ends.astype(np.int64), at.astype(np.int32), _flat(batch.column("v"))[1]
            size = max(batch.column("size").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(pa.array([a.tobytes()], pa.binary()) for a in arrays), pa.array([batch.num_rows]), pa.array([int(size)])], ["y", "ends", "i", "v", "n", "size"])


def _sums(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task, in pieces, the gradient by slot, then the intercept's, then the loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total = np.zeros(len(w) + 1)
        for batch in batches:
            for block in zip(*(batch.column(c) for c in ("y", "ends", "i", "v")), strict=True):
                y, ends, at, values = (np.frombuffer(x.as_buffer(), t) for x, t in zip(block, (float, np.int64, np.int32, float), strict=True))
                row = np.repeat(np.arange(len(y)), np.diff(ends))
                z = np.bincount(row, weights=w[at] * values, minlength=len(y)) + w[-1]
                total[-1] += np.logaddexp(0, -np.where(y > 0.5, z, -z)).sum()
                p = np.exp(-np.logaddexp(0, -z)) - y
                np.add.at(total, at, p[row] * values)
                total[-2] += p.sum()
        for k in range(0, len(total), PIECE):
            piece = total[k : k + PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // PIECE]), pa.array([piece.tobytes()], pa.binary())], ["piece", "x"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """The sum of the tasks' shares of one piece."""
    total = sum(np.frombuffer(x.as_buffer()) for x in table.column("x"))
    return pa.table({"piece": table.column("piece")[:1], "x": pa.array([total.tobytes()], pa.binary())})


class RidgeLogistic(Estimator):
    """Two classes, 0 and 1: mean log loss plus ``penalty`` / 2 times the squared coefficients, without the intercept."""

    def __init__(self, features: str, label: str, penalty: float, max_iter: int = 500, tol: float = 1e-4):
        super().__init__()
        self.features, self.label, self.penalty, self.max_iter, self.tol = features, label, penalty, max_iter, tol

    def _fit(self, dataset: DataFrame) -> LogisticRegressionModel:
        context = dataset.sparkSession.sparkContext
        vector = F.unwrap_udt(F.col(self.features))
        dense = F.filter(F.transform(vector["values"], lambda x, i: i), lambda i: vector["values"][i] != 0)
        sparse = vector["type"] == 0
        rows = dataset.select(
            F.col(self.label).cast("double").alias("y"), F.when(sparse, vector["indices"]).otherwise(dense).alias("i"),
            F.when(sparse, vector["values"]).otherwise(F.filter(vector["values"], lambda x: x != 0)).alias("v"),
            F.when(sparse, vector["size"]).otherwise(F.size(vector["values"])).alias("size"),
        )
        # a task's share of the gradient is as long as the gradient, so no more tasks than cores
        blocks = rows.mapInArrow(_packed, "y binary, ends binary, i binary, v binary, n long, size long").coalesce(context.defaultParallelism).persist()
        try:
            n, size = blocks.agg(F.sum("n"), F.max("size")).first()

            def f(w: np.ndarray) -> tuple[float, np.ndarray]:
                shared = context.broadcast(w)
                parts = blocks.select("y", "ends", "i", "v").mapInArrow(_sums(shared), "piece long, x binary")
                if len(w) >= PIECE:
                    parts = parts.groupBy("piece").applyInArrow(_added, "piece long, x binary")
                total = np.zeros(size + 2)
                for batch in parts.toArrow().to_batches():
                    for k, x in zip(batch.column("piece").to_pylist(), batch.column("x"), strict=True):
                        total[k * PIECE : (k + 1) * PIECE] += np.frombuffer(x.as_buffer())
                shared.destroy()
                total /= n
                g = total[:-1]
                g[:-1] += self.penalty * w[:-1]
                return total[-1] + self.penalty / 2 * (w[:-1] @ w[:-1]), g

            w = minimise(f, np.zeros(size + 1), self.max_iter, self.tol)
        finally:
            blocks.unpersist()
        made = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
            f"ridge_{id(self)}", _py2java(context, DenseVector(w[:-1])), float(w[-1])
        )
        return LogisticRegressionModel(made).setFeaturesCol(self.features)


class WordWeights(Estimator):
    """Arrays of words to vectors of counts times ``ln((1+n)/(1+df)) + 1``, of length 1.

    Every word counts, or the ``max_features`` that occur most, in alphabetical order among equals.
    """

    def __init__(self, words: str, output: str, max_features: int | None = None):
        super().__init__()
        self.words, self.output, self.max_features = words, output, max_features

    def _fit(self, dataset: DataFrame) -> WordWeightsModel:
        terms = dataset.select(F.explode(F.array_distinct(self.words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        if self.max_features is not None:
            total = dataset.select(F.explode(self.words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("total"))
            terms = terms.join(total.orderBy(F.desc("total"), "term").limit(self.max_features).select("term"), "term")
        n = dataset.count()
        for seed in range(64):
            found = terms.select(_hash(F.col("term"), seed).alias("h"), "df").toArrow()
            h, df = (found.column(c).to_numpy() for c in ("h", "df"))
            order = np.argsort(h)
            h = h[order]
            # no two words of the vocabulary may share a hash
            if (h[1:] != h[:-1]).all():
                break
        shared = dataset.sparkSession.sparkContext.broadcast((h, np.log((1 + n) / (1 + df[order])) + 1))
        return WordWeightsModel(self.words, self.output, terms, seed, shared)


def _hash(word: Column, seed: int) -> Column:
    return F.xxhash64(word, F.lit(seed))


class WordWeightsModel(Transformer):
    """Slots are by the rank of a word's hash; a word that was not fitted has none (but with a
    probability of the number of fitted words in 2 ** 64)."""

    def __init__(self, words: str, output: str, terms: DataFrame, seed: int, shared: Broadcast):
        super().__init__()
        self.words, self.output, self.terms, self.seed, self.shared = words, output, terms, seed, shared

    @property
    def vocabulary(self) -> list[str]:
        """The words by slot; only this brings them to the driver."""
        return [r.term for r in self.terms.orderBy(_hash(F.col("term"), self.seed)).select("term").collect()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shared = self.shared

        @F.arrow_udf(VectorUDT())
        def weighed(hashes: pa.Array) -> pa.Array:
            known, idf = shared.value
            ends, h = _flat(hashes)
            row = np.repeat(np.arange(len(hashes)), np.diff(ends))
            at = np.searchsorted(known, h)
            here = at < len(known)
            here[here] = known[at[here]] == h[here]
            return text_features.unit_vectors(len(hashes), len(known), row[here], at[here], idf[at[here]])

        return dataset.withColumn(self.output, weighed(F.transform(self.words, lambda w: _hash(w, self.seed))))


class Hashed(Transformer):
    """Texts to hashed unit vectors, as ``text_features.hashing_vectorizer`` makes them."""

    def __init__(self, text: str, output: str, n_features: int):
        super().__init__()
        self.text, self.output, self.n_features = text, output, n_features

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return text_features.hashing_vectorizer(dataset, self.text, self.n_features, self.output)
