"""Evaluation operations that a project's adapter defines.

The operations have names and a closed-parameter guard; what they compute belongs to an
adapter object that the caller constructs. ``SeriesAdapter`` is a small one of our own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weirflow.contracts import RESERVED_KEYS, ContractError, reject_code

OPERATIONS = (
    "replay_eval.replay", "replay_eval.benchmark", "replay_eval.compare", "replay_eval.parameter_sweep", "replay_eval.regression",
    "replay_eval.walk_forward", "replay_eval.oos", "replay_eval.backtest", "replay_eval.control", "replay_eval.robustness",
    "replay_eval.external_api_evaluation",
)

#: Beside the keys that no operation takes: fixed values.
HOOK_KEYS = frozenset(("callback", "callable", "function", "handler"))

MAX_BODY, MAX_SECONDS = 16 * 1024 * 1024, 300


def check_params(operation: str, params: Mapping) -> dict:
    if operation not in OPERATIONS:
        raise ContractError("unsupported evaluation operation")
    if not isinstance(params, Mapping):
        raise ContractError("evaluation parameters must be a mapping")
    reject_code(params)

    def walk(value):
        if isinstance(value, Mapping):
            if (HOOK_KEYS | RESERVED_KEYS).intersection(value):
                raise ContractError("executable parameters are forbidden")
            for x in value.values():
                walk(x)
        elif isinstance(value, (list, tuple)):
            for x in value:
                walk(x)

    walk(params)
    return json.loads(json.dumps(params))


class Adapter(Protocol):
    operations: tuple[str, ...]

    def execute(self, operation: str, df: DataFrame, params: dict) -> DataFrame: ...


def evaluate(adapter: Adapter, operation: str, df: DataFrame, params: Mapping, profile: str = "offline") -> DataFrame:
    """Check the operation, its parameters and the security profile, then ask the adapter."""
    checked = check_params(operation, params)
    if (operation == "replay_eval.external_api_evaluation") != (profile == "external-api"):
        raise ContractError("the external-api profile goes with external evaluation, and only with it")
    if operation not in adapter.operations:
        raise ContractError("the adapter does not support this operation")
    return adapter.execute(operation, df, checked)


def external_evaluation(df: DataFrame, post: Callable[[bytes, float], bytes], body: str = "body", seconds: float = MAX_SECONDS) -> DataFrame:
    """(row's columns, answer): one bounded exchange of JSON objects for each row."""
    if not 0 < seconds <= MAX_SECONDS:
        raise ContractError("the time limit is 300 seconds")

    def run(batches):
        for pdf in batches:
            answers = []
            for text in pdf[body]:
                sent = text.encode()
                if len(sent) > MAX_BODY or not isinstance(json.loads(sent), dict):
                    raise ContractError("a request is one JSON object of at most 16 MiB")
                got = post(sent, seconds)
                if len(got) > MAX_BODY or not isinstance(json.loads(got), dict):
                    raise ContractError("an answer is one JSON object of at most 16 MiB")
                answers.append(got.decode())
            yield pdf.assign(answer=answers)

    return df.mapInPandas(run, StructType([*df.schema.fields, StructField("answer", StringType())]))


class SeriesAdapter:
    """Evaluates a value series by group: (group, t, value).

    A signal is the sign of the last ``lag`` step; its gain is the signal times the next step.

    =============== =====================================================================
    replay          every signal with its gain
    benchmark       gains by group beside those of an always rising signal, ``held``
    compare         gains of two lags by group, and their difference
    parameter_sweep gains by group for each of several lags
    regression      line of the next step over the last, by group
    walk_forward    gains by group and time fold
    oos             gains by group in the last fold alone
    backtest        gains by group, and the deepest fall of their running sum
    control         gains by group with every signal turned over
    robustness      gains by group after values are scaled by ``1 + shift``
    =============== =====================================================================
    """

    operations = tuple(o for o in OPERATIONS if o != "replay_eval.external_api_evaluation")

    def _gains(self, df: DataFrame, lag: int = 1) -> DataFrame:
        w = Window.partitionBy("group").orderBy("t")
        step = F.col("value") - F.lag("value", lag).over(w)
        moved = df.withColumns({"step": step, "next": F.lead("value").over(w) - F.col("value")})
        gains = moved.where("step IS NOT NULL AND next IS NOT NULL").withColumn("signal", F.signum("step"))
        return gains.withColumn("gain", F.col("signal") * F.col("next"))

    def _summary(self, gains: DataFrame, *by: str) -> DataFrame:
        return gains.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("gain").alias("gain"), F.avg("gain").alias("mean_gain"))

    def _folds(self, gains: DataFrame, folds: int) -> DataFrame:
        return gains.withColumn("fold", F.ntile(folds).over(Window.partitionBy("group").orderBy("t")).cast("long"))

    def execute(self, operation: str, df: DataFrame, params: dict) -> DataFrame:
        return getattr(self, "_" + operation.partition(".")[2])(df, params)

    def _replay(self, df: DataFrame, params: dict) -> DataFrame:
        return self._gains(df, int(params.get("lag", 1))).drop("step")

    def _benchmark(self, df: DataFrame, params: dict) -> DataFrame:
        gains = self._gains(df, int(params.get("lag", 1)))
        return gains.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("gain").alias("gain"), F.sum("next").alias("held"))

    def _parameter_sweep(self, df: DataFrame, params: dict) -> DataFrame:
        lags = [int(x) for x in params.get("lags", (1, 2))]
        parts = [self._summary(self._gains(df, k), "group").withColumn("lag", F.lit(k).cast("long")) for k in lags]
        return reduce(DataFrame.unionByName, parts)

    def _compare(self, df: DataFrame, params: dict) -> DataFrame:
        a, b = (int(x) for x in params.get("lags", (1, 2)))
        of = lambda lag, name: self._gains(df, lag).groupBy("group").agg(F.sum("gain").alias(name))
        both = of(a, "gain_a").join(of(b, "gain_b"), "group", "full_outer")
        return both.withColumn("difference", F.col("gain_b") - F.col("gain_a"))

    def _regression(self, df: DataFrame, params: dict) -> DataFrame:
        gains = self._gains(df, int(params.get("lag", 1)))
        return gains.groupBy("group").agg(
            F.count(F.lit(1)).alias("n"), F.regr_slope("next", "step").alias("slope"), F.regr_intercept("next", "step").alias("intercept")
        )

    def _walk_forward(self, df: DataFrame, params: dict) -> DataFrame:
        return self._summary(self._folds(self._gains(df, int(params.get("lag", 1))), int(params.get("folds", 2))), "group", "fold")

    def _oos(self, df: DataFrame, params: dict) -> DataFrame:
        folds = int(params.get("folds", 2))
        return self._summary(self._folds(self._gains(df, int(params.get("lag", 1))), folds).where(F.col("fold") == folds), "group")

    def _backtest(self, df: DataFrame, params: dict) -> DataFrame:
        so_far = Window.partitionBy("group").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
        gains = self._gains(df, int(params.get("lag", 1))).withColumn("running", F.sum("gain").over(so_far))
        fall = F.greatest(F.max("running").over(so_far), F.lit(0.0)) - F.col("running")
        fell = gains.withColumn("fall", fall)
        return fell.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("gain").alias("gain"), F.max("fall").alias("drawdown"))

    def _control(self, df: DataFrame, params: dict) -> DataFrame:
        return self._summary(self._gains(df, int(params.get("lag", 1))).withColumn("gain", -F.col("gain")), "group")

    def _robustness(self, df: DataFrame, params: dict) -> DataFrame:
        shift = float(params.get("shift", 0.01))
        return self._summary(self._gains(df.withColumn("value", F.col("value") * (1 + shift)), int(params.get("lag", 1))), "group")
