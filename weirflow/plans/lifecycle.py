"""Which artifacts may be deleted: reachability and collection plans as joins, deletion on the driver.

References: (digest, reason) of everything that still needs an artifact.
Artifacts: (digest, size_bytes, modified_at). Requests: (request_id, digest), the requests whose
output an artifact is. Deliveries: (request_id, delivered_at). Uses: (digest, used_at).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.contracts import ContractError
from weirflow.plans.store import _DIGEST, Store, canonical, component, publish

FINISHED = ("succeeded", "failed", "cancelled")


def reachability(references: Iterable[DataFrame]) -> DataFrame:
    """(digest, reasons): all reasons that protect each artifact, sorted."""
    every = reduce(DataFrame.unionByName, [r.select("digest", "reason") for r in references])
    return every.groupBy("digest").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def run_references(manifests: DataFrame, outputs: DataFrame, attempts: DataFrame) -> DataFrame:
    """(digest, reason) of runs: final outputs always, attempt outputs while the run is live.

    manifests: (run_id, status); outputs: (run_id, digest); attempts: (run_id, attempt_id, digest).
    """
    live = manifests.where(~F.col("status").isin(*FINISHED)).select("run_id")
    final = outputs.select("digest", F.concat(F.lit("manifest_final:"), "run_id").alias("reason"))
    tried = attempts.join(live, "run_id", "left_semi").select("digest", F.concat(F.lit("attempt:"), "attempt_id").alias("reason"))
    return final.unionByName(tried)


def plan_normal(artifacts: DataFrame, reachable: DataFrame, requests: DataFrame, deliveries: DataFrame, now: datetime, grace_seconds: int) -> DataFrame:
    """(digest, size_bytes, eligible, reasons): every request of it was delivered a grace ago or more."""
    due = F.col("delivered_at") + F.make_dt_interval(secs=F.lit(grace_seconds).cast("decimal(18,6)"))
    why = F.when(F.col("delivered_at").isNull(), F.concat(F.lit("undelivered:"), "request_id")).when(
        F.lit(now) < due, F.concat(F.lit("grace_pending:"), "request_id")
    )
    asked = requests.join(deliveries, "request_id", "left").groupBy("digest").agg(
        F.array_sort(F.filter(F.collect_list(why), lambda x: x.isNotNull())).alias("waits"), F.count(F.lit(1)).alias("asked")
    )
    joined = artifacts.join(reachable, "digest", "left").join(asked, "digest", "left")
    none = F.array().cast("array<string>")
    reasons = (
        F.when(F.size(F.coalesce("reasons", none)) > 0, F.col("reasons"))
        .when(F.coalesce("asked", F.lit(0)) == 0, F.array(F.lit("no_request")))
        .otherwise(F.col("waits"))
    )
    return joined.select("digest", "size_bytes", (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


def plan_legacy(artifacts: DataFrame, reachable: DataFrame, requests: DataFrame, deliveries: DataFrame, uses: DataFrame, now: datetime, retention_seconds: int) -> DataFrame:
    """(digest, size_bytes, eligible, reasons): no request of it has a delivery record, and its last
    use is a retention ago or more."""
    delivered = requests.join(deliveries, "request_id").groupBy("digest").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("has_delivery_record:"), "request_id"))).alias("delivered")
    )
    used = uses.groupBy("digest").agg(F.max("used_at").alias("used_at"))
    joined = artifacts.join(reachable, "digest", "left").join(delivered, "digest", "left").join(used, "digest", "left")
    last = F.greatest("modified_at", "used_at")
    early = F.lit(now) < last + F.make_dt_interval(secs=F.lit(retention_seconds).cast("decimal(18,6)"))
    none = F.array().cast("array<string>")
    waits = F.concat(F.coalesce("delivered", none), F.when(early, F.array(F.lit("retention_pending"))).otherwise(none))
    reasons = F.when(F.size(F.coalesce("reasons", none)) > 0, F.col("reasons")).otherwise(waits)
    return joined.select("digest", "size_bytes", (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))


@dataclass(frozen=True)
class Hold:
    hold_id: str
    kind: str
    digests: tuple[str, ...]
    reason: str = ""

    def __post_init__(self):
        component(self.hold_id)
        if self.kind not in ("preserve", "hold"):
            raise ContractError("kind must be preserve or hold")
        if not all(_DIGEST.fullmatch(d) for d in self.digests):
            raise ContractError("a hold names sha256 digests")


def hold_references(spark, holds: Iterable[Hold]) -> DataFrame:
    rows = [(d, f"hold:{h.hold_id}") for h in holds for d in h.digests]
    return spark.createDataFrame(rows, "digest string, reason string")


def collect_garbage(store: Store, digests: Iterable[str], still_eligible: Callable[[str], bool]) -> list[str]:
    """Delete artifacts so that a crash at any point can be finished by running it again.

    Under the store's lock, for each: write what is intended, check once more, unlink, write
    the receipt, drop the intention. Left-over intentions are finished first.
    """
    intents, receipts = store.root / "gc" / "intents", store.root / "gc" / "receipts"
    deleted = []
    with store.lock():
        left = [f"sha256:{p.stem}" for p in sorted(intents.glob("*.json"))] if intents.is_dir() else []
        for digest in dict.fromkeys([*left, *digests]):
            if not _DIGEST.fullmatch(digest):
                raise ContractError("a digest is sha256: and 64 hex digits")
            name = digest.removeprefix("sha256:")
            payload, intent, receipt = store.artifacts / name, intents / f"{name}.json", receipts / f"{name}.json"
            if receipt.exists() and not payload.exists():
                intent.unlink(missing_ok=True)
                continue
            began = intent.exists()
            if payload.exists() and not still_eligible(digest):
                intent.unlink(missing_ok=True)
                continue
            if not payload.exists() and not began:
                continue
            publish(intent, canonical({"digest": digest}).encode())
            Path(payload).unlink(missing_ok=True)
            publish(receipt, canonical({"digest": digest}).encode())
            intent.unlink(missing_ok=True)
            deleted.append(digest)
    return deleted
