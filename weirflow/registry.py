"""One name for each operation, and one way to run it."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from weirflow.contracts import ContractError, reject_code
from weirflow.operators import grid, html, media, models, replay, tabular, text_features
from weirflow.sources import fetch, tables

#: Operation name to (builder, inputs it takes). A builder takes its inputs, then parameters.
OPERATIONS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "tabular.normalize": (tabular.normalize, ("data",)),
    "tabular.cast": (tabular.cast, ("data",)),
    "tabular.sort": (tabular.sort, ("data",)),
    "tabular.dedup": (tabular.dedup, ("data",)),
    "tabular.join": (tabular.join, ("data", "right")),
    "tabular.pit_join": (tabular.pit_join, ("data", "right")),
    "tabular.window": (tabular.window, ("data",)),
    "tabular.rolling": (tabular.rolling, ("data",)),
    "tabular.statistics": (tabular.statistics, ("data",)),
    "tabular.format_migration": (lambda data, p, destination: tables.write(data, destination, tabular.FormatMigration.of(p).output_format), ("data",)),
    "replay.structural_canonicalize": (replay.canonicalize, ("data",)),
    "replay.structural_canonicalize_merge": (lambda data, right, p: replay.merge(data, right), ("data", "right")),
    "replay.event_window_extract": (replay.event_window, ("data",)),
    "replay.causal_grid_extract": (grid.causal_grid, ("data",)),
    "acquisition.rest": (lambda p, **more: fetch.acquire(p, **more), ()),
    "acquisition.html": (lambda p, **more: fetch.acquire(p, **more), ()),
    "acquisition.incremental": (lambda p, **more: fetch.acquire(p, **more), ()),
    "ml.tfidf": (lambda data, p: text_features.tfidf(data, **p), ("data",)),
    "ml.hashing_vectorizer": (lambda data, p: text_features.hashing_vectorizer(data, **p), ("data",)),
    "ml.logistic_regression": (lambda data, p: models.logistic_regression(data, **p), ("data",)),
    "ml.sgd_classifier": (lambda data, p: models.sgd_classifier(data, **p), ("data",)),
    "ml.train_test": (lambda data, p: models.train_test(data, **p), ("data",)),
    "ml.group_holdout": (lambda data, p: models.group_holdout(data, **p), ("data",)),
    "ml.cross_validate": (lambda data, p: models.cross_validate(data, **p), ("data",)),
    "ml.calibrate": (lambda data, p: models.calibrate(data, **p), ("data",)),
    "ml.threshold_sweep": (lambda data, p: models.threshold_sweep(data, **p), ("data",)),
    "ml.batch_inference": (lambda data, p, model: models.batch_inference(data, model, **p), ("data",)),
    "ml.embedding": (lambda data, p: text_features.embedding(data, **p), ("data",)),
    "ml.similarity": (lambda data, p, right=None: text_features.similarity(data, right, **p), ("data",)),
    "ml.clustering": (lambda data, p: models.clustering(data, **p), ("data",)),
    "ml.char_wb_tfidf_logistic_score": (lambda data, p: text_features.char_wb_score(data, **p), ("data",)),
    "ml.cosine_similarity_matrix": (lambda data, right, p: text_features.cosine_similarity_matrix(data, right, **p), ("data", "right")),
    "ml.distilbert_pair_binary_scores": (lambda data, p, score_a, score_b: models.pair_scores(data, score_a, score_b), ("data",)),
    "media.decode": (lambda data, p, **more: media.convert(data, "media.decode", **more), ("data",)),
    "media.extract_audio": (lambda data, p, **more: media.convert(data, "media.extract_audio", **more), ("data",)),
    "media.resample": (lambda data, p, **more: media.convert(data, "media.resample", p["sample_rate"], **more), ("data",)),
    "media.mono": (lambda data, p, **more: media.convert(data, "media.mono", **more), ("data",)),
    "media.asr_normalize_flac": (lambda data, p, **more: media.convert(data, "media.asr_normalize_flac", **more), ("data",)),
    "media.segment": (lambda data, p, **more: media.segment(data, p["duration_seconds"], **more), ("data",)),
    "media.merge": (lambda data, p, **more: media.merge(data, p["group"], p["order"], **more), ("data",)),
    "media.metadata": (lambda data, p, **more: media.metadata(data, **more), ("data",)),
    "media.overlap_remove": (lambda data, p: media.overlap_remove(data, p["key"]), ("data",)),
    "media.asr_merge": (lambda data, p: media.asr_merge(data, p["key"]), ("data",)),
}

#: Operations that compare a table with itself unless a second one is given.
OPTIONAL_RIGHT = ("ml.similarity",)


def run(operation: str, params: Mapping[str, Any] | None = None, *, data=None, right=None, **more):
    """Run an operation by name; parameters are checked before anything is read.

    ``more`` holds what parameters may not: row order, models, transports, runners.
    Operations named ``replay_eval.*`` need an adapter and go through ``evaluation.evaluate``.
    """
    if operation not in OPERATIONS:
        raise ContractError("unsupported operation")
    builder, needs = OPERATIONS[operation]
    params = dict(params or {})
    reject_code(params)
    inputs = {"data": data, "right": right}
    absent = [n for n in needs if inputs[n] is None]
    if absent:
        raise ContractError(f"operation needs {absent[0]}")
    if right is not None and "right" not in needs:
        if operation not in OPTIONAL_RIGHT:
            raise ContractError("operation takes one table")
        more["right"] = right
    return builder(*[inputs[n] for n in needs], params, **more)


def extract_html(pages, item_selector: str, fields: Mapping[str, str] | None = None):
    """Records out of pages that are already in a table."""
    return html.extract(pages, item_selector, fields)
