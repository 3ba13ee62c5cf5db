import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weirflow import registry
from weirflow.contracts import ContractError
from weirflow.operators import models, text_features

TEXTS = ["the good film was good", "a bad bad film", "good good acting", "terrible bad plot", "a good plot", "bad acting here", "good fun film", "bad dull film"]


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame([(i, t, float(i % 2 == 0), f"g{i // 2}") for i, t in enumerate(TEXTS)], "doc_id long, text string, label double, group string").repartition(2)


def test_tfidf_equals_the_formula(spark):
    df = spark.createDataFrame(list(enumerate([*TEXTS, "", None])), "row_id long, text string")
    got = {(r.row_id, r.term): r.weight for r in text_features.tfidf(df).collect()}
    docs = {i: Counter(w for w in (t or "").lower().split() if len(w) > 1) for i, t in enumerate([*TEXTS, "", None])}
    df_ = Counter(w for c in docs.values() for w in c)
    for i, c in docs.items():
        raw = {w: n * (math.log((1 + len(docs)) / (1 + df_[w])) + 1) for w, n in c.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        for w, x in raw.items():
            assert got.pop((i, w)) == pytest.approx(x / length)
    assert not got
    top = {r.term for r in text_features.tfidf(df, max_features=2).collect()}
    assert top == {"good", "bad"}
    assert {r.term for r in text_features.tfidf(df.where("row_id = 1"), ngram_range=(1, 2)).collect()} == {"bad", "film", "bad bad", "bad film"}


def test_embedding_counts_code_points(spark):
    text = "Ab🙂é a"
    row = text_features.embedding(spark.createDataFrame([(text,), (None,)], "text string"), dimensions=8).collect()
    want = [0.0] * 8
    for c in text.lower():
        want[ord(c) % 8] += 1
    length = math.sqrt(sum(x * x for x in want))
    assert row[0].embedding == pytest.approx([x / length for x in want])
    assert row[1].embedding == [0.0] * 8


def test_hashing_equals_its_definition(spark):
    # published values of MurmurHash3 x86 32 with seed 0
    assert [int(x) & 0xFFFFFFFF for x in text_features.murmur3([b"", b"hello", b"hello, world", b"abc", b"The quick brown fox jumps over the lazy dog"])] == [0, 0x248BFA47, 0x149BBB7F, 0xB3DD93FA, 0x2E4FF723]
    texts = [*TEXTS, "", "no", "Übergrößen größer als zuvor, größer", "x"]
    for n in (4, 4096):
        got = text_features.hashing_vectorizer(spark.createDataFrame(list(enumerate(texts)), "row_id int, text string"), n_features=n).collect()
        for r in got:
            want = [0.0] * n
            for word in re.findall(r"\b\w\w+\b", texts[r.row_id].lower()):
                h = int(text_features.murmur3([word.encode()])[0])
                want[abs(h) % n] += 1 if h >= 0 else -1
            length = math.sqrt(sum(x * x for x in want)) or 1
            assert list(r.features.toArray()) == pytest.approx([x / length for x in want])


def test_hashing_has_unit_length(spark):
    rows = text_features.hashing_vectorizer(spark.createDataFrame([(t,) for t in TEXTS], "text string"), n_features=64).collect()
    assert all(r.features.size == 64 and r.features.norm(2) == pytest.approx(1) for r in rows)


def ngrams(text):
    out = []
    for word in " ".join(text.lower().split()).split():
        p = f" {word} "
        for n in (2, 3, 4):
            if len(p) <= n:
                out.append(p)
                break
            out += [p[i : i + n] for i in range(len(p) - n + 1)]
    return out


def test_char_scores_equal_the_formula(spark):
    model = [{"feature": "go", "idf": 1.5, "coefficient": 2.0}, {"feature": " ba", "idf": 2.0, "coefficient": -3.0}, {"feature": " a ", "idf": 1.0, "coefficient": 0.5}, {"feature": "film", "idf": 1.2, "coefficient": 0.1}]
    texts = [*TEXTS, "", "a", "  a\t\tb  GO  ", "é"]
    got = {r.row_id: r.score for r in text_features.char_wb_score(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "row_id string, text string"), model, -0.2).collect()}
    for i, t in enumerate(texts):
        c = Counter(ngrams(t))
        x = [(1 + math.log(c[m["feature"]])) * m["idf"] if c[m["feature"]] else 0.0 for m in model]
        n = math.sqrt(sum(v * v for v in x)) or 1
        z = -0.2 + sum(v / n * m["coefficient"] for v, m in zip(x, model, strict=True))
        assert got[str(i)] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)
    for bad in ([model[0], model[0]], [model[0] | {"idf": float("nan")}], [model[0] | {"coefficient": True}]):
        with pytest.raises(ContractError):
            text_features.char_wb_score(spark.createDataFrame([("1", "x")], "row_id string, text string"), bad, 0.0)


def test_similarity_and_matrix(spark):
    a = spark.createDataFrame([("x", [1.0, 0.0]), ("z", [0.0, 0.0]), ("y", [1.0, 1.0])], "row_id string, vector array<double>")
    matrix = {(r.left_id, r.right_id): r.similarity for r in text_features.cosine_similarity_matrix(a, a).collect()}
    assert matrix["x", "y"] == pytest.approx(math.sqrt(0.5)) and matrix["z", "x"] is None and matrix["x", "z"] is None and len(matrix) == 9
    plain = {(r.left_id, r.right_id): r.similarity for r in registry.run("ml.similarity", {}, data=a).collect()}
    assert plain["z", "z"] == 0.0 and plain["y", "y"] == pytest.approx(1)
    for bad in ([("x", [1.0]), ("x", [2.0])], [("", [1.0])], [("a", [1.0]), ("b", [1.0, 2.0])], [("a", [float("nan")])], [("a", None)]):
        with pytest.raises(ContractError):
            text_features.cosine_similarity_matrix(spark.createDataFrame(bad, "row_id string, vector array<double>"), a)


def metrics(truth, said):
    classes, n = sorted(set(truth) | set(said)), len(truth)
    p = r = f = 0.0
    for c in classes:
        hit = sum(a == b == c for a, b in zip(truth, said, strict=True))
        s, m = truth.count(c), said.count(c)
        p += s * (hit / m if m else 0) / n
        r += s * (hit / s if s else 0) / n
        f += s * (2 * hit / (s + m)) / n
    return {"accuracy": sum(a == b for a, b in zip(truth, said, strict=True)) / n, "precision": p, "recall": r, "f1": f}


def test_weighted_metrics_equal_the_formula(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(3), rng.randrange(4)) for _ in range(80)]
    got = models.weighted_metrics(spark.createDataFrame(pairs, "label int, prediction int")).first().asDict()
    assert got == pytest.approx(metrics([a for a, _ in pairs], [b for _, b in pairs]))


def test_threshold_sweep(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.2, 0), (0.8, 1), (0.5, 0), (1.0, 1)], "score double, label int")
    rows = {r.threshold: r.asDict() for r in models.threshold_sweep(df, thresholds=[0.25, 0.5, 0.95, 0.0]).collect()}
    data = df.collect()
    for t, r in rows.items():
        want = metrics([x.label for x in data], [int(x.score >= t) for x in data])
        assert {k: r[k] for k in want} == pytest.approx(want)
    small = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.2, 0), (0.8, 1)], "score double, label int")
    best = models.best_threshold(models.threshold_sweep(small, thresholds=[0.25, 0.5])).first()
    assert (best.threshold, best.f1) == (0.25, 1.0)
    for bad in ([(1.5, 0), (0.1, 1)], [(0.5, 1), (0.6, 1)]):
        with pytest.raises(ContractError):
            models.threshold_sweep(spark.createDataFrame(bad, "score double, label int"))


def test_splits_are_exact_and_repeat(labelled):
    split = models.train_test_split(labelled, test_size=0.25)
    assert {(r.label, r.is_test): r["count"] for r in split.groupBy("label", "is_test").count().collect()} == {(0.0, True): 1, (0.0, False): 3, (1.0, True): 1, (1.0, False): 3}
    again = models.train_test_split(labelled.repartition(5), test_size=0.25)
    assert sorted(split.where("is_test").select("doc_id").collect()) == sorted(again.where("is_test").select("doc_id").collect())
    folds = models.with_folds(labelled, 2).groupBy("fold", "label").count().collect()
    assert {r["count"] for r in folds} == {2}


def test_models_learn(spark, labelled):
    options = {"max_iter": 50, "C": 10.0}
    fit = models.train_test(labelled, test_size=0.25, **options)
    assert set(fit.metrics) == {"accuracy", "precision", "recall", "f1"} and fit.predictions.count() == 2
    scored = models.batch_inference(labelled, fit.model, 0.5)
    assert scored.where("passed = (label = 1)").count() >= 7
    held = models.group_holdout(labelled, **options)
    tested = {r.group for r in held.predictions.select("group").collect()}
    assert tested and len(tested) < 4
    cv = models.cross_validate(labelled, cv=2, **options)
    assert cv["folds"] == 2 and cv["mean_score"] == pytest.approx(sum(cv["scores"]) / 2)
    for method in ("sigmoid", "isotonic"):
        p = models.calibrate(labelled, method, cv=2, **options).transform(labelled)
        assert p.columns == [*labelled.columns, "probability_1"]
        assert all(0 <= r.probability_1 <= 1 for r in p.collect())
    table = text_features.hashing_vectorizer(labelled, n_features=64)
    for fit in (models.logistic_regression(table, C=10.0), models.sgd_classifier(table), models.sgd_classifier(table, loss="hinge")):
        assert fit.transform(table).where("prediction = label").count() >= 7
    with pytest.raises(ContractError):
        models.logistic_regression(table.where("label = 1"))
    with pytest.raises(ContractError):
        models.group_holdout(labelled.withColumn("group", F.col("label").cast("string")))


def test_ridge_logistic_is_at_the_minimum(spark):
    """Against Newton's method on the dense table; dense and sparse vectors give one result."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) * (rng.random((80, 6)) < 0.5) * [1, 1, 1, 0.01, 5, 0]
    y = (rng.random(80) < 1 / (1 + np.exp(-(x[:, 0] - x[:, 1] + 0.3)))).astype(float)
    penalty, w = 1 / (2.0 * 80), np.zeros(7)
    a = np.c_[x, np.ones(80)]
    ridge = np.diag([penalty] * 6 + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w = w - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) / 80 + ridge + 1e-12 * np.eye(7), a.T @ (p - y) / 80 + ridge @ w)
    for vector in (Vectors.dense, lambda r: Vectors.sparse(6, [(i, v) for i, v in enumerate(r) if v])):
        df = spark.createDataFrame([(vector(r), int(t)) for r, t in zip(x.tolist(), y, strict=True)], ["features", "label"])
        model = models.logistic_regression(df, C=2.0)
        assert model.coefficients.toArray() == pytest.approx(w[:-1], abs=5e-3) and model.intercept == pytest.approx(w[-1], abs=5e-3)
        probability = {tuple(r.features.toArray()): r.probability[1] for r in model.transform(df).collect()}
        assert [probability[tuple(r)] for r in x.tolist()] == pytest.approx(list(1 / (1 + np.exp(-a @ w))), abs=5e-3)


def test_pipelines_weigh_with_the_added_one(labelled):
    fitted = models.text_pipeline(8).fit(labelled)
    direct = {(r.doc_id, r.term): r.weight for r in text_features.tfidf(labelled, "doc_id").collect()}
    words = fitted.stages[1].vocabulary
    got = {(r.doc_id, words[i]): v for r in fitted.transform(labelled).collect() for i, v in zip(r._features.indices, r._features.values, strict=True)}
    assert got == pytest.approx(direct)


def test_clustering(spark):
    df = spark.createDataFrame([(i, [float(i // 5) * 10, float(i % 5)]) for i in range(10)], "row_id long, vector array<double>")
    out, centres = models.clustering(df, n_init=2)
    assert len({(r.row_id // 5, r.cluster) for r in out.collect()}) == 2 and len(centres) == 2
    assert models.clustering(df, n_clusters=1)[1] == [[5.0, 2.0]]
    with pytest.raises(ContractError):
        models.clustering(df, n_clusters=11)


def test_pair_scores(spark):
    seen = []

    def logits(ids, masks):
        return [[0.0, float(sum(m))] for m in masks]

    rows = [(f"r{i}", [1] * 4, [1] * (i % 4) + [0] * (4 - i % 4), [2] * 4, [1, 1, 1, 1]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id string, ids_a array<int>, mask_a array<int>, ids_b array<int>, mask_b array<int>")
    got = {r.row_id: r for r in models.pair_scores(df, logits, logits).collect()}
    assert len(got) == 300 and not seen
    assert got["r3"].score_a == pytest.approx(1 / (1 + math.exp(-3))) and got["r0"].score_b == pytest.approx(1 / (1 + math.exp(-4)))
    part = {"input_ids": [[1, 2]], "attention_mask": [[1, 0]]}
    models.check_pairs({"row_ids": ["a"], "model_a": part, "model_b": part})
    ids = [f"r{i}" for i in range(513)]
    for bad in ({"row_ids": ids}, {"row_ids": ["a", "a"]}, {"row_ids": ["a"], "model_a": part, "model_b": {"input_ids": [[1, 2]], "attention_mask": [[1, 2]]}}, {"row_ids": ["a"], "model_a": {"input_ids": [[1] * 257], "attention_mask": [[1] * 257]}, "model_b": part}):
        with pytest.raises(ContractError):
            models.check_pairs(bad)


def test_pair_sequences_hold_whole_texts(spark, tmp_path):
    from weirflow import queries

    texts = ["a" * 64 + "b" * 500, "a" * 64 + "c" * 500, "x" * 256, "y" * 257, "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in queries._pair_rows(spark, str(tmp_path)).collect():
        doc, place = map(int, r.row_id.split(":"))
        assert 1 <= len(r.ids_a) <= models.MAX_SEQUENCE and len(r.mask_a) == len(r.ids_a)
        found.setdefault(doc, {})[place] = r.ids_a
    for i, t in enumerate(texts):
        assert [x for _, part in sorted(found[i].items()) for x in part] == [ord(c) for c in t or "\0"]
    scores = {r.row_id: r.score_a for r in queries.queries()["pair_scores"](spark, str(tmp_path)).collect()}
    assert scores["0:1"] != scores["1:1"] and len(scores) == sum(map(len, found.values()))


def test_every_word_counts_unless_asked(spark):
    step = 30_000
    rows = [(float(i % 2), " ".join(f"w{k}" for k in range(i * step, i * step + step))) for i in range(9)]
    df = spark.createDataFrame(rows, "label double, text string")
    words = models.text_pipeline(9, max_iter=1).getStages()[:2]
    assert len(words[1].fit(words[0].transform(df)).vocabulary) == 9 * step > 1 << 18
    words = models.text_pipeline(9, max_features=7).getStages()[:2]
    assert len(words[1].fit(words[0].transform(df)).vocabulary) == 7


def test_queries_keep_the_operators_defaults(monkeypatch):
    from weirflow import queries

    seen = {}

    class Stop(Exception):
        pass

    def note(name):
        def run(*args, **options):
            seen.setdefault(name, []).append((len(args), options))
            raise Stop
        return run

    monkeypatch.setattr(queries, "_labelled", lambda s, d: None)
    monkeypatch.setattr(queries, "read", lambda s, d, name: None)
    names = ["train_test", "group_holdout", "cross_validate", "calibrate", "clustering", "train_test_hashing"]
    for name in names:
        with monkeypatch.context() as m:
            m.setattr(models, name.removesuffix("_hashing"), note(name))
            with pytest.raises(Stop):
                queries.queries()[name](None, "")
    assert {k: v[0][1] for k, v in seen.items()} == {n: {} for n in names[:-1]} | {"train_test_hashing": {"vectorizer": "hashing"}}
    assert seen["clustering"][0][0] == 3


def test_gradients_in_pieces_give_the_same_model(spark, labelled, monkeypatch):
    """The words themselves stay away from the driver, and a gradient of many pieces is summed before it gets there."""
    from weirflow.operators import linear

    whole = models.text_pipeline(8).fit(labelled)
    monkeypatch.setattr(linear, "PIECE", 3)
    cut = models.text_pipeline(8).fit(labelled)
    assert cut.stages[-1].coefficients.toArray() == pytest.approx(whole.stages[-1].coefficients.toArray(), abs=1e-9)
    known, idf = whole.stages[1].shared.value
    assert known.dtype == "int64" and len(known) == len(idf) == len(whole.stages[1].vocabulary)
    unseen = whole.transform(spark.createDataFrame([("never seen", 0.0), (None, 1.0)], "text string, label double")).collect()
    assert [r._features.numNonzeros() for r in unseen] == [0, 0]


def test_hashing_makes_no_python_row_of_a_vector(spark):
    table = text_features.hashing_vectorizer(spark.createDataFrame([("a bb bb",), (None,)], "text string"), n_features=8)
    assert "BatchEvalPython" not in table._jdf.queryExecution().executedPlan().toString()
    assert [r.features.numNonzeros() for r in table.collect()] == [1, 0]


def test_pair_scores_take_each_row_once(spark):
    """No pass over single Python objects in front of the scorers: the plan hands over Arrow batches."""
    df = spark.createDataFrame([("r", [1, 2, 4], [0, 1, 0], [2], [0])], "row_id string, ids_a array<int>, mask_a array<int>, ids_b array<int>, mask_b array<int>")
    out = models.pair_scores(df.repartition(2), lambda ids, masks: [[float(len(i)), float(sum(m))] for i, m in zip(ids, masks, strict=True)], lambda ids, masks: [[0.0, float(i[0])] for i in ids])
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    row = out.first()
    assert row.score_a == pytest.approx(1 / (1 + math.e)) and row.score_b == pytest.approx(1 / (1 + math.exp(-2)))


def test_tfidf_moves_texts_once_and_merges_equal_ids(spark, monkeypatch):
    monkeypatch.setattr(text_features, "BUCKET_CHARS", 20)
    df = spark.createDataFrame([(1, "aa bb"), (1, "aa cc"), (2, "bb"), (3, None), (None, "aa dd")], "row_id int, text string")
    out = text_features.tfidf(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    got = {(r.row_id, r.term): (r.tf, r.weight) for r in out.collect()}
    idf = {w: math.log(6 / (1 + n)) + 1 for w, n in {"aa": 2, "bb": 2, "cc": 1, "dd": 1}.items()}
    rows = {1: {"aa": 2, "bb": 1, "cc": 1}, 2: {"bb": 1}, None: {"aa": 1, "dd": 1}}
    for i, c in rows.items():
        length = math.sqrt(sum((n * idf[w]) ** 2 for w, n in c.items()))
        for w, n in c.items():
            assert got.pop((i, w)) == (n, pytest.approx(n * idf[w] / length))
    assert not got


def test_pairs_are_made_in_blocks(spark, monkeypatch):
    """Vectors of odd kinds beside the rest; the plan has no expression over single numbers of a pair."""
    monkeypatch.setattr(text_features, "BLOCK", 2)
    rows = [("a", [3.0, 4.0]), ("b", [4.0, -3.0]), ("n", None), ("m", [1.0, None]), ("s", [1.0]), ("e", []), ("z", [0.0, 0.0]), ("c", [6.0, 8.0])]
    df = spark.createDataFrame(rows, "row_id string, vector array<double>").repartition(2)
    out = text_features.similarity(df)
    assert "zip_with" not in out._jdf.queryExecution().executedPlan().toString() and "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.left_id, r.right_id): r.similarity for r in out.collect()}
    want = {(i, j): 0.0 for i, _ in rows for j, _ in rows} | {(i, j): 1.0 for i in "ac" for j in "ac"} | {("b", "b"): 1.0, ("s", "s"): 1.0}
    assert got == pytest.approx(want, abs=1e-12)


def test_char_scores_merge_equal_ids(spark):
    model = [{"feature": "aa", "idf": 1.0, "coefficient": 1.0}, {"feature": " b", "idf": 1.0, "coefficient": -2.0}]
    out = text_features.char_wb_score(spark.createDataFrame([("1", "aaaa b"), ("1", "b"), ("2", None)], "row_id string, text string"), model, 0.0)
    assert "Generate explode" not in out._jdf.queryExecution().executedPlan().toString()
    a, b = 1 + math.log(3), 1 + math.log(2)
    score = 1 / (1 + math.exp(-(a - 2 * b) / math.hypot(a, b)))
    assert sorted((r.row_id, round(r.score, 9)) for r in out.collect()) == [("1", round(score, 9))] * 2 + [("2", 0.5)]


def test_embedding_values_round_as_sql_does(spark, tmp_path):
    """41 / 640 ends in a 5 at the seventh place; as a double, a million times it lies under the half."""
    import duckdb

    from weirflow import queries

    n, k = 41, 640
    left, parts = k * k - n * n, []
    while left:
        parts.append(math.isqrt(left))
        left -= parts[-1] ** 2
    text = "p" * n + "".join(chr(97 + i) * c for i, c in enumerate(parts))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.slot: r.value for r in queries.queries()["fake_embedding"](spark, str(tmp_path)).collect()}
    assert got[0] == duckdb.sql(f"SELECT round({n}::DOUBLE / {k}, 6)").fetchall()[0][0] == 0.064062
