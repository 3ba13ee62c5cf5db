import hashlib
import re

import pytest

from weirflow.llm import decontam

TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tok(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(TABLE))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = tok(t)
        for k in range(max(1, len(w) - 7)) if w else []:
            wins.append(("" if i is None else str(i), w[k : k + 8]))
    out = []
    for d, t in docs:
        w = tok(t)
        hit, names = set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if w[s : s + len(win)] == win:
                    hit |= set(range(s, s + len(win)))
                    names.add(i)
        ids = ",".join(sorted(names))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), len(names) >= 2))
    return sorted(out, key=str)


@pytest.fixture
def items(spark, docs, rng):
    texts = [r.text for r in docs.where("length(text) > 200").collect()]
    rows = []
    for i in range(12):
        w = rng.choice(texts).split()
        k = rng.randrange(max(1, len(w) - 20))
        rows.append((i * 3, " ".join(w[k : k + rng.randrange(1, 20)])))
    rows += [(10, "the7"), (10, "river1 stone2"), (11, "É ü 漢字"), (None, "word"), (12, None), (13, "..."), (14, "a a a"), (15, "never seen anywhere at all")]
    return spark.createDataFrame([(*r, "t") for r in rows], "item_id long, text string, terms string")


def test_rows_equal_brute_force(docs, items):
    got = sorted((tuple(r) for r in decontam.op6_rows(docs, items).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_few_letters_many_overlaps(spark, rng):
    docs = [(i, " ".join(rng.choice("abAB") for _ in range(rng.randrange(60)))) for i in range(80)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))) for i in range(15)]
    got = decontam.op6_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_joined_instead_of_broadcast(docs, items, monkeypatch):
    monkeypatch.setattr(decontam, "small", lambda df, *a: df)
    got = sorted((tuple(r) for r in decontam.op6_rows(docs, items).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha beta gamma"), (3, "gamma y y y y alpha beta"), (4, "beta alpha gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    near = {r.doc_id: [f.exact for f in r.found] for r in decontam.matches(docs, decontam.item_windows(items), slop=1).collect()}
    assert set(near) == {1, 2, 4} and any(near[2]) and not any(near[1]) and not any(near[4])
    assert {r.doc_id for r in decontam.matches(docs, decontam.item_windows(items)).collect()} == {2}


def test_a_window_that_many_items_and_documents_share(spark):
    common = "one two three four five six seven eight"
    docs = [(i, f"w{i} " * (i % 5) + common + " tail" * (i % 3)) for i in range(60)]
    items = [(i, f"x{i} {common}") for i in range(150)] + [(500, common), (501, "w3 " * 8)]
    got = decontam.op6_rows(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)


def test_empty_tables_and_dropping(docs, no_docs, items):
    assert decontam.op6_rows(no_docs, items).count() == 0
    assert decontam.op6_rows(docs, items.where("false")).where("n_hit > 0").count() == 0
    clean = decontam.drop_contaminated(docs, items)
    want = sum(r.n_items < 1 for r in decontam.op6_rows(docs, items).collect())
    assert clean.columns == docs.columns and clean.count() == want
