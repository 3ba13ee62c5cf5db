import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from weirflow.llm import near_dup
from weirflow.llm.components import components

from conftest import sentence


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    k = min(5, len(w))
    seen = Counter()
    out = []
    for i in range(len(w) - k + 1 if w else 0):
        s = tuple(w[i : i + k])
        seen[s] += 1
        out.append((s, seen[s]))
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def linked(a, b):
    if not a or not b or min(len(a), len(b)) < 0.8 * max(len(a), len(b)):
        return False  # no more than the shorter can be on the alignment
    on = lcs(a, b)
    return on >= 0.8 * (len(a) + len(b) - on)


def brute(rows):
    """Least id of each component of exact copies and links."""
    texts = sorted({t for _, t in rows if t is not None})
    label = {t: t for t in texts}

    def find(t):
        while label[t] != t:
            t = label[t]
        return t

    s = {t: shingles(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if linked(s[a], s[b]):
                label[find(a)] = find(b)
    least = defaultdict(list)
    for d, t in rows:
        if t is not None and d is not None:
            least[find(t)].append(d)
    return sorted(((d, d if t is None else min(least[find(t)], default=None)) for d, t in rows), key=str)


def edit(rng, text, n):
    w = text.split()
    for _ in range(n):
        at = rng.randrange(len(w))
        w[at : at + 1] = rng.choice([[], ["new" + str(rng.randrange(99))], [w[at], "more"]])
        w = w or ["x"]
    return " ".join(w)


def family(rng):
    """Families whose members reach from exact copies to far relatives."""
    rows = []
    for f in range(6):
        base = sentence(rng, rng.randrange(40, 120))
        for k in range(14):
            rows.append((len(rows) + 1, edit(rng, base, rng.choice([0, 0, 1, 1, 2, 4, 8, 20]))))
    return rows


def got(df):
    return sorted(((r.doc_id, r.class_id) for r in near_dup.op1_rows(df).collect()), key=str)


def test_classes_equal_brute_force(spark, rng):
    rows = family(rng)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_odd_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == brute(rows)
    result = near_dup.op1_rows(docs).collect()
    assert len(result) == len(rows)
    kept = near_dup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect() if r.text is not None]
    assert len(texts) == len(set(texts))


def test_large_group_of_near_copies_makes_few_comparisons(spark, rng, monkeypatch):
    base = sentence(rng, 300)
    rows = [(i, edit(rng, base, 1)) for i in range(300)]
    seen = []
    compare = near_dup._compare
    monkeypatch.setattr(near_dup, "_compare", lambda d, t, p: (seen.append(p.count()), compare(d, t, p))[1])
    assert {r.class_id for r in near_dup.op1_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert sum(seen) < 300 * 40


def test_recall_of_bands_at_the_threshold(rng):
    missed = 0
    for _ in range(200):
        w = np.array([rng.randrange(-(2**31), 2**31) for _ in range(200)], np.int32)
        v = w.copy()
        v[rng.sample(range(200), 4)] = 7
        a, b = near_dup.labelled_shingles(w), near_dup.labelled_shingles(v)
        missed += not len(np.intersect1d(near_dup.bands(a), near_dup.bands(b)))
    assert missed == 0


@pytest.mark.parametrize("n", [0, 1, 4, 5, 30, 120])
def test_alignment_equals_dynamic_programming(rng, n):
    for _ in range(20):
        a = [rng.randrange(6) for _ in range(n)]
        b = edit(rng, " ".join(map(str, a)), rng.randrange(3)).split() if a else []
        ids = {}
        code = lambda x: ids.setdefault(str(x), len(ids))
        sa, sb = (near_dup.labelled_shingles(np.array([code(x) for x in s], np.int32)) for s in (a, b))
        common, on = near_dup.aligned(sa, sb)
        ta, tb = shingles(" ".join(map(str, a))), shingles(" ".join(map(str, b)))
        assert common == len(set(ta) & set(tb))
        assert (len(sa) + len(sb) > 0 and on >= 0.8 * (len(sa) + len(sb) - on)) == linked(ta, tb)


def test_order_counts(spark, rng):
    a = sentence(rng, 60).split()
    parts = [a[i : i + 20] for i in (0, 20, 40)]
    moved = " ".join(parts[2] + parts[0] + parts[1])
    df = spark.createDataFrame([(1, " ".join(a)), (2, moved)], "doc_id long, text string")
    assert got(df) == [(1, 1), (2, 2)]


def test_components_equal_union_find(spark, rng):
    for n, m in ((40, 20), (60, 60), (300, 280)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(n, n + 40)] + [(None, 1)]
        label = list(range(n + 41))
        for _ in range(n + 41):
            for a, b in edges:
                if a is not None:
                    label[a] = label[b] = min(label[a], label[b])
        found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert all(label[k] == v for k, v in found.items())
        assert set(found) == {x for a, b in edges if a is not None and a != b for x in (a, b)}


def test_components_of_a_hub_and_of_nothing(spark, monkeypatch):
    from weirflow.llm import _common

    monkeypatch.setattr(_common, "HOT_KEYS", 100)  # the hub and its component are hot keys here
    edges = spark.range(1, 20_001).selectExpr("0 AS a", "id AS b").union(spark.range(30_000, 30_010).selectExpr("id AS a", "id + 1 AS b"))
    for limit in (0, 100_000):
        found = components(edges, limit)
        assert found.where("node <= 20000 AND label = 0").count() == 20_001
        assert found.where("node >= 30000 AND label = 30000").count() == 11
    assert components(edges.where("false")).count() == 0


def test_lookup_equals_a_join_whatever_the_keys(spark, monkeypatch):
    from weirflow.llm import _common

    monkeypatch.setattr(_common, "HOT_KEYS", 50)
    many = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id END AS k", "id")
    one = spark.range(500).selectExpr("id AS k", "id * 2 AS v").where("k <> 10")
    for how in ("inner", "left"):
        want = sorted(map(str, many.join(one, "k", how).collect()))
        for limit in (0, 1000):
            assert sorted(map(str, _common.lookup(many, one, "k", 499, how, limit).collect())) == want


def test_centre_meets_its_members_in_several_parts(spark, rng, monkeypatch):
    monkeypatch.setattr(near_dup, "MEMBERS", 3)
    rows = family(rng)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty_table(no_docs):
    assert near_dup.op1_rows(no_docs).count() == 0
    assert near_dup.keep_first(no_docs).count() == 0
