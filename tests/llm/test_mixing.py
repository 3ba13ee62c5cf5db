import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from weirflow.llm import mixing


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing, capping and sharing the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        open_w = sum(w[s] for s in order if s not in full)
        target = {s: Fraction(cap * sizes[s]) if s in full else Fraction(rest * w[s], open_w) for s in order}
        over = {s for s in order if s not in full and target[s] >= cap * sizes[s]}
        if not over:
            return target
        full |= over


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(df):
    rows, got = df.collect(), mixing.op4_rows(df).collect()
    size = Counter()
    for r in rows:
        size[r.source] += words(r.text)
    target = fill(dict(size)) if size else {}
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    taken, longest = Counter(), Counter()
    assert len(got) == len(rows)
    for g in got:
        r = next(x for x in by_id[g.doc_id] if words(x.text) == g["size"] and size[x.source] == g.source_size)
        assert g.target == pytest.approx(float(target[r.source]))
        assert 0 <= g.taken <= 3 * g["size"]
        taken[r.source] += g.taken
        longest[r.source] = max(longest[r.source], g["size"])
    return taken, target, longest


def test_targets_and_takings(docs):
    taken, target, longest = check(docs)
    for s in target:
        assert abs(taken[s] - target[s]) <= 2 * longest[s]


def test_many_even_documents_come_very_near(spark, rng):
    rows = [(i, " ".join(["w"] * rng.randrange(5, 40)), f"s{min(i % 9, 4)}") for i in range(2000)]
    taken, target, longest = check(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for s in target:
        assert abs(taken[s] - target[s]) <= longest[s] / 2 + 1


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 1000, None: 3}, {"a": 0, "b": 5}, {"é": 3, "z": 400, "Z": 9, "a": 1}, {"a": 7, "b": 7, "c": 7, "d": 7}, {"a": 0}])
def test_targets_alone(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    if sum(sizes.values()) == 0:
        assert got == {s: 0 for s in sizes}
        return
    assert got == pytest.approx({s: float(t) for s, t in fill(sizes).items()})
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_reruns_agree_with_each_other_and_with_sql(spark, rng):
    rows = [(i, " ".join(["w"] * int(rng.paretovariate(0.7) % 3000)), rng.choice("aaabbc")) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    shape = lambda d: sorted(tuple(r) for r in mixing.op4_rows(d).collect())
    documents = df.toPandas()  # noqa: F841
    want = sorted(tuple(r) for r in duckdb.sql(mixing.ORACLE).fetchall())
    assert shape(df) == shape(df.repartition(9)) == want


def test_mixed_documents_are_the_taken_ones(docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.op4_rows(docs).where("size > 0").collect():
        want[r.doc_id] += r.taken // r["size"]
    got = Counter(r.doc_id for r in mixed.collect() if words(r.text))
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_empty_table(no_docs):
    assert mixing.op4_rows(no_docs).count() == 0
    assert mixing.mix(no_docs).count() == 0
