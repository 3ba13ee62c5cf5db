import numpy as np
import pytest

from weirflow.llm import line_dedup

from conftest import sentence

EDGE = " \t\n\x0b\x0c\r"


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_chars=1, fuzzy_chars=20):
    rows = [(d, t) for d, t in rows]
    places = sorted({((d is None, d or 0, t), i, line.strip(EDGE)) for d, t in rows if t is not None for i, line in enumerate(t.split("\n")) if len(line.strip(EDGE)) >= min_chars}, key=lambda x: x[:2])
    gone, before = {}, set()
    for doc, i, line in places:
        if line in before or len(line) >= fuzzy_chars and any(len(x) >= fuzzy_chars and within_one(line, x) for x in before):
            gone.setdefault(doc, []).append(i)
        before.add(line)
    out = []
    for d, t in rows:
        lost = gone.get((d is None, d or 0, t), [])
        out.append((d, 0 if t is None else len(t.split("\n")), len(lost), ",".join(map(str, lost))))
    return sorted(out, key=str)


def change(rng, line):
    at = rng.randrange(len(line))
    return rng.choice([line[:at] + line[at + 1 :], line[:at] + "q" + line[at:], line[:at] + "é" + line[at + 1 :], line, line + "!", line[1:]])


def lines(rng):
    base = [sentence(rng, rng.randrange(2, 12)) for _ in range(40)] + ["aaaaaaaaaaaaaaaaaaaaaaaa", "row number one of the list 1"]
    rows = []
    for d in range(60):
        some = []
        for _ in range(rng.randrange(6)):
            line = rng.choice(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                line = change(rng, line)
            some.append(rng.choice(["", "  "]) + line)
        rows.append((d, "\n".join(some)))
    return rows + [(100 + i, f"row number one of the list {i}") for i in range(12)] + [(200, "short\nshort"), (201, None), (202, "")]


@pytest.mark.parametrize("min_chars, fuzzy_chars", [(1, 20), (20, 20), (1, 1), (5, 40)])
def test_rows_equal_brute_force(spark, rng, min_chars, fuzzy_chars):
    rows = lines(rng)
    got = line_dedup.op9_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), min_chars, fuzzy_chars).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, min_chars, max(fuzzy_chars, 8))


def test_joined_instead_of_broadcast(spark, rng, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", -1)
    rows = lines(rng)[:40]
    got = line_dedup.op9_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_odd_documents_keep_their_columns(docs):
    # ids repeat here with other texts, which the hash of the text orders
    rows = line_dedup.op9_rows(docs).collect()
    assert len(rows) == docs.count()
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = [r.text for r in out.collect() if r.text]
    assert sum(t.count("same line here for everyone") for t in texts) == 1


@pytest.mark.parametrize("a, b", [("x" * 30, "x" * 31), ("abcdefghij" * 3, "abcdefghij" * 2 + "abcdefghiX"), ("Xbcdefghij" * 3, "bcdefghij" + "Xbcdefghij" * 2)])
def test_pairs_within_one_edit(spark, a, b):
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.op9_rows(df).collect()} == {1: 0, 2: 1}


def test_empty_table(no_docs):
    assert line_dedup.op9_rows(no_docs).count() == 0
    assert line_dedup.dedup(no_docs).count() == 0


def test_very_long_lines(spark, rng):
    base = "".join(rng.choice("abcdefgh 漢🙂") for _ in range(300_000)).strip()
    cases = [base, base[:150_001] + "X" + base[150_002:], base[:7] + base[8:], base + "z", "q" + base, base[:-2] + "XY", "b" * 300_000, "b" * 299_999, "ab" * 150_000, "ba" * 150_000]
    got = line_dedup.op9_rows(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()
    lost = {r.doc_id for r in got if r.n_dropped}
    want = {i for i, x in enumerate(cases) if any(line_dedup_near(x, y) for y in cases[:i])}
    assert lost == want and {1, 2, 3, 4, 7} <= lost


def line_dedup_near(a, b):
    """Within one edit, by the lengths of the common prefix and suffix."""
    a, b = sorted((a, b), key=len)
    if len(b) - len(a) > 1:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[head + (len(a) == len(b)) :] == b[head + 1 :]


def test_hashes_of_variants_and_segments(rng):
    for n in (2, 9, 40, 700):
        text = "".join(rng.choice("abé漢🙂") for _ in range(n))
        line = line_dedup.Hashed(text.encode("utf-32-be"))
        at = np.arange(n)
        for i, (k1, k2) in enumerate(zip(*line.variants(at))):
            short = line_dedup.Hashed((text[:i] + text[i + 1 :]).encode("utf-32-be"))
            assert (short.own[0][-1], short.own[1][-1]) == (k1, k2)
        # whatever character is put in, one segment around it is shared
        i = rng.randrange(n)
        other = line_dedup.Hashed((text[:i] + "x" + text[i:]).encode("utf-32-be"))
        (a, _), _, _ = line.segments(n)
        (b, _), first, past = other.segments(n)
        same = np.flatnonzero(a == b)
        assert len(same) and any(first[j] <= i < past[j] for j in same)


def test_short_lines_lose_their_exact_copies(spark):
    rows = [(1, "Les.\nAnd ornd.\n\n  "), (2, " Les.\nLet.\n"), (3, "x" * 30 + "\nAnd ornd.\nLes.\nLes."), (4, "x" * 29)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.dropped for r in line_dedup.op9_rows(df).collect()} == {1: "", 2: "0", 3: "1,2,3", 4: "0"}
    out = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert out[1] == rows[0][1] and out[2] == "Let.\n" and out[3] == "x" * 30
