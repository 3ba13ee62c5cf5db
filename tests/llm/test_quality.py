import re
from collections import Counter

from weirflow.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    seen = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    covered = {p for i in range(n - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed


def test_measures_equal_brute_force(spark, docs, rng):
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    texts += ["a b c " * 30, "x\n\nx\n x\ny", "# $ |\n# $ |", "a a a a", "a a a", "b a a a a a b", "\x0b\x0ca\x1cb"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, more):
        want = sorted(((r.doc_id if r.doc_id is not None else -1, *brute(r.text)) for r in df.collect()))
        got = quality.op3_rows(df).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.base_failed and r.kept for r in got)


def test_empty_table(no_docs):
    assert quality.op3_rows(no_docs).count() == 0
    assert quality.keep(no_docs).columns == no_docs.columns


def test_keep_returns_own_columns_and_policy_decides(docs):
    masks = [r.failures for r in quality.ledger(docs).collect()]
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(m & quality.mask_of("v1") == 0 for m in masks)
    assert set(quality.POLICIES["base"]) < set(quality.POLICIES["v1"])


def test_ablations_equal_counts_over_masks(docs):
    masks = [r.failures for r in quality.ledger(docs).collect()]
    for row in quality.ablations(quality.ledger(docs)).collect():
        bit = 1 << quality.RULES.index(row.rule)
        assert row.n_failed == sum(bool(m & bit) for m in masks)
        assert row.n_only == sum(m == bit for m in masks)
        assert row.n_kept_without == sum(m & ~bit == 0 for m in masks)


def test_junk_fails_and_prose_passes(spark):
    prose = " ".join(f"word{i % 97} stands {i}" for i in range(60))
    rows = [(1, prose), (2, prose.upper().replace("0", "A")), (3, " ".join(f"w{i}###" for i in range(80))), (4, ("a line that is here\n" * 9) + prose)]
    got = {r.doc_id: r.kept for r in quality.op3_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
