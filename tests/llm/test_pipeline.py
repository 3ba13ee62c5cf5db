import re
from collections import Counter

import corpus_pipeline
from weirflow.llm import decontam, mixing, near_dup, quality

from conftest import sentence


def test_stages_do_what_the_operators_decide(spark, rng, tmp_path):
    texts = [sentence(rng, rng.randrange(60, 120)) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100, texts[0], "s0"), (101, texts[1] + " more", "s1"), (102, "too short", "s0"), (103, None, "s1"), (104, sentence(rng, 70) + " " + "alpha beta gamma delta one two three four five", "s2")]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, size string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta one two three four five")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{len(seen)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen[name] = (before, docs)
        if len(seen) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    before, after = seen["quality rules"]
    assert ids(after) == Counter(r.doc_id for r in quality.op3_rows(before).where("kept").collect())
    before, after = seen["near-dedup"]
    assert ids(after) == Counter(r.doc_id for r in near_dup.op1_rows(before).where("kept").collect())
    assert 100 not in ids(after) and 101 not in ids(after)
    before, after = seen["decontamination"]
    assert ids(after) == Counter(r.doc_id for r in decontam.op6_rows(before, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).where("n_items = 0").collect())
    assert 104 not in ids(after)
    before, after = seen["mixing"]
    assert ids(after) == Counter({r.doc_id: r.taken // r["size"] for r in mixing.op4_rows(before).collect() if r.taken})
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))


def test_odd_documents_through_all_stages(spark, docs, rng, tmp_path):
    """Repeated rows, null ids, ties, long texts and clashing names; every stage against brute force over its input."""
    from collections import Counter

    more = spark.createDataFrame([(300 + i % 5, sentence(rng, 80), "s1", "k", 1, "z") for i in range(8)], docs.schema)
    docs.union(more).union(more).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, more.first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    words = lambda t: len([w for w in re.split(r"[ \t-\r]+", t or "") if w])
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = now.collect()
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        after = now.collect()
        if name != "sharding":
            assert now.columns == docs.columns and set(map(str, after)) <= set(map(str, before))
        if name == "quality rules":
            assert after and all(words(r.text) >= 50 for r in after)
        if name == "near-dedup":
            assert max(Counter(r.text for r in after).values()) == 1
            assert {r.text for r in after} <= {r.text for r in before}
        if name == "decontamination":
            assert {str(r) for r in before} - {str(r) for r in after} == {str(r) for r in before if r.text == more.first().text}
        if name == "sharding":
            assert len(after) == len(before) and len({(r.shard, r.slot) for r in after}) == len(after)
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, after))


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
