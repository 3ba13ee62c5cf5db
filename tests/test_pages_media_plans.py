import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirflow.contracts import ContractError
from weirflow.operators import evaluation, html, media
from weirflow.plans import lifecycle, planning, store
from weirflow.sources import fetch
from weirflow.streaming import incremental

PAGE_1 = '<div id=top><article class="product big" data-id=a1><h2>Al<b>pha</b></h2><span class=price>10</span><br></article><article class=product data-id=b2><h2>Beta</h2></article><a class=next href="/2">n</a></div>'
PAGE_2 = "<article class=product data-id=c3><h2>Gamma &amp; x</h2><span class=price>30</span></article>"
FIELDS = {"id": "@data-id", "name": "h2", "price": "span.price"}


def test_records_out_of_pages(spark):
    df = spark.createDataFrame([(1, PAGE_1), (2, PAGE_2), (3, None), (4, "")], "page_id long, html string")
    got = [tuple(r) for r in html.extract(df, "article.product", FIELDS).orderBy("page_id", "item").collect()]
    assert got == [(1, 0, "a1", "Al pha", "10"), (1, 1, "b2", "Beta", None), (2, 0, "c3", "Gamma & x", "30")]
    assert html.extract(df, "#top h2").count() == 2
    with pytest.raises(ContractError):
        html.extract(df, "")


def test_text_order_and_double_matches():
    assert html.records("<p>a<i>b</i>c</p>", "p", {}) == [{"text": "a c b"}]
    assert len(html.records("<div><div><p>x</p></div></div>", "div p", {})) == 2
    assert html.records("<p>a<br>b</p>", "p", {"t": "text", "none": "@x"}) == [{"t": "a b", "none": None}]


def site(pages):
    calls = []

    def get(url, headers, timeout):
        calls.append(url)
        return 200, pages[url]

    return get, calls


def test_pagination_kinds():
    get, calls = site({"http://h/1": PAGE_1, "http://h/2": PAGE_2})
    got = fetch.acquire({"url": "http://h/1", "item_selector": "article.product", "fields": FIELDS, "pagination": {"kind": "link"}}, transport=get)
    assert [r["id"] for r in got.records] == ["a1", "b2", "c3"] and got.pages == 2
    rest = {"http://h/r": {"items": [{"id": 1}], "next": "/s", "next_cursor": "k", "more": True}, "http://h/s": {"items": [{"id": 2}]}, "http://h/r?cursor=k": {"items": [{"id": 3}]}, "http://h/r?page=2": {"items": [{"id": 4}], "more": False}}
    get, _ = site({k: json.dumps(v) for k, v in rest.items()})
    ids = lambda p, **x: [r["id"] for r in fetch.acquire({"url": "http://h/r", "items_path": "items", "pagination": p, **x}, transport=get).records]
    assert ids({"kind": "none"}) == [1] and ids({"kind": "link"}) == [1, 2] and ids({"kind": "cursor"}) == [1, 3]
    assert ids({"kind": "page", "has_more_field": "more"}) == [1, 4] and ids({"kind": "link"}, max_pages=1) == [1]


def test_incremental_fetch_and_frames(spark):
    get, calls = site({"http://h/r": '[{"id":1,"t":5},{"id":2,"t":9},{"id":3,"t":null}]', "http://h/r?since=9": '[{"id":2,"t":9},{"id":4,"t":12}]'})
    state = {}
    p = {"url": "http://h/r", "cursor_field": "t"}
    first = fetch.acquire(p, state, get)
    assert [r["id"] for r in first.records] == [1, 2] and state == {"http://h/r": 9}
    assert [r["id"] for r in fetch.acquire(p, state, get).records] == [4] and state == {"http://h/r": 12}
    assert sorted((r.id, r.t) for r in first.frame(spark).collect()) == [(1, 5), (2, 9)]
    later = fetch.Acquired(({"id": 1}, {"id": 2, "tag": "x"}, {"id": 2.5}), 1, None)
    assert sorted((r.id, r.tag) for r in later.frame(spark).collect()) == [(1.0, None), (2.0, "x"), (2.5, None)]
    assert fetch.Acquired((), 1, None).frame(spark).count() == 0
    fresh, cursor = fetch.incremental(spark.range(10), "id", 6)
    assert fresh.count() == 3 and cursor.first().cursor == 9
    assert fetch.incremental(spark.range(0), "id", 6)[1].first().cursor == 6
    assert fetch.newer("b", 1) and not fetch.newer(None, 1) and fetch.newer(0, None)


@pytest.mark.parametrize("bad", [{"url": "ftp://h"}, {"url": "http://u:p@h/"}, {"url": "http://h", "max_pages": 0}, {"url": "http://h", "max_pages": 1001}, {"url": "http://h", "timeout_seconds": 61}, {"url": "http://h", "headers": {"a": 1}}, {"url": "http://h", "pagination": {"kind": "all"}}, {"url": "http://h", "script": "x"}])
def test_fetch_bounds(bad):
    with pytest.raises(ContractError):
        fetch.acquire(bad, transport=lambda *a: (200, "[]"))


def test_transcripts(spark):
    seg = lambda *s: [{"start": float(a), "end": float(b), "text": t} for a, b, t in s]
    rows = [("r", seg((0.8, 2, "there, friend"))), ("r", seg((0, 1, "hello There"))), ("q", seg((0, 2, "x"), (1, 3, "y"), (1, 1.5, "z")))]
    df = spark.createDataFrame(rows, f"k string, segments {media.SEGMENTS}")
    got = {r.k: [tuple(s) for s in r.segments] for r in media.asr_merge(df, "k").collect()}
    assert got == {"r": [(0.0, 1.0, "hello There"), (1.0, 2.0, "friend")], "q": [(0.0, 2.0, "x"), (2.0, 3.0, "y")]}
    bad = spark.createDataFrame([("r", [{"start": 0.0, "end": 1.0, "text": None}])], f"k string, segments {media.SEGMENTS}")
    with pytest.raises(Exception, match="text is required"):
        media.asr_merge(bad, "k").collect()


@pytest.mark.parametrize(
    "given, want",
    [
        ([], []),
        ([(0, 2, None), (1, 3, None)], [(0, 2, None), (2, 3, None)]),
        ([(0, 1, "a b C."), (1, 2, "c, d")], [(0, 1, "a b C."), (1, 2, "d")]),
        ([(0, 1, "Straße ΟΔΟΣ"), (1, 2, "STRASSE οδοσ!  and  more")], [(0, 1, "Straße ΟΔΟΣ"), (1, 2, "and more")]),
        # the longest run counts, and what is left of a segment is compared with the next
        ([(0, 1, "x y x y"), (1, 2, "x y z"), (2, 3, "z w")], [(0, 1, "x y x y"), (1, 2, "z"), (2, 3, "w")]),
        ([(0, 1, "x y"), (1, 2, "X, Y."), (2, 3, "y q")], [(0, 1, "x y"), (2, 3, "q")]),
        ([(5, 6, "later"), (0, 5.5, "first")], [(0, 5.5, "first"), (5.5, 6, "later")]),
        ([(0, 4, "long"), (1, 3, "inside"), (1, None, "open"), (2, 5, "on")], [(0, 4, "long"), (4, None, "open"), (1, 3, "inside"), (3, 5, "on")]),
        ([(1, 2, "b one"), (1, 2, "a two")], [(1, 2, "b one")]),
        ([(None, 3, "no start"), (1, 2, None), (3, 4, "  spaced   out ")], [(None, 3, "no start"), (3, 4, "spaced out")]),
        ([(0, 1, "say"), (1, 2, ""), (2, 3, "more")], [(0, 1, "say"), (2, 3, "more")]),
    ],
)
def test_overlaps_of_segments(spark, given, want):
    real = lambda rows: [(None if a is None else float(a), None if b is None else float(b), t) for a, b, t in rows]
    df = spark.createDataFrame([("k", real(given))], f"k string, segments {media.SEGMENTS}")
    assert [tuple(x) for x in media.overlap_remove(df, "k").first().segments] == real(want)


def fake_tool(args):
    if args[0] == "ffprobe":
        return json.dumps({"format": {"format_name": "wav", "duration": "1.5", "size": "7"}, "streams": [{"codec_type": "audio", "codec_name": "pcm", "sample_rate": "16000", "channels": 1}]}).encode()
    from pathlib import Path

    if "segment" in args:
        for k in range(2):
            Path(args[-1] % k).write_bytes(b"part%d" % k)
    else:
        Path(args[-1]).write_bytes(" ".join(a for a in args[args.index("-i") :] if not a.startswith("/")).encode())
    return b""


def test_audio_command_lines(spark):
    df = spark.createDataFrame([("/a/x.wav", b"1", "g", 1), ("/a/y.wav", b"2", "g", 0)], "path string, content binary, g string, n int")
    for operation in media.CONVERSIONS:
        assert media.convert(df, operation, runner=fake_tool).count() == 2
    assert b"-ar 16000" in bytes(media.convert(df, "media.resample", 16000, fake_tool).first().content)
    assert sorted((r.path, r.part) for r in media.segment(df, 2.5, fake_tool).collect()) == [("/a/x.wav", 0), ("/a/x.wav", 1), ("/a/y.wav", 0), ("/a/y.wav", 1)]
    assert b"concat=n=2:v=0:a=1" in bytes(media.merge(df, "g", "n", fake_tool).first().content)
    assert tuple(media.metadata(df, fake_tool).first())[1:] == ("wav", 1.5, 7, "pcm", 16000, 1)
    for bad in (lambda: media.convert(df, "media.resample", 100), lambda: media.convert(df, "media.other"), lambda: media.segment(df, 0), lambda: media.check_rate(True)):
        with pytest.raises(ContractError):
            bad()


def test_evaluation_guard_and_adapter(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 2, 4, 3, 5])], "group string, t long, value double")
    adapter = evaluation.SeriesAdapter()
    for operation in adapter.operations:
        assert evaluation.evaluate(adapter, operation, df, {}).count() > 0
    assert evaluation.evaluate(adapter, "replay_eval.backtest", df, {}).first().gain == 2 - 1 - 2
    for operation, params, profile in (("replay_eval.replay", {"x": {"callback": 1}}, "offline"), ("replay_eval.replay", {"sql": 1}, "offline"), ("replay_eval.replay", {"x": float("inf")}, "offline"), ("replay_eval.other", {}, "offline"), ("replay_eval.replay", {}, "external-api"), ("replay_eval.external_api_evaluation", {}, "external-api")):
        with pytest.raises(ContractError):
            evaluation.evaluate(adapter, operation, df, params, profile)
    asked = spark.createDataFrame([('{"q":1}',)], "body string")
    assert evaluation.external_evaluation(asked, lambda b, s: b'{"ok":true}').first().answer == '{"ok":true}'
    with pytest.raises(Exception, match="JSON object"):
        evaluation.external_evaluation(asked, lambda b, s: b"[]").collect()


def test_shards_and_waves(spark):
    s = planning.plan_shards(spark, "r", 0, 600, 1)
    waves = planning.plan_waves(s, None, 256).groupBy("wave_id").count().orderBy("wave_id").collect()
    assert [(r.wave_id, r["count"]) for r in waves] == [("wave-0000", 256), ("wave-0001", 256), ("wave-0002", 88)]
    t = planning.plan_shards(spark, "r", "2024-01-01T00:00:00+00:00", "2024-01-01T02:30:00+00:00", timedelta(hours=1)).orderBy("ordinal").collect()
    assert [r.end - r.start for r in t] == [3_600_000_000, 3_600_000_000, 1_800_000_000] and t[2].shard_id == "shard-000002"
    e = planning.expanded(planning.plan_shards(spark, "r", 0, 20, 10), {"lookback": 5, "halo_after": 3}).orderBy("ordinal").collect()
    assert [(r.read_start, r.read_end) for r in e] == [(0, 13), (5, 23)]
    for bad in ((0, 10, 0), (0, 10, True), (5, 1, 1), ("2024-01-01", "2024-01-02T00:00:00+00:00", 5)):
        with pytest.raises(ContractError):
            planning.plan_shards(spark, "r", *bad)
    with pytest.raises(ContractError):
        planning.plan_waves(s)
    with pytest.raises(ContractError):
        planning.plan_waves(s.union(s), 5)


def attempt(shard, n, status, digest="d"):
    return (shard, f"{shard}-{n}", status, digest, "f", datetime(2024, 1, 1), datetime(2024, 1, 1, 0, n))


def test_completeness_and_budgets(spark):
    s = planning.plan_shards(spark, "r", 0, 5, 1, "d", "f")
    rows = [attempt("shard-000000", 1, "succeeded"), attempt("shard-000001", 1, "succeeded", "old"), attempt("shard-000002", 1, "succeeded"), attempt("shard-000002", 2, "succeeded")]
    rows += [attempt("shard-000003", i, "failed") for i in range(3)] + [attempt("shard-000004", i, "failed") for i in range(4)]
    a = spark.createDataFrame(rows, "shard_id string, attempt_id string, status string, input_digest string, fingerprint string, started_at timestamp, finished_at timestamp")
    got = {r.ordinal: (r.state, r.canonical_attempt) for r in planning.completeness(s, a).collect()}
    assert got == {0: ("canonical", "shard-000000-1"), 1: ("missing", None), 2: ("duplicate", None), 3: ("missing", None), 4: ("missing", None)}
    ids = lambda df: sorted(r.ordinal for r in df.collect())
    assert ids(planning.retryable(s, a, {"max_attempts_per_shard": 4})) == [1, 3] and ids(planning.exhausted(s, a, {"max_attempts_per_shard": 4})) == [4]
    assert ids(planning.retryable(s, a, {"max_attempts_per_shard": 4, "resume_enabled": False})) == [0, 1, 2, 3]
    assert not planning.can_finalize(s, a) and planning.can_finalize(s.where("ordinal = 0"), a)
    assert planning.worker_profile("ml-batch", "ml.distilbert_pair_binary_scores") == "distilbert"
    with pytest.raises(ContractError):
        planning.worker_profile("tabular-batch", "tabular.format_migration")


def test_store_and_controller(spark, tmp_path):
    st = store.Store(tmp_path)
    a = st.write(b"data", "text/plain")
    assert st.write(b"data") .sha256 == a.sha256 and st.read(a) == b"data" and st.verify(a) and st.exists(a)
    with st.verified_copy(a) as p:
        assert p.read_bytes() == b"data"
    st.path(a).write_bytes(b"dat!")
    assert not st.verify(a)
    with pytest.raises(ContractError), st.verified_copy(a):
        pass
    st.path(a).write_bytes(b"data")
    record = {"shard_id": "shard-000000", "attempt_id": "x1", "status": "succeeded", "input_digest": "d", "fingerprint": "f", "started_at": "2024-01-01T00:00:00", "finished_at": "2024-01-01T00:01:00"}
    st.append_attempt("run", record)
    st.append_attempt("run", record)
    with pytest.raises(ContractError):
        st.append_attempt("run", record | {"input_digest": "e"})
    with pytest.raises(ContractError):
        st.append_attempt("run", record | {"attempt_id": "../x"})
    c = store.Controller(spark, st)
    shards = planning.plan_shards(spark, "run", 0, 1, 1, "d", "f")
    m = c.refresh("run", shards, -1)
    assert m["finalization_status"] == "ready" and m["canonical_attempts"] == ["x1"]
    with pytest.raises(store.RevisionConflict):
        c.refresh("run", shards, -1)
    with pytest.raises(ContractError):
        c.finalize("run", 0, ())
    assert c.finalize("run", 0, (a,))["status"] == "succeeded"
    with pytest.raises(ContractError):
        c.finalize("run", 1, (a,))
    with pytest.raises(ContractError):
        store.Artifact("o", "https://u:p@h/x", a.sha256)
    assert store.input_digest(b"x", (a,)) != store.input_digest(b"x") and store.opaque("run", "q").startswith("run-")
    assert store.fingerprint("r", "d", "p", "o", {"b": 1, "a": 2}, "s") == store.fingerprint("r", "d", "p", "o", {"a": 2, "b": 1}, "s")


def test_collection_plans_and_deletion(spark, tmp_path):
    st = store.Store(tmp_path)
    arts = [st.write(bytes([i])) for i in range(5)]
    d = [a.sha256 for a in arts]
    now = datetime(2024, 1, 10)
    table = spark.createDataFrame([(x, 1, datetime(2024, 1, 1)) for x in d], "digest string, size_bytes long, modified_at timestamp")
    held = lifecycle.reachability([lifecycle.hold_references(spark, [lifecycle.Hold("h", "hold", (d[0],))]), lifecycle.run_references(
        spark.createDataFrame([("r1", "running"), ("r2", "succeeded")], "run_id string, status string"),
        spark.createDataFrame([("r2", d[1])], "run_id string, digest string"),
        spark.createDataFrame([("r1", "a1", d[1]), ("r2", "a2", d[2])], "run_id string, attempt_id string, digest string"))])
    asked = spark.createDataFrame([("q2", d[2]), ("q3", d[3]), ("q3b", d[3])], "request_id string, digest string")
    sent = spark.createDataFrame([("q2", datetime(2024, 1, 2)), ("q3", datetime(2024, 1, 9, 23))], "request_id string, delivered_at timestamp")
    normal = {r.digest: (r.eligible, r.reasons) for r in lifecycle.plan_normal(table, held, asked, sent, now, 86_400).collect()}
    assert normal == {d[0]: (False, ["hold:h"]), d[1]: (False, ["attempt:a1", "manifest_final:r2"]), d[2]: (True, []), d[3]: (False, ["grace_pending:q3", "undelivered:q3b"]), d[4]: (False, ["no_request"])}
    used = spark.createDataFrame([(d[4], datetime(2024, 1, 9))], "digest string, used_at timestamp")
    legacy = {r.digest: r.eligible for r in lifecycle.plan_legacy(table, held, asked, sent, used, now, 5 * 86_400).collect()}
    assert legacy == {d[0]: False, d[1]: False, d[2]: False, d[3]: False, d[4]: False}
    later = {r.digest: r.eligible for r in lifecycle.plan_legacy(table, held, asked, sent, used, now + timedelta(days=9), 5 * 86_400).collect()}
    assert later[d[4]]
    assert lifecycle.collect_garbage(st, [d[2], d[4]], lambda x: x != d[4]) == [d[2]]
    assert not st.exists(arts[2]) and st.exists(arts[4])
    # a crash after the unlink: the intention is finished next time
    store.publish(st.root / "gc" / "intents" / f"{d[3].removeprefix('sha256:')}.json", b"{}")
    st.path(arts[3]).unlink()
    assert lifecycle.collect_garbage(st, [], lambda x: False) == [d[3]] and lifecycle.collect_garbage(st, [d[3]], lambda x: True) == []


def test_streams_pick_up_where_they_ended(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    write = lambda lo, hi: spark.range(lo, hi).coalesce(1).write.mode("append").parquet(source)
    write(0, 5)
    incremental.append_new(spark, source, "id long", target, mark, "id % 2 = 0")
    write(5, 9)
    incremental.append_new(spark, source, "id long", target, mark, "id % 2 = 0")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [0, 2, 4, 6, 8]
    seen = []
    rows = spark.range(20).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 2).alias("k"), F.lit(1.0).alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, k long, v double").parquet(str(tmp_path / "ev"))
    incremental.run_available(incremental.windowed(stream, "ts", "5 minutes", ["k"], "v", "1 minute"), str(tmp_path / "m2"), lambda df, n: seen.extend(df.collect()), "update")
    assert sum(r.n for r in seen) >= 20


def test_outputs_must_be_in_the_store(tmp_path, monkeypatch):
    st = store.Store(tmp_path)
    here, other = st.write(b"here"), store.Store(tmp_path / "other").write(b"elsewhere")
    record = {"shard_id": "s", "attempt_id": "x1", "status": "succeeded", "started_at": "2024-01-01T00:00:00", "finished_at": "2024-01-01T00:01:00"}
    from dataclasses import asdict

    st.append_attempt("run", record | {"output_refs": [asdict(here)]})
    with pytest.raises(ContractError, match=other.sha256):
        st.append_attempt("run", record | {"attempt_id": "x2", "output_refs": [asdict(here), asdict(other)]})
    with pytest.raises(ContractError, match="outputs must exist"):
        st.write_manifest("run", {"revision": 0, "final_output_refs": [asdict(other)]}, -1)
    assert st.manifest("run") is None
    st.write_manifest("run", {"revision": 0, "final_output_refs": [asdict(here)]}, -1)
    # a file that changes while it is read is not right, whatever was read
    late = st.write(b"late")
    real = store.hash_file

    def touched(path):
        found = real(path)
        path.write_bytes(b"late")
        return found

    monkeypatch.setattr(store, "hash_file", touched)
    assert not st.verify(late)
    # versions that are used stay remembered
    monkeypatch.setattr(store, "hash_file", real)
    monkeypatch.setattr(store, "REMEMBERED", 2)
    a, b, c = (st.write(x) for x in (b"a", b"b", b"c"))
    assert st.verify(a) and st.verify(b) and st.verify(a) and st.verify(c)
    monkeypatch.setattr(store, "hash_file", lambda path: pytest.fail("hashed again"))
    assert st.verify(a) and st.verify(c)


def test_streams_keep_the_first_or_the_latest_of_a_key(spark, tmp_path):
    from weirflow.streaming import incremental

    schema = "k string, t timestamp, v int"
    rows = [("a", "2024-01-01 00:00:01", 1), ("a", "2024-01-01 00:00:05", 2), ("b", "2024-01-01 00:00:03", 3), ("a", "2024-01-01 00:00:04", 4)]
    spark.createDataFrame(rows, "k string, t string, v int").selectExpr("k", "timestamp(t) AS t", "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {}
    for name, df, mode in (("latest", incremental.latest_by_key(stream, "t", ["k"]), "complete"), ("first", incremental.first_by_key(stream, "t", ["k"], "1 hour"), "append")):
        incremental.run_available(df, str(tmp_path / name), lambda batch, _, name=name: got.setdefault(name, []).extend(batch.collect()), mode)
    assert {r.k: r.v for r in got["latest"]} == {"a": 2, "b": 3}
    assert sorted(r.k for r in got["first"]) == ["a", "b"]
