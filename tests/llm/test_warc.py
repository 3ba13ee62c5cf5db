import hashlib

import pytest

from weirflow.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, header int"


@pytest.fixture
def pages(spark):
    big, other = "<p>é</p>" * 200, "x" * 1000
    rows = [(i, f"http://a.example/{i}", big) for i in range(6)] + [(10, "u\r\nWARC-Type: revisit", other), (11, None, other[:-1]), (12, "v", other[:-1]), (13, "w", None), (14, "", "")]
    rows += [(15, "dup", other), (15, "dup", other), (None, "n", other), (None, "n2", "y" * 2000), (None, "n3", "y" * 2000), (16, "L", "z" * 300_000)]
    return spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)


def brute(rows):
    out = []
    for r in rows:
        body = (r.html or "").encode()
        same = [x.page_id for x in rows if x.html == r.html and x.page_id is not None]
        first = max(same) if same else None
        revisit = len(body) >= 1000 and r.page_id != first
        out.append((r.page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(map(str, out))


def test_rows_equal_brute_force(pages):
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op2_rows(pages).collect()]
    assert sorted(map(str, got)) == brute(pages.collect())


def test_payloads_are_stored_once_and_records_come_back_exactly(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages, path)
    stored = spark.read.parquet(f"{path}/payloads")
    assert stored.count() == len({r.html or "" for r in pages.collect()}) == stored.select("digest").distinct().count()
    headers = {bytes(r.header) for r in spark.read.parquet(f"{path}/headers").collect()}
    for r in warc.record_bytes(warc.read(spark, path)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert head + b"\r\n\r\n" in headers
        size = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length")][0].split()[1])
        assert rest[:size] + b"\r\n\r\n" == rest


def test_damage_is_seen(spark, pages, tmp_path):
    path = str(tmp_path / "archive")
    warc.write(pages, path)
    kept = spark.read.parquet(f"{path}/payloads").toPandas()
    kept.loc[0, "payload"] = b"other bytes"
    spark.createDataFrame(kept).write.parquet(f"{path}2/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}2/headers")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read(spark, f"{path}2").collect()
    spark.read.parquet(f"{path}/payloads").limit(0).write.parquet(f"{path}3/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}3/headers")
    with pytest.raises(Exception, match="block is missing"):
        warc.read(spark, f"{path}3").collect()


def test_empty_table(pages):
    assert warc.op2_rows(pages.where("false")).count() == 0
