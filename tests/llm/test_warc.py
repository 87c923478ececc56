import base64
import glob
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import queries, warc

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(pages, min_bytes=0):
    largest = {}
    for i, html in pages:
        if i is not None and len((html or "").encode()) >= min_bytes:
            largest[html or ""] = max(i, largest.get(html or "", i))
    out = []
    for i, html in pages:
        text = html or ""
        refers = largest.get(text)
        refers = None if refers == i else refers
        out.append((i, len(text.encode()), digest(text), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def written(spark, pages, path, parts=2, **more):
    df = spark.createDataFrame([(i, f"http://a b/\r\n{i} WARC/1.1", html, 1) for i, html in pages], "page_id long, url string, html string, payload int")
    warc.write_archives(df.repartition(parts), str(path), **more)


def read(spark, path, split=None):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return sorted((tuple(r) for r in warc.read_archives(spark, str(path)).select("page_id", "payload_bytes", "digest", "type", "refers_to").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def planted(n, seed):
    lot = random.Random(seed)
    bits = [INNER, "WARC/1.1\r\n", "WARC/1.1", "\r\n\r\n", "\r\n", "text é ", INNER.replace("Content-Length: 5", "Content-Length: 700"), "HTTP/1.1 200 OK\r\n\r\n", "WARC/1.1\r\nWARC/1.1\r\n", INNER.replace("5", "x")]
    return [(k, "".join(lot.choice(bits) for _ in range(lot.randrange(12)))) for k in range(n)]


@pytest.mark.parametrize("split", [None, 997])
def test_records_are_found_across_splits_and_magic_in_payloads_is_not(spark, tmp_path, split):
    pages = [*planted(60, 3), (100, None), (101, ""), (None, "x"), (102, "x"), (None, "only"), (103, INNER * 40), (104, INNER * 40)]
    written(spark, pages, tmp_path / "w")
    assert read(spark, tmp_path / "w", split) == brute(pages)


def test_records_read_by_a_plain_reader(spark, tmp_path):
    pages = [*planted(20, 5), (50, "same"), (51, "same")]
    written(spark, pages, tmp_path / "w", min_bytes=4)
    types = []
    for name in glob.glob(f"{tmp_path}/w/part-*"):
        raw, at = open(name, "rb").read(), 0
        while at < len(raw):
            assert raw.startswith(b"WARC/1.1\r\n", at)
            body, size, fields = warc.parse(raw[at + 10 :])
            assert fields[b"warc-target-uri"].startswith(b"http://a%20b/%0D%0A")
            types.append((fields[b"warc-type"], fields.get(b"warc-refers-to")))
            at += 10 + body + size
            assert raw[at : at + 4] == b"\r\n\r\n"
            at += 4
        assert at == len(raw)
    assert len(types) == 22 and types.count((b"revisit", b"<urn:x-page:51>")) == 1
    assert read(spark, tmp_path / "w") == brute(pages, min_bytes=4)


def test_broken_archives_are_refused(spark, tmp_path):
    written(spark, [(1, "a" * 100), (2, "b")], tmp_path / "w", parts=1)
    name = glob.glob(f"{tmp_path}/w/part-*")[0]
    raw = open(name, "rb").read()
    for k, bad in enumerate((raw[:-3], raw.replace(b"a" * 100, b"a" * 99), raw + b"more", b"no archive", b"x" + raw)):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / "one.warc").write_bytes(bad)
        with pytest.raises(ValueError, match="chain"):
            warc.read_archives(spark, f"{tmp_path}/b{k}").collect()


def test_empty_table_repeats_and_large_pages(spark):
    big = "é" * 1_500_000
    pages = [(1, big), (2, big), (2, big), (3, "y"), (3, "z")]
    df = spark.createDataFrame([(i, None, h) for i, h in pages], "page_id int, url string, html string")
    assert sorted((tuple(r) for r in warc.warc_round_trip(df).collect()), key=str) == brute(pages)
    assert warc.warc_round_trip(df.limit(0)).collect() == []


def test_query_equals_sql(spark, sf_dir):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = {tuple(r) for r in queries.op13_warc(spark, sf_dir).select(names).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert got == set(con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op13_warc']})").fetchall())
    pages = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "")], "page_id long, html string").withColumn("url", F.lit("u"))
    pages.toPandas().to_parquet(path := "/tmp/tickloom-pages-for-sql.parquet")
    other = duckdb.connect()
    other.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}'")
    assert {tuple(r) for r in warc.warc_round_trip(pages).select(names).collect()} == set(other.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op13_warc']})").fetchall())
