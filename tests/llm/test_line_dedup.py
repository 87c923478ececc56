from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from tickloom.llm import line_dedup, queries


def brute(rows, ratio, min_pages):
    pages, on = defaultdict(int), defaultdict(int)
    for _, host, text in rows:
        pages[host] += 1
        for line in set((text or "").split("\n")) if text is not None else ():
            if line.strip(" "):
                on[host, line] += 1
    out = []
    for doc_id, host, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if not (on[host, x] >= min_pages and on[host, x] > ratio * pages[host])]
        out.append((doc_id, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


def run(spark, rows, ratio, min_pages):
    df = spark.createDataFrame([(*r, "mine", [1]) for r in rows], "doc_id long, source string, text string, ld string, drop array<int>")
    got = line_dedup.line_dedup(df, F.col("source"), ratio, min_pages)
    assert set(df.columns) < set(got.columns)
    return sorted(map(tuple, got.select("doc_id", "ld_lines", "ld_removed", "text").collect()), key=str)


def test_small_sites(spark):
    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else None), f"menu\nbody {i}\n\nmenu\nfoot {i % 4}\n") for i in range(60)]
    rows += [(100, "hot", None), (101, "hot", ""), (102, None, "menu"), (102, None, "menu"), (103, "one", "menu\nx"), (None, "hot", "menu"), (104, "hot", "é\n" * 5000 + "menu")]
    for ratio, least in ((0.1, 5), (0.3, 2), (0.9, 1)):
        assert run(spark, rows, ratio, least) == brute(rows, ratio, least)


def test_nothing(spark):
    assert run(spark, [], 0.1, 5) == []


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute(line_dedup.ORACLE_SQL).fetchall())
    got = queries.op9_line_dedup(spark, sf)
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect())) == want
    assert any(r[2] for r in want)


def test_pages(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.line_dedup_pages(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    row = spark.createDataFrame([("HTTP://u@Ex.Org:80/a", "<p>a <b>b</b></p><script>x<p></script><div>c</div>")], "u string, h string")
    assert tuple(row.select(line_dedup.page_host(F.col("u")), line_dedup.page_lines(F.col("h"))).first()) == ("ex.org", "a b\nc")


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "menu\nown %d" % i, "h", 1, 2, 3) for i in range(8)], "doc_id long, text string, host string, ld_key int, LD_K int, ld_lines int")
    got = line_dedup.line_dedup(docs, F.col("host")).collect()
    assert all((r["text"], r["ld_key"], r["LD_K"], r["ld_lines"], r["ld_removed"]) == ("own %d" % r["doc_id"], 1, 2, 2, 1) for r in got) and len(got) == 8


def test_pages_query_equals_brute_force(spark):
    from tickloom.llm import common

    sf_dir = "/root/testdata/sf0.01"

    pages = common.table(spark, sf_dir, "pages").select("page_id", line_dedup.page_host(F.col("url")).alias("host"), line_dedup.page_lines(F.col("html")).alias("text"))
    rows = [tuple(r) for r in pages.collect()]
    got = sorted(map(tuple, queries.line_dedup_pages(spark, sf_dir).select("page_id", "n_lines", "n_removed", "text").collect()), key=str)
    assert got == brute(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)
    few = sorted(map(tuple, line_dedup.line_dedup(pages, F.col("host"), 0.1, 2).select("page_id", "ld_lines", "ld_removed", "text").collect()), key=str)
    assert few == brute(rows, 0.1, 2) and any(r[2] for r in few)
