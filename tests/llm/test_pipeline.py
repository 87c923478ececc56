import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import common, decontaminate, quality, tokens

from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near
from .test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    marks = {r["doc_id"]: r["quality"] for r in common.table(spark, SF, "labels").collect()}
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = common.stage(stage(spark, docs, SF), "stage")
        outs.append(docs.collect())
        if len(outs) < 5:
            assert set(docs.columns) == set(corpus_pipeline.COLUMNS)
    first = {r["doc_id"]: r for r in outs[0]}
    assert all(first[i]["text"] == rows[i]["text"] for i in first)
    good = [i for i, q in marks.items() if q == 1]
    bad = [i for i, q in marks.items() if q == 0]
    assert np.mean([i in first for i in good]) > 0.98 and np.mean([i in first for i in bad]) < 0.3
    want = {d: t for d, _, _, t in brute_lines([(r["doc_id"], r["source"], r["text"]) for r in outs[0]], 0.1, 5)}
    assert {r["doc_id"]: r["text"] for r in outs[1]} == want
    near = [r[0] for r in brute_near([(r["doc_id"], r["text"]) for r in outs[1]], 80) if r[3]]
    assert sorted(r["doc_id"] for r in outs[2]) == sorted(near)
    items = [decontaminate.normalise(r["text"]) for r in common.table(spark, SF, "benchmark").collect()]
    holds = {r["doc_id"] for r in outs[2] if any(x in decontaminate.normalise(r["text"]) for x in items)}
    left = {r["doc_id"] for r in outs[3]}
    assert holds and not holds & left and len(left) > 0.9 * (len(outs[2]) - len(holds))
    enc = tokens.encoder(tokens.default_vocabulary())
    check_packing(outs[4], {r["doc_id"]: [*enc.ids(r["text"]).tolist(), 0] for r in outs[3]}, 1024)


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5), (3, "word " * 5000, "en", "s", 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").withColumn("fm_score", F.lit(1))
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stage(stage(spark, docs, SF), "stage")
        docs.collect()


def test_unlike_texts_of_one_id_stay(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "en", "s", 9), (2, "one text of the id " * 3, "en", "s", 1), (2, "quite another text of this same id", "en", "s", 2), (2, "quite another text of this same id", "de", "s", 2), (2, long + " end", "en", "s", 3), (7, None, "en", "s", 0), (None, long, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = sorted(((r["doc_id"], r["text"], r["lang"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, long, "en"), (2, rows[1][1], "en"), (2, rows[2][1], "de"), (7, None, "en"), (None, long, "en")], key=str)
