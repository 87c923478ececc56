import hashlib
import random

from tickloom.llm import queries, substring_dedup


def words_of(text):
    return (text or "").encode().split()


def brute(rows, window):
    first = {}
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    gone = []
    for k, (_, text) in enumerate(ordered):
        w = words_of(text)
        cover = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), (k, i)) != (k, i):
                cover[i : i + window] = [True] * window
        gone.append(cover)
    return sorted(((d, len(c), sum(c), b" ".join(w for w, x in zip(words_of(t), c) if not x).decode()) for (d, t), c in zip(ordered, gone)), key=str)


def run(spark, rows, window, **sizes):
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, chunk int, shard string")
    return sorted(map(tuple, substring_dedup.substring_dedup(df, window, **sizes).collect()), key=str)


def test_passages_across_chunks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["é,", "X", "x"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randrange(3, 30))] for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), 150):
        w = []
        for _ in range(rng.randrange(0, 6)):
            w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))]
        rows.append((i, " \n".join(w)))
    rows += [(2000, None), (2001, ""), (2002, "short text"), (2003, "same " * 4000), (2004, "same " * 30), (None, "no id " * 10), (2005, "a　b " * 12)]
    for window, sizes in ((4, {"chunk_bytes": 400, "shard_bytes": 3000}), (7, {})):
        assert run(spark, rows, window, **sizes) == brute(rows, window)


def test_repeated_rows_and_nothing(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (0, "c d e f g")]
    assert run(spark, rows, 3) == brute(rows, 3)
    assert run(spark, [], 3) == [] and run(spark, [(1, None)], 3) == [(1, 0, 0, "")]


def test_query_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, g, hashlib.sha256(t.encode()).hexdigest()) for d, n, g, t in brute(rows, 20))
    assert sorted(map(tuple, queries.op3_substring_dedup(spark, sf_dir).collect())) == want
    assert any(r[2] for r in want)
