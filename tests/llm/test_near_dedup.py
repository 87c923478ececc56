import random

import numpy as np

from tickloom.llm import near_dedup


def brute(rows, percent, size=5):
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        found = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        sets.setdefault(doc_id, []).append(found)
    ids = sorted(x for x in sets if x is not None)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i in ids for s in sets[i] if s]
    by = {}
    for k, (_, s) in enumerate(flat):
        for x in s:
            by.setdefault(x, []).append(k)
    seen = set()
    for ks in by.values():
        for a in ks:
            for b in ks:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    s, t = flat[a][1], flat[b][1]
                    if 100 * len(s & t) >= percent * len(s | t):
                        x, y = find(flat[a][0]), find(flat[b][0])
                        root[max(x, y)] = min(x, y)
    out = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        n = min(size, len(w))
        k = len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) if w else 0
        out.append((doc_id, k, None if doc_id is None else find(doc_id), doc_id is not None and find(doc_id) == doc_id))
    return sorted(out, key=str)


def run(spark, rows, percent):
    df = spark.createDataFrame([(a, b, "x", 3) for a, b in rows], "doc_id long, text string, rep string, n int")
    return sorted(map(tuple, near_dedup.near_duplicates(df, percent).collect()), key=str)


def test_corpus_matches_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for percent in (80, 85):
        assert run(spark, rows, percent) == brute(rows, percent)


def test_edited_copies_and_odd_rows(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(500)]
    rows, base = [], [rng.choice(words) for _ in range(200)]
    for i in range(60):  # edits from few to many: similarities on both sides of the bound
        copy = list(base)
        for _ in range(i // 12):
            copy[rng.randrange(200)] = rng.choice(words)
        rows.append((100 + i, " ".join(copy)))
    rows += [(1, None), (2, ""), (3, " \n "), (4, "one two"), (5, "ONE\tTwo"), (6, "one two three"), (7, "É a b c d"), (8, "é a b c d")]
    rows += [(None, "one two"), (9, "same " * 9000), (10, "same " * 5), (90, rows[0][1]), (90, "other text of this very id"), (91, "other text of this very id")]
    for percent in (80, 85):
        assert run(spark, rows, percent) == brute(rows, percent)


def test_nothing(spark):
    assert run(spark, [], 80) == [] and run(spark, [(1, None)], 80) == [(1, 0, 1, True)]


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    rng = np.random.default_rng(1)
    for n in (1, 3, 40, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = a.copy()
        b[: n // 5] = rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = near_dedup.fast_sketch(np.unique(a)), near_dedup.fast_sketch(np.unique(b))
        assert (x != 0).all() and abs((x == y).mean() - exact) < 0.17


def test_parity_maps_never_part_like_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 150, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for changed in (0, 1, n // 10, n):
            b = np.unique(np.concatenate([a[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64)]))
            apart = np.bitwise_count(near_dedup.parity_map(a) ^ near_dedup.parity_map(b)).sum()
            assert apart <= len(np.setxor1d(a, b))
            assert changed or apart == 0
