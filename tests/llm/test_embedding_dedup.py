import numpy as np

from tickloom.llm import common, embedding_dedup, queries


def brute(rows, cosine=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    out, root = {}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links, n = [0] * len(good), 0
    for k, (i, v) in enumerate(good):
        for j, (o, w) in enumerate(good):
            if j != k and len(v) == len(w) and (v @ w) / np.sqrt((v @ v) * (w @ w)) >= cosine:
                links[k] += 1
                n += 1
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
    return {i: (links[k], find(i)) for k, (i, _) in enumerate(good)}, n


def frame(spark, rows):
    return spark.createDataFrame([(a, b, 1, 2.0) for a, b in rows], "vec_id long, embedding array<double>, e int, rep double")


def test_clusters_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(64)
        for _ in range(6):
            rows.append((len(rows), (centre + rng.standard_normal(64) * 0.15).tolist()))
    rows += [(1000 + k, rows[5][1]) for k in range(7)] + [(2000, (np.array(rows[5][1]) * 3).tolist())]
    plain = {i for i, _ in rows}
    odd = [(3000, None), (3001, [0.0] * 64), (3002, [float("nan")] * 64), (3003, [1.0, None]), (None, rows[5][1]), (3004, [1.0, 2.0]), (3005, [2.0, 4.0]), (3006, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_duplicates(frame(spark, rows + odd)).collect()}
    want, n = brute(rows + odd[5:7])
    assert len(got) == len(rows) + len(odd)
    assert sum(got[i][0] for i in plain) >= 0.97 * sum(want[i][0] for i in plain)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.97 * len(want)
    assert all(got[i] == (0, i, True) for i in (3000, 3001, 3002, 3003, 3006)) and got[3004][1] == got[3005][1] == 3004
    assert got[None] == (0, None, False) and all(k == (i == c) for i, (_, c, k) in got.items() if i is not None)


def test_recall_of_the_query(spark, sf_dir, tmp_path):
    """The table with noisy copies added, at cosines from 0.88 up."""
    rows = [(r["vec_id"], list(r["embedding"])) for r in common.table(spark, sf_dir, "embeddings").collect()]
    rng = np.random.default_rng(9)
    for k in range(300):
        v = np.array(rows[k // 3][1])
        rows.append((10_000 + k, (v + rng.standard_normal(len(v)) * np.linalg.norm(v) / 8 * rng.uniform(0, 0.5)).tolist()))
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, n = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in queries.op7_embedding_dedup(spark, str(tmp_path)).collect()}
    assert set(got) == {i for i, _ in rows}
    assert n > 500 and sum(k for k, _ in got.values()) >= 0.97 * n and all(got[i][0] <= want[i][0] for i in want)


def test_nothing(spark):
    assert embedding_dedup.embedding_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in embedding_dedup.embedding_duplicates(frame(spark, [(4, [1.0, 0.0])])).collect()] == [(4, 0, 4, True)]


def test_codes_are_balanced():
    x = np.random.default_rng(0).standard_normal((2000, 32)) * np.linspace(0.1, 3, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    share = embedding_dedup.code_bits(x, embedding_dedup.learn_rotations(x, 32, 3)).mean(axis=0)
    assert len(share) == 96 and (abs(share - 0.5) < 0.1).all()


def pairs_at(rng, dim, n, cosine):
    """Unit vectors and partners at exactly the cosine."""
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    o = rng.standard_normal((n, dim))
    o -= (o * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + (1 - cosine**2) ** 0.5 * o / np.linalg.norm(o, axis=1, keepdims=True)


def test_planes_meet_at_every_width_and_dimension():
    for width in range(16, 26):
        tables = embedding_dedup.plane_tables(width, 0.9)
        for dim in (2, 8, 64, 200):
            x, y = pairs_at(np.random.default_rng(width), dim, 300, 0.9)
            draws = [[embedding_dedup.plane_keys(v, width, tables, seed) for v in (x, y)] for seed in range(8 if dim < 64 else 2)]
            met = np.mean([(a == b).any(axis=1).mean() for a, b in draws])
            assert met >= 1 - embedding_dedup.MISS - 0.03, (width, dim)


def test_codes_alone_meet_at_every_width():
    """No table of planes is added for centred vectors, and the codes carry the links: the share of
    pairs at the cosine that meet in a table of the quantised codes, for a corpus of 65 thousand to 33
    million vectors."""
    rng = np.random.default_rng(8)
    sample = rng.standard_normal((4096, 64)) * np.linspace(0.5, 1.5, 64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    for width in range(16, 26):
        rotations, tables = embedding_dedup.code_tables(64, width, 0.9)
        model = embedding_dedup.learn_rotations(sample[:1024], 64, rotations)
        x, y = pairs_at(rng, 64, 2000, 0.9)
        met = (embedding_dedup._keys(embedding_dedup.code_bits(x, model), width, tables) == embedding_dedup._keys(embedding_dedup.code_bits(y, model), width, tables)).any(axis=1).mean()
        share = embedding_dedup.missed(sample, model, width, tables, 0.9)
        assert met >= 0.95 and embedding_dedup.added_planes(share, max(16, width - 4), 0.9) == 0, (width, met, share)


def test_planes_are_added_off_centre_and_in_few_dimensions():
    rng = np.random.default_rng(8)
    sample = rng.standard_normal((2000, 64)) / 8 + 3 * np.eye(64)[0]
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    rotations, tables = embedding_dedup.code_tables(64, 16, 0.99)
    share = embedding_dedup.missed(sample, embedding_dedup.learn_rotations(sample, 64, rotations), 16, tables, 0.99)
    assert share > 0.2 and embedding_dedup.added_planes(share, 16, 0.99) > 0
    assert embedding_dedup.added_planes(1.0, 16, 0.9) == embedding_dedup.plane_tables(16, 0.9)


def test_recall_stays_with_the_width_of_many_rows(spark):
    x, y = pairs_at(np.random.default_rng(2), 64, 1500, 0.902)
    rows = [(i, v.tolist()) for i, v in enumerate(np.stack([x, y], axis=1).reshape(-1, 64))]
    for width in (17, 25):
        got = embedding_dedup.embedding_duplicates(frame(spark, rows), width=width).collect()
        assert sum(r["n_links"] for r in got) >= 0.95 * len(rows)


def test_table_off_centre(spark):
    """Unit vectors with three times a common part: about half of all pairs are links."""
    v = np.random.default_rng(5).standard_normal((300, 64))
    v = v / np.linalg.norm(v, axis=1, keepdims=True) + 3 * np.eye(64)[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    want, n = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.embedding_duplicates(frame(spark, rows)).collect()}
    assert n > 30_000 and sum(k for k, _ in got.values()) >= 0.95 * n
    assert all(got[i][0] <= want[i][0] for i in want) and sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(rows)


def test_bound_of_the_sketches():
    for cosine in (0.7, 0.9, 0.99, 1.0):
        for dim in (1, 2, 64):
            if dim > 1 or cosine == 1:
                x, y = pairs_at(np.random.default_rng(dim), dim, 3000, cosine) if dim > 1 else [np.ones((9, 1))] * 2
                apart = np.bitwise_count((embedding_dedup.sketches(x) ^ embedding_dedup.sketches(y)).view(np.uint64)).sum(axis=1)
                assert (apart <= embedding_dedup.most_apart(cosine)).mean() > 0.999


def test_unlike_vectors_of_one_id(spark):
    """Links are of vectors; an id's vectors share a component."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0]), (1, [1.0, 0.0, 0.0, 0.0]), (5, [0.0, 0.0, 1.0, 0.0])]
    got = sorted(tuple(r) for r in embedding_dedup.embedding_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (5, 0, 5, True)]
