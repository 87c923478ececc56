import hashlib

import duckdb
from pyspark.sql import functions as F

from tickloom.llm import common, merkle, queries


def above(nodes, fanout):
    return [hashlib.sha256("".join(nodes[k : k + fanout]).encode()).hexdigest() for k in range(0, len(nodes), fanout)]


def climb(nodes, fanout):
    """(root, siblings of each node from its level up)."""
    rests = [""] * len(nodes)
    level, owner = nodes, list(range(len(nodes)))
    while len(level) > 1:
        for k, at in enumerate(owner):
            run = at - at % fanout
            rests[k] += "".join(x for j, x in enumerate(level[run : run + fanout], run) if j != at)
        level, owner = above(level, fanout), [at // fanout for at in owner]
    return level[0], rests


def brute(rows, fanout):
    """{(id, leaf): (subroot, root, proof)} of rows (tree, id, leaf)."""
    trees = {}
    for tree, i, leaf in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2])):
        trees.setdefault(tree, []).append((i, leaf))
    subs = {t: climb([leaf for _, leaf in v], fanout) for t, v in trees.items()}
    root, uppers = climb([s for s, _ in subs.values()], fanout)
    return {(i, leaf): (subs[t][0], root, p + upper) for (t, v), upper in zip(trees.items(), uppers) for (i, leaf), p in zip(v, subs[t][1])}


def manifest(spark, rows, fanout, levels, extra=False):
    df = spark.createDataFrame(rows, "tree string, id long, leaf string").withColumn("leaf", F.unhex("leaf"))
    if extra:
        df = df.withColumns({"Proof": F.lit("x"), "i": F.lit(1), "hash": F.lit(2), "part": F.lit(None).cast("long")})
    made = merkle.folded(merkle.merkle_manifest(df, F.col("tree"), ["id"], fanout, levels), "leaf", fanout)
    return made, {(r["id"], r["leaf"].hex()): (r["subroot"].hex(), r["root"].hex(), r["proof"].hex(), r["folded_root"].hex()) for r in made.collect()}


def leaves(sizes):
    return [(t, k, hashlib.sha256(f"{t}/{k}".encode()).hexdigest()) for t, n in sizes.items() for k in range(n)]


def test_trees_of_many_sizes_equal_brute_force(spark):
    for fanout, levels in ((2, 2), (4, 3)):
        rows = leaves({None: 5, "": 1, "a": 2, "b": 3, "hot": 150, "z": 9, "é": 17, "A": 16, "q": 65})
        _, got = manifest(spark, rows, fanout, levels)
        want = brute(rows, fanout)
        assert {k: v[:3] for k, v in got.items()} == want
        assert {v[3] for v in got.values()} == {v[1] for v in want.values()}


def test_single_leaf_single_tree_nulls_repeats_and_clashing_columns(spark):
    leaf = hashlib.sha256(b"x").hexdigest()
    assert manifest(spark, [("a", 1, leaf)], 16, 2)[1] == {(1, leaf): (leaf, leaf, "", leaf)}
    rows = [*leaves({"a": 40}), ("a", None, leaf), ("a", None, leaf), ("a", 7, leaf)]
    made, got = manifest(spark, rows, 16, 2, extra=True)
    assert {k: v[:3] for k, v in got.items()}.keys() == brute(rows, 16).keys() and made.count() == 43
    once = {k: v for k, v in brute(rows, 16).items() if k != (None, leaf)}
    assert {k: got[k][:3] for k in once} == once
    assert {"i", "hash", "part", "proof", "folded_root"} <= set(made.columns) and "Proof" not in made.columns
    empty, none = manifest(spark, [], 16, 2)
    assert none == {} and "root" in empty.columns


def test_tampered_leaf_does_not_verify(spark):
    made, _ = manifest(spark, leaves({"a": 20, "b": 3}), 16, 2)
    other = merkle.folded(made.drop("folded_root").withColumn("wrong", F.unhex(F.sha2(F.encode(F.lit("y"), "UTF-8"), 256))), "wrong")
    assert other.where("folded_root = root").count() == 0


def test_fields_tell_nulls_from_texts(spark):
    row = spark.createDataFrame([(None, "-", "", "é")], "a string, b string, c string, d string").select(F.concat(*[merkle.field(F.col(c)) for c in "abcd"]).alias("x")).first()
    assert row["x"] == "-1:-0:2:é"


def test_query_equals_sql_and_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r.asDict() for r in queries.op11_merkle_manifest(spark, sf_dir).collect()}
    found = duckdb.connect()
    found.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    sql = found.execute(queries.oracle_sql()["op11_merkle_manifest"])
    names = [d[0] for d in sql.description]
    assert got == {r[names.index("doc_id")]: dict(zip(names, r)) for r in sql.fetchall()}

    def cell(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    docs = common.table(spark, sf_dir, "documents").collect()
    rows = [(d["source"], d["doc_id"], hashlib.sha256("".join(map(cell, (d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]))).encode()).hexdigest()) for d in docs]
    for (i, leaf), (subroot, root, proof) in brute(rows, 16).items():
        assert (got[i]["leaf"], got[i]["subroot"], got[i]["root"], got[i]["proof_sha256"]) == (leaf, subroot, root, hashlib.sha256(proof.encode()).hexdigest())
    assert {r["verified"] for r in got.values()} == {True, False}
