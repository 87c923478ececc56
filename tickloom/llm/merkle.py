"""Merkle manifest of a dataset, by superblock reduction.

Rows are ranked within their tree by a range sort. Consecutive nodes are bucketed by fanout ** LEVELS;
one group collapses that many levels, the bucket roots are reduced again in the same way, and so on
to one root a tree. The roots of all trees, in the order of their names, form the upper tree. On the
way down each bucket's own proof is made first; a node's proof is the lower one, from its bucket, and
then its bucket's. So no group holds more than one bucket, however large a tree is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType
from pyspark.sql.window import Window

from tickloom.llm import common
from tickloom.llm.hashing import crc32_sql

FANOUT, LEVELS = 16, 2
#: Rows of one task of the range sort.
RANK_ROWS = 2_000_000


def field(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """sha256 (32 bytes) of the fields in a row."""
    return F.unhex(F.sha2(F.encode(F.concat(*map(field, values)), "UTF-8"), 256))


def tree_name(name: Column) -> Column:
    """A name that sorts like the given one, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit(""))


def ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (with `tree`, not null) with `i`, the rank within the tree, and `n`, the tree's size. A
    range sort over tree and order; a large tree lies in many partitions."""
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + nodes.count() // RANK_ROWS)
    ordered = nodes.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    placed = common.stage(ordered.withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "ranked")
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("held"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = runs.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("held").over(tree).alias("n"))
    bases = common.stage(bases, "bases")
    return placed.join(bases, ["tree", "part"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _above(nodes: list[bytes], fanout: int) -> list[bytes]:
    return [hashlib.sha256(b"".join(nodes[k : k + fanout]).hex().encode()).digest() for k in range(0, len(nodes), fanout)]


def _levels(nodes: list[bytes], n: int, fanout: int, levels: int) -> list[list[bytes]]:
    """The nodes of a bucket and those above them, up to `levels` levels or the root of a tree that
    has n nodes where the bucket's own lie."""
    out = [nodes]
    while len(out) <= levels and n > 1:
        out.append(_above(out[-1], fanout))
        n = -(-n // fanout)
    return out


def collapse(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(tree, i, n, hash) of the buckets of nodes (tree, i, n, hash)."""
    span = fanout**levels

    def run(key: tuple, bucket: pd.DataFrame) -> pd.DataFrame:
        n = int(bucket["n"].iloc[0])
        top = _levels(bucket.sort_values("i")["hash"].tolist(), n, fanout, levels)[-1]
        return pd.DataFrame({"tree": [key[0]], "i": [key[1]], "n": [-(-n // span)], "hash": [top[0]]})

    keyed = nodes.select("tree", F.floor(F.col("i") / span).cast("long").alias("bucket"), "i", "n", "hash")
    return keyed.groupBy("tree", "bucket").applyInPandas(run, "tree string, i long, n long, hash binary")


def proofs(nodes: DataFrame, upper: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, i, n, hash and more) with `proof` and the columns of upper (tree, i of the bucket,
    proof and more): the siblings within each node's bucket, level by level, left to right, then its
    bucket's proof."""
    span = fanout**levels
    more = [f for f in upper.schema.fields if f.name not in ("tree", "i", "proof")]
    schema = StructType([*nodes.schema.fields, StructField("proof", BinaryType()), *more])
    names = nodes.columns

    def run(bucket: pa.Table, above: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("i").select(names)
        some = len(bucket) > 0  # an empty table has an upper proof alone
        rows = _levels(bucket.column("hash").to_pylist(), bucket.column("n")[0].as_py() if some else 0, fanout, levels)
        tails = above.column("proof").to_pylist() if some else []
        for row in reversed(rows[:-1]):
            joined = [b"".join(row[k : k + fanout]) for k in range(0, len(row), fanout)]
            tails = [joined[k // fanout][: 32 * (k % fanout)] + joined[k // fanout][32 * (k % fanout + 1) :] + tails[k // fanout] for k in range(len(row))]
        bucket = bucket.append_column("proof", pa.array(tails, pa.binary()))
        for f in more:
            bucket = bucket.append_column(f.name, pa.repeat(above.column(f.name)[0], len(bucket)))
        return bucket

    bucketed = nodes.withColumn("bucket", F.floor(F.col("i") / span).cast("long")).groupBy("tree", "bucket")
    return bucketed.cogroup(upper.withColumnRenamed("i", "bucket").groupBy("tree", "bucket")).applyInArrow(run, schema)


def _rounds(nodes: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """nodes, their buckets, the buckets of these, and so on, down to one node a tree."""
    out, largest = [nodes], nodes.agg(F.max("n").alias("n")).first()["n"] or 1
    while largest > 1:
        out.append(common.stage(collapse(out[-1], fanout, levels), "buckets"))
        largest = -(-largest // fanout**levels)
    return out


def _down(rounds: list[DataFrame], upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The nodes of the first round with proofs that end in those of upper (one row a tree)."""
    below = rounds[:-1] or rounds
    for nodes in reversed(below[1:]):
        made = proofs(nodes, upper, fanout, levels)
        upper = common.stage(made.drop("n", "hash"), "proofs")
    return proofs(below[0], upper, fanout, levels)


def merkle_manifest(leaves: DataFrame, tree: Column, order: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """leaves (with `leaf`, 32 bytes, and any other columns) with `subroot` (of the leaf's tree),
    `root`, `proof` (the siblings from leaf to root, 32 bytes each, without a break) and where the
    leaf stands: `leaf_index` of `tree_leaves` in its tree, `tree_index` of `trees` in the upper tree.

    A node is the sha256 of its children's lower-case hexadecimal digests without a break. Defined
    results: an empty table has no rows; a tree of one leaf has it as its root, one tree alone gives
    the root; rows without a tree form one, before all others; rows alike in `order` stand in the
    order of their leaves; repeated rows are leaves each; a null in `order` comes first. Columns of
    the given names are replaced."""
    made = {"tree": tree_name(tree), "hash": F.col("leaf")}
    kept = [c for c in leaves.columns if c.lower() not in ("subroot", "root", "proof", "leaf_index", "tree_leaves", "tree_index", "trees")]
    names = {c: f"c{k}" for k, c in enumerate(kept)}
    plain = leaves.select(*[x.alias(n) for n, x in made.items()], *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    nodes = common.stage(ranked(common.stage(plain, "leaves"), *[names[c] for c in order], "hash"), "nodes")
    rounds = _rounds(nodes, fanout, levels)
    subroots = common.stage(rounds[-1].select("tree", "hash").dropDuplicates(), "subroots")
    upper = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    above = _rounds(common.stage(ranked(upper, "name"), "tree-nodes"), fanout, levels)
    root = above[-1].select("hash").first()
    start = leaves.sparkSession.createDataFrame([("", 0, bytearray())], "tree string, i long, proof binary")
    tops = _down(above, start, fanout, levels)
    tops = common.stage(tops.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("i"), "proof", F.col("hash").alias("subroot"), F.col("i").alias("tree_index"), F.col("n").alias("trees")), "tops")
    out = _down(rounds, tops, fanout, levels)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], "subroot", F.lit(root["hash"] if root else None).cast("binary").alias("root"), "proof", F.col("i").alias("leaf_index"), F.col("n").alias("tree_leaves"), "tree_index", "trees")


def fold(leaf: bytes, proof: bytes, shape: tuple[tuple[int, int], ...], fanout: int = FANOUT) -> bytes:
    """The root that a leaf and its siblings give; shape: (index, number of nodes) of each tree."""
    at, rest = leaf.hex(), proof.hex()
    for i, n in shape:
        while n > 1:
            run, place = divmod(i, fanout)
            others = 64 * (min(fanout, n - fanout * run) - 1)
            at = hashlib.sha256((rest[: 64 * place] + at + rest[64 * place : others]).encode()).hexdigest()
            rest, i, n = rest[others:], run, -(-n // fanout)
    return bytes.fromhex(at)


def folded(manifest: DataFrame, leaf: str, fanout: int = FANOUT) -> DataFrame:
    """A manifest with `folded_root`: the root that the column `leaf` and the row's proof give."""
    name = common.unused(manifest, "folded_root")[0]
    shape = ("leaf_index", "tree_leaves", "tree_index", "trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = zip(*[batch.column(c).to_pylist() for c in (leaf, "proof", *shape)])
            made = [fold(x, p, ((i, n), (j, m)), fanout) for x, p, i, n, j, m in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, name])

    return manifest.mapInArrow(run, StructType([*manifest.schema.fields, StructField(name, BinaryType())]))


def _tree_sql(name: str, nodes: str, key: str, levels: int) -> str:
    """CTEs {name}0 to {name}{levels}: (key, i, n, h, l, r) of a tree's levels with the siblings on
    the left and on the right; nodes: (key, i, n, h). A tree that has one node keeps it."""
    out, source = [], nodes
    for k in range(levels + 1):
        run = f"PARTITION BY {key}, i // 16 ORDER BY i ROWS BETWEEN"
        left, right = f"({run} UNBOUNDED PRECEDING AND 1 PRECEDING)", f"({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING)"
        out.append(f"{name}{k} AS (SELECT *, coalesce(string_agg(h, '') OVER {left}, '') AS l, coalesce(string_agg(h, '') OVER {right}, '') AS r FROM ({source}))")
        source = f"SELECT {key}, i // 16 AS i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h FROM {name}{k} GROUP BY {key}, i // 16, n"
    return ", ".join(out)


def _climb_sql(name: str, nodes: str, key: str, levels: int, top: str) -> str:
    """CTEs that take rows of `nodes` (key, i, got, proof and more) up the levels of a tree: got is the
    node that each gives so far, proof the siblings met; i counts within the level."""
    out = []
    for k in range(levels):
        here = f"{name}{k}"
        got = f"CASE WHEN {here}.n > 1 THEN sha256({here}.l || x.got || {here}.r) ELSE x.got END"
        out.append(f"{top}{k} AS (SELECT x.* REPLACE (x.i // 16 AS i, {got} AS got, x.proof || {here}.l || {here}.r AS proof) FROM {nodes if k == 0 else f'{top}{k - 1}'} x JOIN {here} ON x.{key} = {here}.{key} AND x.i = {here}.i)")
    return ", ".join(out)


def oracle_sql(levels: int = 5, upper: int = 4) -> str:
    """DuckDB SQL for op11, for trees of 16 ** levels leaves at most."""

    def cell(x: str) -> str:
        return f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"

    rest = " || ".join(map(cell, ("doc_id", "source", "lang", "n_chars")))
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({rest} || {cell("text")}) AS h,
         CASE WHEN {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '')")} % 5 = 0 THEN sha256({rest} || {cell(lowered)}) END AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM d
), {_tree_sql("low", "SELECT tree, i, n, h FROM leaves", "tree", levels)}, tops AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, 0 AS upper FROM low{levels}
), {_tree_sql("high", "SELECT upper, i, n, h FROM tops", "upper", upper)}, start AS (
  SELECT doc_id, h AS leaf, tree, i, coalesce(tampered, h) AS got, '' AS proof FROM leaves
), {_climb_sql("low", "start", "tree", levels, "up")}, middle AS (
  SELECT x.doc_id, x.leaf, x.got, x.proof, t.h AS subroot, t.i, 0 AS upper FROM up{levels - 1} x JOIN tops t ON x.tree = t.tree
), {_climb_sql("high", "middle", "upper", upper, "top")}
SELECT doc_id, leaf, subroot, (SELECT h FROM high{upper}) AS root, sha256(proof) AS proof_sha256, got AS folded_root,
       got = (SELECT h FROM high{upper}) AS verified
FROM top{upper - 1}
"""
