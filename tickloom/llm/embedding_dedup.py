"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Rotations are learnt on a bounded sample (PCA, then alternating sign and Procrustes steps, from
different starts on different halves), each giving one balanced bit a dimension, 64 at most. The bits
of all rotations are one code, cut into substrings of about log2(n) bits, one table each: two vectors
meet where they agree in a whole substring, so a pair whose codes differ in fewer bits than there are
tables always does. There are as many tables, and so rotations, as a pair at the asked cosine needs to
meet with a chance of 1 - MISS, at every width. That share is measured on the driver with pairs made
at the cosine from the sample; where vectors lie far off centre, or have so few dimensions that
rotations repeat each other, it falls short, and tables of random planes through the origin, which
part a pair by its angle alone, are added for what is missing. Found pairs whose sketches of further
planes differ by no more than the angle explains are confirmed by the cosine of the original vectors
in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common
from tickloom.llm.components import connected_components

SAMPLE_ROWS, ITERATIONS, MAX_BITS = 4096, 40, 64
#: Most rotations; vectors of few dimensions would need more, and have planes for the rest.
MAX_ROTATIONS = 96
#: Planes whose sides are counted before the cosine is taken, and the chance that a pair at the
#: asked cosine differs in more of them than the bound allows.
SKETCH, DROPPED = 128, 1e-5
#: Chance that a pair at the asked cosine meets in no table; how far the measured share of the codes
#: may exceed it before planes are added, and the pairs it is measured with.
MISS, SLACK, TRIED = 0.02, 0.015, 2000


def learn_rotations(sample: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to count * bits numbers): iterative quantisation (Gong and Lazebnik 2011) of
    unit vectors, once for each rotation, on a half of the sample of its own."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :bits]
    v = centred @ axes
    out = []
    for seed in range(count):
        rng = np.random.default_rng(seed)
        part = v[rng.random(len(v)) < 0.5] if len(v) > 4 * bits else v
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(ITERATIONS):
            u, _, w = np.linalg.svd(np.where(part @ r >= 0, 1.0, -1.0).T @ part)
            r = (u @ w).T
        out.append(axes @ r)
    return mean, np.concatenate(out, axis=1)


def code_bits(unit: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """(rows, bits) of the codes of all rotations."""
    mean, projection = model
    return (unit - mean) @ projection >= 0


def _keys(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """(rows, tables) keys of width consecutive bits each."""
    padded = np.zeros((len(bits), tables, 32), np.uint8)
    padded[:, :, :width] = bits[:, : tables * width].reshape(len(bits), tables, width)
    return np.packbits(padded, axis=2, bitorder="little").view("<i4")[:, :, 0]


def code_tables(bits: int, width: int, cosine: float) -> tuple[int, int]:
    """(rotations, tables) with keys of width bits from codes of `bits` bits a rotation."""
    wanted = plane_tables(width, cosine)
    rotations = min(MAX_ROTATIONS, -(-wanted * width // bits))
    return rotations, max(1, min(wanted, rotations * bits // width))


def missed(sample: np.ndarray, model: tuple[np.ndarray, np.ndarray], width: int, tables: int, cosine: float) -> float:
    """The share of pairs at the cosine, made from the sample, that meet in no table of the codes."""
    rng = np.random.default_rng(3)
    x = sample[rng.integers(0, len(sample), TRIED)]
    o = rng.standard_normal(x.shape)
    o -= (o * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(o, axis=1, keepdims=True)
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * o / np.where(size > 0, size, 1.0)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return 1 - float((_keys(code_bits(x, model), width, tables) == _keys(code_bits(y, model), width, tables)).any(axis=1).mean())


def added_planes(share: float, width: int, cosine: float) -> int:
    """Tables of random planes that bring a missed share down to MISS; none within the slack."""
    if share <= MISS + SLACK:
        return 0
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** width
    return 1 if same >= 1 else math.ceil(math.log(MISS / share) / math.log1p(-same))


def plane_tables(width: int, cosine: float) -> int:
    """Tables of width planes that a pair at the cosine misses altogether with a chance of MISS."""
    same = (1 - math.acos(min(1.0, cosine)) / math.pi) ** width
    return 1 if same >= 1 else max(1, math.ceil(math.log(MISS) / math.log1p(-same)))


def most_apart(cosine: float) -> int:
    """The least bound on differing sketch bits that a pair at the cosine exceeds with a chance of
    DROPPED at most: a plane through the origin parts it with a chance of its angle over pi."""
    p = math.acos(min(1.0, cosine)) / math.pi
    left, k = 1 - (1 - p) ** SKETCH, 0
    while left > DROPPED:
        k += 1
        left -= math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
    return k + 1  # one for signs that rounding turns


def sketches(unit: np.ndarray) -> np.ndarray:
    """(rows, 2) longs: the sides of SKETCH random planes through the origin."""
    planes = np.random.default_rng(11).standard_normal((unit.shape[1], SKETCH))
    return np.packbits(unit @ planes >= 0, axis=1, bitorder="little").view("<i8")


def plane_keys(unit: np.ndarray, width: int, tables: int, seed: int = 7) -> np.ndarray:
    """(rows, tables) keys of width bits, each bit the side of a random plane through the origin."""
    planes = np.random.default_rng(seed).standard_normal((unit.shape[1], tables * width))
    return _keys(unit @ planes >= 0, width, tables)


def _class() -> Column:
    """A class of equal vectors, by both hashes of its vector."""
    return F.xxhash64("s1", "s2")


def embedding_duplicates(vectors: DataFrame, cosine: float = 0.9, sample_rows: int = SAMPLE_ROWS, width: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row.

    Equal vectors are one class first; only class representatives are searched, and a link to a
    class counts all its members. Defined results: an empty table gives no rows; vectors that are
    null, zero or hold null or non-finite components, and rows without vec_id, link with nothing;
    vectors of different length do not link; rows of equal vec_id count as vectors each, in one
    component; other columns are ignored. width is the bits of a table's key, by the number of
    rows where it is not given."""
    spark = vectors.sparkSession
    e = F.col("e")
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    good = e.isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    marked = common.stage(given.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("s1", F.xxhash64("e")).withColumn("s2", F.xxhash64(F.lit(1), "e")), "vectors")
    usable = marked.where("good")
    classes = common.stage(usable.groupBy("s1", "s2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members")), "classes")
    keyed = classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "rep", "members")
    member = common.stage(usable.join(keyed, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2"))).select("vec_id", "e", "s1", "s2", "rep", "members"), "members")
    reps = common.stage(member.where("vec_id = rep").dropDuplicates(["s1", "s2"]).select(_class().alias("cls"), "rep", "members", "e", F.size("e").alias("dim")), "representatives")

    links = None
    for dim, n in sorted((r["dim"], r["count"]) for r in reps.groupBy("dim").count().collect()):  # few lengths
        some = reps.where(F.col("dim") == dim)
        lot = F.pmod(F.xxhash64("cls"), F.lit(1 << 40))
        rows = some.where(lot < int((1 << 40) * min(1.0, sample_rows / n))).select("e").limit(2 * sample_rows).collect()
        sample = np.array([r["e"] for r in rows], np.float64).reshape(-1, dim)
        sample /= np.linalg.norm(sample / np.abs(sample).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(sample).max(axis=1, keepdims=True) if len(sample) else 1
        bits, wide = min(MAX_BITS, dim), width or min(32, max(16, math.ceil(math.log2(n + 1))))
        rotations, tables = code_tables(bits, wide, cosine)
        if len(sample):
            model = learn_rotations(sample, bits, rotations)
            share = missed(sample, model, wide, tables, cosine)
        else:
            model, share = (np.zeros(dim), np.tile(np.eye(dim)[:, :bits], rotations)), 1.0
        found = _links(some, model, tables, wide, added_planes(share, max(16, wide - 4), cosine), cosine)
        links = found if links is None else links.unionAll(found)
    alone = marked.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if links is None:
        out = alone
    else:
        links = common.stage(links, "links")
        repeats = member.where("vec_id > rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
        again = marked.groupBy("vec_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("vec_id").alias("b"))
        component = connected_components(links.select(F.col("ra").alias("a"), F.col("rb").alias("b")).unionAll(repeats.join(again, "b", "left_semi").select("a", "b")))
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("mb").alias("m")), F.struct(F.col("b").alias("cls"), F.col("ma").alias("m")))).alias("x")).select("x.*")
        counts = common.stage(ends.groupBy("cls").agg(F.sum("m").alias("others")), "counts")
        out = (
            member.withColumn("cls", _class()).join(counts, "cls", "left")
            .join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
            .select("vec_id", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
            .unionAll(alone)
        )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(reps: DataFrame, model: tuple[np.ndarray, np.ndarray], tables: int, width: int, planes: int, cosine: float) -> DataFrame:
    """(a, b, ra, rb, ma, mb): linked classes, their representatives and sizes."""
    held = reps.sparkSession.sparkContext.broadcast(model)  # dimensions by bits of the rotations
    # a plane table has somewhat fuller buckets, as it stands in for several of the codes
    wide = max(16, width - 4)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x = _matrix(batch.column("e"))
            x = x / np.abs(x).max(axis=1, keepdims=True)
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
            keys, sketch = _keys(code_bits(unit, held.value), width, tables), sketches(unit)
            if planes:
                keys = np.concatenate([keys, plane_keys(unit, wide, planes)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("cls"), *[pa.array(c) for c in sketch.T], lists], names=["cls", "s0", "s1", "keys"])

    coded = common.stage(reps.select("cls", "e").mapInArrow(encode, "cls long, s0 long, s1 long, keys array<int>"), "codes")
    stored = coded.select("cls", "s0", "s1", F.posexplode("keys").alias("t", "key"))

    def differing(name: str) -> Column:
        return F.bit_count(F.col(f"x.{name}").bitwiseXOR(F.col(f"y.{name}")))

    near = differing("s0") + differing("s1") <= most_apart(cosine)
    met = stored.alias("x").join(stored.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.cls") < F.col("y.cls")) & near)
    pairs = common.stage(met.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct(), "met")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            x, y = _matrix(batch.column("ea")), _matrix(batch.column("eb"))
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            dot = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:6]), names=["a", "b", "ra", "rb", "ma", "mb"]).filter(pa.array(dot >= cosine))

    one = reps.select(F.col("cls").alias("a"), F.col("rep").alias("ra"), F.col("members").alias("ma"), F.col("e").alias("ea"))
    two = reps.select(F.col("cls").alias("b"), F.col("rep").alias("rb"), F.col("members").alias("mb"), F.col("e").alias("eb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "ra", "rb", "ma", "mb", "ea", "eb")
    return both.mapInArrow(confirm, "a long, b long, ra long, rb long, ma long, mb long")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
