"""MinHash near-duplicates over word shingles, by fast similarity sketching.

A document's sketch has `t` coordinates. In round i every shingle falls into a bin given by a hash
of (round, shingle) and offers a value; a bin keeps the least value of the first round that reached
it. Rounds from t on send every shingle to one fixed bin, so after at most 2t rounds all bins are
full (Dahlgaard, Knudsen, Thorup 2017: concentration as for independent hashing). Coordinates are
banded; documents that share a band are compared by one-bit sketches and then confirmed on their
full shingle sets. Parity maps (odd sketches, Mitzenmacher, Pagh, Pham 2014) come in between: bits
that differ between two maps never outnumber the shingles that differ between the sets, so a pair
that they part is surely unlike, and no link is lost.

Equal sets collapse to their smallest doc_id first. In a band's bucket each member is compared with
the smallest one; members that stay apart are then compared with those of other clusters only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common, hashing
from tickloom.llm.components import connected_components

T, BANDS = 128, 32
#: Bits kept of each coordinate: one for a first comparison, all for those between clusters.
PLANES = 4
#: Words of 64 bits in a parity map.
PARITY = 16
#: Standard deviations from the mean of differing coordinates, at the similarity asked for, beyond
#: which a pair is not confirmed.
DEVIATIONS = 6
_LOW = 64 - (T.bit_length() - 1)
SKETCH_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long, b1 long, b2 long, planes array<long>, parity array<long>, bands array<long>"


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words than `size`: the sequence as one."""
    words = hashing.words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    return np.unique(hashing.window_hashes(hashing.word_hashes(words), n) + np.uint64((size - n) * 0x632BE59BD9B4E019 % (1 << 64)))


def fast_sketch(shingles: np.ndarray, t: int = T) -> np.ndarray:
    """The t coordinates of a non-empty set, each the (round, value) of its least offer as 64 bits."""
    low = np.uint64(64 - (t.bit_length() - 1))
    sketch, filled = np.zeros(t, np.uint64), np.zeros(t, bool)
    starts = np.arange(t, dtype=np.uint64) << low
    for i in range(2 * t):
        offers = hashing.mix(shingles ^ hashing.mix(np.array([i + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        tag = np.uint64((i + 1) * 0xD1B54A32D192ED03 % (1 << 64))
        if i < t:
            offers.sort()
            at = np.searchsorted(offers, starts)
            inside = at < len(offers)
            least = offers[np.minimum(at, len(offers) - 1)]
            new = inside & ((least >> low) == np.arange(t, dtype=np.uint64)) & ~filled
            sketch[new] = hashing.mix(least[new] ^ tag)
            filled |= new
        elif not filled[i - t]:
            sketch[i - t] = hashing.mix(np.array([offers.min() ^ tag]))[0]
            filled[i - t] = True
        if filled.all():
            break
    return sketch


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of the shingles hash to i."""
    counts = np.bincount((hashing.mix(shingles ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits(counts & 1).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch], size: int, bands: int) -> Iterator[pa.RecordBatch]:
    rows = T // bands
    weights = hashing.mix(np.arange(1, rows + 1, dtype=np.uint64))
    one = np.uint64(1)
    for batch in common.slices(batches):
        n, s1, s2, bits, odd, keys = [], [], [], [], [], []
        shifts = np.arange(PLANES, dtype=np.uint64)[:, None]
        for text in batch.column("text").to_pylist():
            found = shingle_set(text, size)
            n.append(len(found))
            if not len(found):
                s1.append(0), s2.append(0), bits.append(np.zeros(2 * PLANES, np.int64)), odd.append([]), keys.append([])
                continue
            s1.append(int(hashing.mix(found ^ one).sum().view(np.int64)))
            s2.append(int(np.bitwise_xor.reduce(hashing.mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))).view(np.int64)))
            odd.append(parity_map(found))
            sketch = fast_sketch(found)
            bits.append(np.packbits((sketch >> shifts & one).astype(np.uint8), axis=1).view(np.int64).ravel())
            keys.append(hashing.mix((sketch.reshape(bands, rows) * weights).sum(axis=1)).view(np.int64))
        planes = np.array(bits, np.int64).reshape(-1, 2 * PLANES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(planes[:, 0]), pa.array(planes[:, 1]), pa.array(list(planes[:, 2:]), pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "s1", "s2", "b1", "b2", "planes", "parity", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches):
        found = [shingle_set(t, size).view(np.int64) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; documents are linked when
    100 * intersection >= percent * union of their shingle sets.

    Defined results: an empty table gives no rows; a text without words (or null) has no shingles
    and is linked with nothing; rows that share a doc_id count as one document, linked by any of
    their texts; a null doc_id is linked with nothing (component_id null, kept false); other columns
    are ignored."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = common.stage(plain.mapInArrow(lambda b: _sketches(b, size, bands), SKETCH_SCHEMA), "sketches")
    linkable = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = common.stage(linkable.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    of_class = linkable.select("doc_id", "s1", "s2", "n_shingles", "b1", "b2", "bands").join(
        classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.col("n_shingles").alias("cn"), "rep"),
        (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")),
    )
    first = of_class.where("doc_id = rep").select("rep", F.col("n_shingles").alias("n"), "b1", "b2", F.posexplode("bands").alias("band", "key"))
    in_bands = common.stage(first.dropDuplicates(["rep", "n", "b1", "b2", "band", "key"]), "bands")

    def bound(bits: int) -> int:
        differ = (1 - percent / 100) * (1 - 2.0**-bits)
        return int(T * differ + DEVIATIONS * (T * differ * (1 - differ)) ** 0.5)

    def alike(x: str, y: str):
        apart = F.bit_count(F.col(f"{x}.b1").bitwiseXOR(F.col(f"{y}.b1"))) + F.bit_count(F.col(f"{x}.b2").bitwiseXOR(F.col(f"{y}.b2")))
        less, more = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
        return (apart <= bound(1)) & (less * 100 >= more * percent)

    buckets = in_bands.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("band", "key", "hub")
    hubs = common.stage(
        in_bands.alias("h").join(buckets.alias("u"), (F.col("h.band") == F.col("u.band")) & (F.col("h.key") == F.col("u.key")) & (F.col("h.rep") == F.col("u.hub"))).select("h.*"), "hubs"
    )
    members = in_bands.alias("x").join(hubs.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") > F.col("y.rep")))
    stars = common.stage(members.where(alike("x", "y")).select(F.col("y.rep").alias("a"), F.col("x.rep").alias("b")).distinct(), "stars")

    # Members and smallest member of every shared bucket: what may have to be confirmed.
    shared = in_bands.join(hubs.select("band", "key"), ["band", "key"], "left_semi").select("rep").distinct()
    texts = plain.join(shared.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")
    sets = common.stage(texts.mapInArrow(lambda b: _sets(b, size), "doc_id long, shingles array<long>"), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        mine = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        other = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = pairs.join(mine, "a").join(other, "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("i") * 100 >= (F.size("sa") + F.size("sb") - F.col("i")) * percent).select("a", "b")

    near = common.stage(confirmed(stars), "near")
    label = near.groupBy(F.col("b").alias("rep")).agg(F.min("a").alias("label"))
    further = label.select(F.col("rep").alias("label"), F.col("label").alias("further"))
    labels = common.stage(label.join(further, "label", "left").select("rep", F.coalesce("further", "label").alias("label")), "cluster")
    tagged = in_bands.join(hubs.select("band", "key"), ["band", "key"], "left_semi").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    tagged = common.stage(tagged, "tagged")
    common.unstage(in_bands, hubs, labels)
    mixed = tagged.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    mixed = common.stage(mixed, "mixed")
    apart = common.stage(tagged.join(mixed.select("band", "key"), ["band", "key"], "left_semi"), "apart")
    common.unstage(tagged, mixed)
    # A shingle that only one of these documents has is in no intersection: what is left of a
    # document bounds its similarity to any other, and most edited copies link with none of them.
    those = common.stage(apart.select(F.col("rep").alias("doc_id")).distinct(), "those")
    once = sets.join(those, "doc_id", "left_semi").select("doc_id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("doc_id").alias("rep")).where("k = 1")
    own = common.stage(once.groupBy("rep").agg(F.count("*").alias("own")), "own")
    in_mixed, apart = apart, common.stage(apart.join(own, "rep", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("common") * 100 >= F.col("n") * percent), "apart")
    common.unstage(in_mixed, those, own)
    most = F.least("x.common", "y.common")
    planes = sketched.select(F.col("doc_id").alias("rep"), "n_shingles", "b1", "b2", "planes", "parity", "bands").dropDuplicates(["rep", "n_shingles", "b1", "b2"])
    bare, apart = apart, common.stage(apart.withColumnRenamed("n", "n_shingles").join(planes, ["rep", "n_shingles", "b1", "b2"]).withColumnRenamed("n_shingles", "n"), "apart")

    common.unstage(bare)

    def unlike(half: int):
        seen = F.col(f"x.b{half + 1}").bitwiseXOR(F.col(f"y.b{half + 1}"))
        for k in range(half, 2 * PLANES - 2, 2):
            seen = seen.bitwiseOR(F.col("x.planes")[k].bitwiseXOR(F.col("y.planes")[k]))
        return F.bit_count(seen)

    odd = sum((F.bit_count(F.col("x.parity")[k].bitwiseXOR(F.col("y.parity")[k])) for k in range(1, PARITY)), F.bit_count(F.col("x.parity")[0].bitwiseXOR(F.col("y.parity")[0])))
    few = odd * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    first = F.lit(bands)
    for k in reversed(range(bands)):
        first = F.when(F.col("x.bands")[k] == F.col("y.bands")[k], k).otherwise(first)
    close = unlike(0) + unlike(1) <= bound(PLANES)
    fits = most * 100 >= (F.col("x.n") + F.col("y.n") - most) * percent
    cross = apart.alias("x").join(apart.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.label") != F.col("y.label")) & fits & few & close & (first == F.col("x.band")))
    # A pair is made in the first band it shares: what parts it there would part it in any other.
    pairs = cross.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    pairs = common.stage(pairs, "pairs")
    links = common.stage(near.unionAll(confirmed(pairs)), "links")
    common.unstage(apart, stars, near, pairs, sets)
    # A doc_id with several texts belongs to several classes: these links join them.
    several = of_class.where("doc_id > rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    again = linkable.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    repeats = several.join(again.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    found = connected_components(links.unionAll(repeats))

    classed = common.stage(of_class.select("doc_id", "n_shingles", "rep"), "classed")
    linked = classed.join(found.select(F.col("node").alias("rep"), F.col("component").alias("of_rep")), "rep", "left").select("doc_id", "n_shingles", F.coalesce("of_rep", "rep").alias("component_id"))
    alone = sketched.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
