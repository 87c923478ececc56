"""Benchmark decontamination by pigeonhole edit matching.

An item of L normalised characters may differ from a passage by e = floor(L * rate) edits. Cut into
e + 1 pieces, one piece at least is untouched, so every passage within the budget holds an exact
piece. An automaton finds the pieces in whole texts; each hit's surroundings are verified with
Myers' bit-parallel edit distance: few spans with one long integer each, many side by side in words
of 64 bits. Documents are only mapped over. Where the benchmark has more than one block, each block
is one such pass that leaves only what it found, by the hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tickloom.llm import common

RATE = 0.05
#: Benchmarks are matched in blocks of about this many bytes; only a block is sent to the workers.
BLOCK_BYTES = 8 << 20
#: From this many spans on they are verified side by side; spans in one tile.
MANY, TILE = 48, 2048


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length."""
    bounds = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:])]


class Pattern:
    """One item for Myers' search: the least edit distance to any substring of a text."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def distance(self, text: str) -> int:
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        up, down, score = full, 0, self.length
        best = score
        masks = self.masks
        for c in text:
            eq = masks.get(c, 0)
            x = (((eq & up) + up) ^ up) | eq
            rise, fall = down | (full & ~(x | up)), up & x
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
                if score < best:
                    best = score
            x = eq | down
            rise, fall = rise << 1 & full, fall << 1 & full
            up, down = fall | (full & ~(x | rise)), rise & x
        return best

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(code points, their masks in words of 64 bits, lowest first)."""
        words = -(-self.length // 64)
        points = np.array(sorted(map(ord, self.masks)), np.uint32)
        rows = [[self.masks[chr(p)] >> 64 * w & (1 << 64) - 1 for w in range(words)] for p in points.tolist()]
        return points, np.array(rows, np.uint64).reshape(len(points), words)


def least_distances(pairs: list[tuple[Pattern, str]]) -> np.ndarray:
    """Pattern.distance of every pair, a column of all texts at a time. Patterns of as many words go
    together; shorter texts are filled up with what matches nothing, which lowers no distance."""
    out = np.zeros(len(pairs), np.int64)
    by_words: dict[int, list[int]] = {}
    for i, (pattern, _) in enumerate(pairs):
        by_words.setdefault(-(-pattern.length // 64), []).append(i)
    for words, own in by_words.items():
        own.sort(key=lambda i: len(pairs[i][1]))
        for at in range(0, len(own), TILE):
            tile = own[at : at + TILE]
            out[tile] = _columns([pairs[i] for i in tile], words)
    return out


def _columns(pairs: list[tuple[Pattern, str]], words: int) -> np.ndarray:
    width = max(len(t) for _, t in pairs)
    tables, start, filled = {}, {}, [np.zeros((1, words), np.uint64)]
    size = 1
    for pattern in {id(p): p for p, _ in pairs}.values():
        points, masks = pattern.table()
        tables[id(pattern)], start[id(pattern)] = points, size
        filled.append(masks)
        size += len(points)
    masks = np.concatenate(filled)
    rows = np.zeros((width, len(pairs)), np.int32)  # 0: a character without a mask
    for k, (pattern, text) in enumerate(pairs):
        points, codes = tables[id(pattern)], np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        found = np.minimum(np.searchsorted(points, codes), len(points) - 1)
        rows[: len(codes), k] = np.where(points[found] == codes, start[id(pattern)] + found, 0)
    length = np.array([p.length for p, _ in pairs])
    top = np.left_shift(np.uint64(1), ((length - 1) % 64).astype(np.uint64))
    one, last = np.uint64(1), np.uint64(63)
    up, down = np.full((words, len(pairs)), ~np.uint64(0)), np.zeros((words, len(pairs)), np.uint64)
    score = length.astype(np.int64)
    best = score.copy()
    for j in range(width):
        eq = masks[rows[j]].T
        part = eq & up
        total = part + up
        if words > 1:
            carry = total[0] < up[0]
            for w in range(1, words):
                over = total[w] < up[w]
                total[w] += carry
                carry = over | (carry & (total[w] == 0))
        x = (total ^ up) | eq
        rise, fall = down | ~(x | up), up & x
        score += (rise[-1] & top) != 0
        score -= (fall[-1] & top) != 0
        np.minimum(best, score, out=best)
        x = eq | down
        over_rise, over_fall = rise[:-1] >> last, fall[:-1] >> last
        rise, fall = rise << one, fall << one
        rise[1:] |= over_rise
        fall[1:] |= over_fall
        up, down = fall | ~(x | rise), rise & x
    return best


class Matcher:
    """The automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = []
        found: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normalise(text)
            if item:
                budget = int(len(item) * rate)
                for offset, piece in pieces(item, budget):
                    found.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((item_id, item, budget, Pattern(item)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of every item within its budget somewhere in the text."""
        text = normalise(text)
        if not self.items or not text:
            return []
        spans: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for k, offset in uses:
                _, item, budget, _ = self.items[k]
                start = end + 1 - size - offset
                a, b = max(0, start - budget), start + len(item) + budget
                mine = spans.setdefault(k, [])
                if mine and a <= mine[-1][1] and a >= mine[-1][0]:
                    mine[-1][1] = max(mine[-1][1], b)
                else:
                    mine.append([a, b])
        best: dict[int, int] = {}
        pairs: list[tuple[int, str]] = []
        for k, mine in spans.items():
            _, item, budget, _ = self.items[k]
            if item in text:
                best[k] = 0
            elif budget:  # without a budget only the item itself counts
                reach = len(item) + budget  # of a passage at most: cuts overlap by as much
                for a, b in mine:
                    b = min(b, len(text))
                    pairs += [(k, text[c : min(b, c + 4 * reach)]) for c in range(a, max(a + 1, b - reach), 3 * reach) if b - c >= len(item) - budget]
        if len(pairs) < MANY:
            for k, cut in pairs:
                if best.get(k) != 0:
                    best[k] = min(best.get(k, len(cut) + 1), self.items[k][3].distance(cut))
        else:
            for (k, _), d in zip(pairs, least_distances([(self.items[k][3], cut) for k, cut in pairs]).tolist()):
                best[k] = min(best.get(k, d), d)
        return sorted((self.items[k][0], d) for k, d in best.items() if d <= self.items[k][2])


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with `bm_items` (ids of the items found, ascending) and `bm_distances` (least edits).

    Letters are compared without case, white space runs as one space. Defined results: an empty
    table gives no rows; null and empty texts match nothing; items without text or id are left out;
    equal items are all reported; items shorter than 1 / rate match exactly; repeated rows are
    matched each; other columns pass through, and columns named like the two are replaced."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    blocks = 1 + common.text_bytes(items) // block_bytes
    docs = docs.drop("bm_items", "bm_distances")
    names, lists = docs.columns, (("bm_items", ArrayType(LongType())), ("bm_distances", ArrayType(IntegerType())))
    text, key = common.unused(docs, "bm_text", "bm_key")

    def sent(block: int):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        return docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

    if blocks == 1:
        held = sent(0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for batch in common.slices(batches):
                found = [matcher.matches(t) for t in batch.column(len(names)).to_pylist()]
                ids, distances = ([[pair[k] for pair in row] for row in found] for k in (0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.int32()))], names=[*names, "bm_items", "bm_distances"])

        schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in lists]])
        return docs.select("*", F.col("text").alias(text)).mapInArrow(run, schema)

    hits = None
    for block in range(blocks):  # one block's automaton in the workers at a time
        held = sent(block)

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, rate)
            for batch in common.slices(batches):
                for key, t in zip(batch.column(0), batch.column(1).to_pylist()):
                    if found := matcher.matches(t):
                        keys = pa.array([key.as_py()] * len(found), pa.string())
                        yield pa.RecordBatch.from_arrays([keys, *[pa.array([x[k] for x in found], t) for k, t in ((0, pa.int64()), (1, pa.int32()))]], names=["key", "item", "distance"])

        texts = docs.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("key"), "text")
        found = common.stage(texts.mapInArrow(find, "key string, item long, distance int").distinct(), "hits")
        hits = found if hits is None else hits.unionAll(found)
    grouped = common.stage(hits.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item", "distance"))).alias("hits")), "hits-by-text")
    joined = docs.withColumn(key, F.sha2(F.encode("text", "UTF-8"), 256)).join(grouped.select(F.col("key").alias(f"{key}_of"), F.col("hits").alias(text)), F.col(key) == F.col(f"{key}_of"), "left")
    made = [F.coalesce(F.col(text)[field], F.array().cast(kind)).alias(name) for (name, kind), field in zip(lists, ("item", "distance"))]
    return joined.select(*[F.col(f"`{n}`") for n in names], *made)
