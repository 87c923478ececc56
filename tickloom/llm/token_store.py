"""Token-id shards: each document's ids compressed by itself with one shared zstandard dictionary.

File format of a shard (all numbers little-endian):

    magic b"TLID" | version u8 (2) | id width u8 (2 or 4) | dictionary sha256 (32 bytes) | n u32
    doc_id i64 x n | known ids, a bit each, (n + 7) // 8 bytes, highest bit first | tokens u32 x n
    frame offset u64 x (n + 1), from the first frame | frames

A frame is one document's ids as unsigned little-endian integers, compressed with the dictionary
of that hash. The offset index gives any short document by one small read and one decompression.
A store is a folder of two Parquet tables (Spark writes and reads them on any store): `shards`, a
row a shard with the least and the greatest doc_id in it, so that a look-up skips the others, and
`dictionary`, one row with the dictionary and its hash.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import common, tokens
from tickloom.llm.packed import table

MAGIC = b"TLID"
_HEAD = struct.Struct("<4sBB32sI")
SHARD_SCHEMA = "part int, seq int, part_start long, first_id long, last_id long, n_docs int, n_tokens long, shard binary"
DICTIONARY_SCHEMA = "sha256 string, dictionary binary"
ROW_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: A shard is closed when its ids reach this many bytes.
SHARD_BYTES = 4 << 20
#: Bound of the dictionary's training sample: documents, and characters of each.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 2000, 16_384, 65_536


def train_dictionary(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the serialized ids of a bounded sample: about sample_docs documents chosen
    by a hash of their id (twice as many at most), sample_chars characters of each. Empty when
    there is nothing to learn from."""
    total = max(1, docs.count())
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    rows = (
        docs.where(lot < int((1 << 40) * min(1.0, sample_docs / total)))
        .select(F.substring("text", 1, sample_chars).alias("text"))
        .where(F.length("text") > 0)
        .limit(2 * sample_docs)
        .collect()
    )
    enc = tokens.encoder(vocabulary)
    samples = [enc.encode(r["text"]) for r in rows]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few or too short samples: their content serves as it is
        return b"".join(samples)[:size]


def _dictionary(raw: bytes):
    return zstandard.ZstdCompressionDict(raw) if raw else None


def pack_shard(doc_ids: list[int | None], arrays: list[bytes], width: int, dictionary: bytes, compressor=None) -> bytes:
    compressor = compressor or zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
    frames = [compressor.compress(x) for x in arrays]
    offsets = np.zeros(len(frames) + 1, "<u8")
    np.cumsum([len(x) for x in frames], out=offsets[1:])
    return b"".join(
        [
            _HEAD.pack(MAGIC, 2, width, hashlib.sha256(dictionary).digest(), len(frames)),
            np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
            np.packbits([i is not None for i in doc_ids]).tobytes(),
            np.array([len(x) // width for x in arrays], "<u4").tobytes(),
            offsets.tobytes(),
            *frames,
        ]
    )


class ShardReader:
    """Random access to one shard's documents."""

    def __init__(self, shard: bytes, dictionary: bytes):
        magic, version, width, sha, n = _HEAD.unpack_from(shard)
        if magic != MAGIC or version != 2:
            raise ValueError("not a token-id shard")
        if sha != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(shard, "<i8", n, at)
        self.known = np.unpackbits(np.frombuffer(shard, np.uint8, (n + 7) // 8, at := at + 8 * n), count=n).astype(bool)
        self.n_tokens = np.frombuffer(shard, "<u4", n, at := at + (n + 7) // 8)
        self._offsets = np.frombuffer(shard, "<u8", n + 1, at := at + 4 * n)
        self._first = at + 8 * (n + 1)
        self._shard, self._dtype = memoryview(shard), np.dtype(f"<u{width}")
        self._decompressor = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        a, b = self._first + int(self._offsets[k]), self._first + int(self._offsets[k + 1])
        raw = self._decompressor.decompress(self._shard[a:b], max_output_size=int(self.n_tokens[k]) * self._dtype.itemsize)
        return np.frombuffer(raw, self._dtype)

    def find(self, doc_id: int) -> np.ndarray | None:
        """Ids of the first document of that id; null ids come first, the others ascend."""
        nulls = int((~self.known).sum())
        k = nulls + int(np.searchsorted(self.doc_ids[nulls:], doc_id))
        return self.ids(k) if k < len(self) and self.doc_ids[k] == doc_id else None


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, dictionary: bytes, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Shards of all documents in ascending doc_id order (ties by a hash of the text; null ids come
    first; a null text is empty)."""
    n = common.partitions_for(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    ordered = keyed.repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = tokens.encoder(vocabulary)
        width, end = enc.dtype.itemsize, np.array([end_id], enc.dtype).tobytes()
        compressor = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        ids: list[int | None] = []
        arrays: list[bytes] = []
        seq = start = held = 0

        def close() -> pa.RecordBatch:
            nonlocal ids, arrays, seq, start, held
            shard = pack_shard(ids, arrays, width, dictionary, compressor)
            some = [i for i in ids if i is not None]
            row = (part, seq, start, some[0] if some else None, some[-1] if some else None, len(ids), held // width, shard)
            seq, start, held, ids, arrays = seq + 1, start + held // width, 0, [], []
            return table([row], SHARD_SCHEMA).to_batches()[0]

        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(doc_id)
                arrays.append(enc.encode(text) + end)
                held += len(arrays[-1])
                if held >= shard_bytes:
                    yield close()
        if ids:
            yield close()

    return ordered.mapInArrow(build, SHARD_SCHEMA)


def write_store(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """Train the dictionary and write a store of all documents."""
    dictionary = train_dictionary(docs, vocabulary)
    row = [(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))]
    docs.sparkSession.createDataFrame(row, DICTIONARY_SCHEMA).coalesce(1).write.parquet(f"{path}/dictionary")
    write_shards(docs, vocabulary, end_id, dictionary).write.parquet(f"{path}/shards")


def open_store(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """(shards, dictionary) of a store written by any session."""
    row = spark.read.schema(DICTIONARY_SCHEMA).parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if hashlib.sha256(dictionary).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not have its hash")
    return spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards"), dictionary


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids array<long>) of some documents (the first of each id). Only shards whose range
    of ids holds one of them are read, and of these only the documents' own frames."""
    shards, dictionary = open_store(spark, path)
    wanted = sorted(set(doc_ids))
    near = F.lit(False)
    for i in wanted:
        near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            reader = ShardReader(batch.column("shard")[0].as_py(), dictionary)
            got = [(i, ids.tolist()) for i in wanted if (ids := reader.find(i)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([x for _, x in got], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.where(near).select("shard").mapInArrow(find, "doc_id long, ids array<long>").dropDuplicates(["doc_id"])


def read_shards(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """One row per document, decoded from the stored shards: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 (of its ids as unsigned 32-bit little-endian integers)."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row per write task
    base, before = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        base[r["part"]], before = before, before + r["n"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            part, at = batch.column("part")[0].as_py(), batch.column("part_start")[0].as_py()
            reader = ShardReader(batch.column("shard")[0].as_py(), dictionary)
            sizes = reader.n_tokens.astype("<i8")
            crcs = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(len(reader))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(reader.doc_ids, mask=~reader.known), pa.array(base[part] + at + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return shards.mapInArrow(decode, ROW_SCHEMA)


def token_store(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write a store in the shared folder, and read it back.

    Defined results: empty table: no rows. Null text: the end id alone. Null doc_id: null, before
    all others. Repeated ids: each row has its own entry, ordered by a hash of the text. Other
    columns are ignored."""
    spark = docs.sparkSession
    path = f"{common.shared_folder(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(docs, vocabulary, end_id, path)
    return read_shards(*open_store(spark, path))
