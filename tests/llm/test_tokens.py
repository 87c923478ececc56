import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import common, packing, token_store, tokens

VOCABULARY = tokens.default_vocabulary()
TEXT = st.text(alphabet=st.one_of(st.sampled_from(list("abc XYZ.,'s1 \n\t  　é|<>")), st.characters(codec="utf-8")), max_size=60)
ODD = ["", " ", "  ", "a  b", "a \n b", "x\n y", " lead", "trail ", "it's  we'll, 12 ab3 c_d", "<|endoftext|> a <|endoftext|>", "a  <|endoftext|>b", "é à, ñ. ü!", "　 a", "a　 b", "a" * 5000 + " " + "b " * 50]


def direct(text):
    return tokens.encoder(VOCABULARY).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_have_the_library_ids(text):
    assert tokens.encoder(VOCABULARY).ids(text).tolist() == direct(text)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_ids_equal_the_library(text):
    assert tokens.encoder(VOCABULARY).ids(text).tolist() == direct(text)


def test_corpus_ids_equal_the_library(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert tokens.encoder(VOCABULARY).ids(r["text"]).tolist() == direct(r["text"])


ROWS = [(5, "b c"), (-1, "minus"), (1, None), (3, ""), (2, "word " * 3000), (3, "again"), (9, "same text"), (8, "same text"), (None, "no id"), (7, "x  y\n\nz ")]


def frame(spark, rows):
    return spark.createDataFrame([(a, b, "en", i) for i, (a, b) in enumerate(rows)], "doc_id long, text string, start string, n_tokens int")


def test_store_round_trip(spark):
    got = token_store.token_store(frame(spark, ROWS), VOCABULARY, 2).collect()
    ids = [(a, [*direct(b), 2]) for a, b in ROWS]
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(((a, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, x in ids), key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [None, *sorted(a for a, _ in ids if a is not None)]


def test_store_of_nothing(spark):
    assert token_store.token_store(frame(spark, []), VOCABULARY, 2).count() == 0


def test_store_opens_in_a_new_session(spark, tmp_path):
    rows = [(i * 3, f"text {i} " * (i % 50)) for i in range(400)] + [(None, "no id")]
    path = f"file://{tmp_path}/store"
    token_store.write_store(frame(spark, rows), VOCABULARY, 2, path)
    other = spark.newSession()
    shards, dictionary = token_store.open_store(other, path)
    assert token_store.read_shards(shards, dictionary).count() == 401
    got = {r["doc_id"]: r["ids"] for r in token_store.look_up(other, path, [3, 600, 601, 1197]).collect()}
    assert got == {i: [*direct(dict(rows)[i]), 2] for i in (3, 600, 1197)}
    assert shards.count() > 1 and shards.where("first_id <= 3 AND last_id >= 3").count() == 1


def test_short_document_access():
    arrays = [np.arange(k, dtype="<u2").tobytes() for k in (0, 3, 9)]
    dictionary = b"some raw dictionary content"
    reader = token_store.ShardReader(token_store.pack_shard([None, 4, 6], arrays, 2, dictionary), dictionary)
    assert reader.find(4).tolist() == [0, 1, 2] and reader.find(5) is None and reader.find(0) is None and reader.ids(0).tolist() == []
    with pytest.raises(ValueError):
        token_store.ShardReader(token_store.pack_shard([1], arrays[:1], 2, dictionary), b"another")


def check_packing(rows, ids_of, size):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, found in pieces.items():
        at, ids = 0, ids_of[doc_id]
        for start, length, crc, n in sorted(found):
            assert start == at and length > 0 and n == len(ids)
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert set(pieces) == set(ids_of)
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_covers_each_id_once(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    got = packing.pack_documents(frame(spark, rows), VOCABULARY, 0, 64).collect()
    assert check_packing(got, {a: [*direct(b), 0] for a, b in rows}, 64) == 0


def test_packing_of_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = packing.pack_documents(docs, VOCABULARY).collect()
    assert check_packing(got, {r["doc_id"]: [*direct(r["text"]), 0] for r in docs.collect()}, 1024) == 0


def test_packing_of_nothing_and_of_null_ids(spark):
    assert packing.pack_documents(frame(spark, []), VOCABULARY).count() == 0
    assert packing.pack_documents(frame(spark, [(None, "a"), (None, "b"), (1, "a"), (1, "a")]), VOCABULARY).count() >= 4


def test_hilbert_key_walks_to_neighbours():
    bits = 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_partitions_grow_with_the_text(spark):
    docs = frame(spark, [(i, "x" * 1000) for i in range(20)])
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert common.partitions_for(docs) == few and common.partitions_for(docs, task_bytes=1000) == 21
