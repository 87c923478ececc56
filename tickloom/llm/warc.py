"""WARC archives, written and read by Spark's text sources, with boundary-chain verification.

Written: one record a page; a payload that stands elsewhere becomes a revisit of it. Read: files are
split at any byte, and cut at the magic line by Spark's own reader, so a piece starts wherever the
magic stands, in a payload too. Each task turns its pieces into candidates: where a record would
start, and by its length where the next one would. Within a split the chains are followed at once:
every candidate gets the offset where its chain leaves the split. Between splits, pointers jump from
the start of each file, in as many rounds as the logarithm of a file's splits. Only what the chain
from the file's start reaches is a record; magic within payloads is not.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import common
from tickloom.llm.packed import table

MAGIC = "WARC/1.1\r\n"
#: Fixed values of the format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Longest header that is looked for.
HEADER_BYTES = 1 << 20
#: Bytes of a file in which records of several pieces meet their pieces.
CELL_BYTES = 1 << 16
_CANDIDATES = "file string, block long, at long, next long, exit long, t_in long, t_out long, bytes long, type string, page_id long, refers_to long, payload_bytes long, digest string"


def payload_digest(payload: Column) -> Column:
    """SHA-1 in upper-case base32, 32 characters, by SQL functions: 40 bits make 8 characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _BASE32)


def _uri(url: Column) -> Column:
    """A URI that no header can be broken with."""
    for found, put in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("WARC/", "WARC%2F")):
        url = F.replace(url, F.lit(found), F.lit(put))
    return url


def decided(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id long, url, html) with `payload`, `digest` and `refers_to`: of equal payloads of
    min_bytes at least, the largest page_id is the response that the others refer to. Payloads are
    equal by sha256; only the groups of several are joined, by size broadcast or shuffled."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", F.sha2(F.encode(payload, "UTF-8"), 256).alias("key"), F.octet_length(payload).alias("size"))
    groups = keyed.where(F.col("size") >= min_bytes).groupBy("key").agg(F.count("*").alias("n"), F.max("page_id").alias("largest"))
    several = common.stage(groups.where("n > 1 AND largest IS NOT NULL").select("key", "largest"), "equal-payloads")
    joined = pages.withColumn("payload", payload).withColumn("key", F.sha2(F.encode("payload", "UTF-8"), 256)).join(several, "key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))
    return joined.select("page_id", "url", "payload", payload_digest(F.encode("payload", "UTF-8")).alias("digest"), refers.alias("refers_to"))


def record(date: str) -> Column:
    """The record of a row of `decided`, but for the last line end, which the text sink adds."""
    end, name = F.lit("\r\n"), F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))
    size = F.octet_length("payload").cast("string")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length("payload"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(_uri(F.col("url")), F.lit("about:blank"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: <urn:x-page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    ]
    return F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *lines), end, end, http, F.when(revisit, "").otherwise(F.col("payload")), end)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """Write pages (page_id, url, html) as WARC files, one a partition; other columns are ignored.

    Defined results: a null html is an empty payload; a null url is about:blank; a null page_id
    gives a record without a number, smaller than all others; rows that share the largest page_id
    of a payload are all responses; an empty table gives no record."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    decided(known, min_bytes).select(record(date).alias("value")).write.option("lineSep", "\r\n").text(path)


def parse(piece: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """(bytes of the header with its empty line, bytes of the block, fields by lower-case name) of what
    follows a magic line; None if no record can start there."""
    end = piece.find(b"\r\n\r\n", 0, HEADER_BYTES)
    if end < 0:
        return None
    fields = dict.fromkeys(())
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit() or len(size) > 15 or b"warc-type" not in fields:
        return None
    return end + 4, int(size), fields


def _page(name: bytes) -> int | None:
    found = re.fullmatch(rb"<urn:x-page:(-?\d+)>", name)
    return int(found[1]) if found else None


def described(head: tuple[int, int, dict[bytes, bytes]], block: bytes | None) -> tuple[str, int | None, int | None, int | None, str | None]:
    """(type, page_id, refers_to, payload bytes, payload digest) of a record; the last two are None
    for a response whose block is not at hand."""
    fields = head[2]
    kind = fields[b"warc-type"].decode("latin-1")
    page, refers = _page(fields.get(b"warc-record-id", b"")), _page(fields.get(b"warc-refers-to", b""))
    if block is None:
        return kind, page, refers, None, None
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    if kind == "revisit":
        size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return kind, page, refers, int(size[1]) if size else None, fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
    return kind, page, refers, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _pieces(spark: SparkSession, path: str, magic: str) -> DataFrame:
    """(file, block, piece): what stands between magic lines, in order within each split."""
    lines = spark.read.option("lineSep", magic).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _in_place(batches: Iterator[pa.RecordBatch], gap: int) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, offset from the split's first piece, piece)."""
    now, at = None, 0
    for batch in common.slices(batches, 256):
        for file, block, piece in zip(*[batch.column(k).to_pylist() for k in range(3)]):
            if (file, block) != now:
                now, at = (file, block), 0
            yield file, block, at, piece
            at += len(piece) + gap


def _chains(found: list[tuple[int, int]], end: int) -> list[tuple[int | None, int, int]]:
    """(exit, t_in, t_out) of a split's candidates (at, next), in order; end: where the split ends.
    The exit is the offset at or behind the end to which the chain leads, None if it breaks before.
    One candidate leads to another if t_in of the first lies within t_in and t_out of the other."""
    place = {at: k for k, (at, _) in enumerate(found)}
    after = [place.get(nxt) for _, nxt in found]
    weight = [1] * len(found)
    for k, up in enumerate(after):  # a successor lies behind
        if up is not None:
            weight[up] += weight[k]
    exits, first, free, spent = [None] * len(found), [0] * len(found), [0] * len(found), 0
    for k in range(len(found) - 1, -1, -1):
        up = after[k]
        if up is None:
            exits[k], first[k] = (found[k][1] if found[k][1] >= end else None), spent
            spent += weight[k]
        else:
            exits[k], first[k] = exits[up], free[up]
            free[up] += weight[k]
        free[k] = first[k] + 1
    return [(exits[k], first[k], first[k] + weight[k] - 1) for k in range(len(found))]


def candidates(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """A row for each place where a record could start, offsets counted from the split's first piece,
    and one without `at` for the bytes of each split."""
    gap = len(magic)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        now, end = None, 0

        def split() -> Iterator[pa.RecordBatch]:
            chains = _chains([(r[0], r[1]) for r in rows], end)
            made = [(*now, at, nxt, *chain, None, *told) for (at, nxt, told), chain in zip(rows, chains)]
            yield from table([*made, (*now, *[None] * 5, end + gap, *[None] * 5)], _CANDIDATES).to_batches()

        for file, block, at, piece in _in_place(batches, gap):
            if (file, block) != now:
                if now:
                    yield from split()
                rows, now = [], (file, block)
            end = at + len(piece)
            if (at or block) and (head := parse(piece)):
                body, size, _ = head
                whole = body + size + 4 <= len(piece)
                if not whole or piece[body + size : body + size + 4] == b"\r\n\r\n":
                    rows.append((at - gap, at + body + size + 4, described(head, piece[body : body + size] if whole else None)))
        if now:
            yield from split()

    return _pieces(spark, path, magic).mapInArrow(run, _CANDIDATES)


def _reached(nodes: DataFrame) -> DataFrame:
    """nodes: (file, at, to). The (file, at) that pointers reach from offset 0 of each file."""
    reached = common.stage(nodes.where("at = 0").select("file", "at"), "reached")
    jumps = common.stage(nodes.where("to IS NOT NULL"), "jumps")
    while not jumps.isEmpty():
        on = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        further = common.stage(reached.unionAll(on).distinct(), "reached")
        ahead = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        twice = common.stage(jumps.join(ahead, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "jumps")
        common.unstage(reached, jumps)
        reached, jumps = further, twice
    return reached


def read_archives(spark: SparkSession, path: str, magic: str = MAGIC) -> DataFrame:
    """(file, at, type, page_id, refers_to, payload_bytes, digest) of every record of a folder of
    WARC files, uncompressed, of one version. Payloads are measured and hashed as they stand in the
    archive; those of revisits by their headers. Raises ValueError where a file's chain does not end
    with the file: then a header is broken, cut by the magic line, or the file is no archive."""
    gap = len(magic)
    found = common.stage(candidates(spark, path, magic), "candidates")
    by_file = Window.partitionBy("file").orderBy("block")
    sizes = found.where("at IS NULL").select("file", "block", "bytes")
    bases = common.stage(sizes.select("file", "block", F.coalesce(F.sum("bytes").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("bytes").over(Window.partitionBy("file")).alias("total")), "bases")
    placed = found.where("at IS NOT NULL").join(bases, ["file", "block"])
    placed = placed.withColumns({c: F.col(c) + F.col("base") for c in ("at", "next", "exit")})
    exits = common.stage(placed.where("exit IS NOT NULL").select("file", F.col("exit").alias("at")).unionAll(bases.select("file", F.lit(0).cast("long"))).distinct(), "exits")
    entries = common.stage(placed.join(exits, ["file", "at"], "left_semi").select("file", "block", "at", "exit", "t_in"), "entries")
    known = entries.select("file", F.col("at").alias("exit"), F.col("at").alias("to"))
    reached = _reached(entries.join(known, ["file", "exit"], "left").select("file", "at", "to"))
    entered = common.stage(entries.join(reached, ["file", "at"], "left_semi").select("file", "block", F.col("t_in").alias("entry")), "entered")
    records = placed.join(entered, ["file", "block"]).where("entry BETWEEN t_in AND t_out")
    ends = records.groupBy("file").agg(F.max("next").alias("next"))
    broken = bases.where(F.col("total") > gap).select("file", "total").distinct().join(ends, "file", "left").where(F.coalesce("next", F.lit(-1)) != F.col("total") - gap)
    if bad := broken.select("file").take(1):
        raise ValueError(f"the chain of records does not lead to the end of {bad[0]['file']}")
    named = records.select("file", "at", "next", "type", "page_id", "refers_to", "payload_bytes", "digest")
    cut = common.stage(named.where("digest IS NULL").select("file", "at", "next"), "cut-records")
    if cut.isEmpty():
        return named.drop("next")
    joined = _assembled(spark, path, magic, bases, cut)
    mended = named.where("digest IS NULL").drop("payload_bytes", "digest").join(joined, ["file", "at"])
    return named.where("digest IS NOT NULL").unionByName(mended).drop("next")


def _assembled(spark: SparkSession, path: str, magic: str, bases: DataFrame, cut: DataFrame) -> DataFrame:
    """(file, at, payload_bytes, digest) of records whose block holds the magic line: their pieces are
    read again and meet their record by cells of the file; one group is one record."""
    gap = len(magic)
    between = magic.encode()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, at, piece in _in_place(batches, gap):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((file, pa.string()), (block, pa.int64()), (at, pa.int64()), (piece, pa.binary()))], names=["file", "block", "place", "piece"])

    def whole(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        text = between.join(rows.sort_values("place")["piece"].tolist())
        body, size, _ = head = parse(text)
        told = described(head, text[body : body + size])
        return pd.DataFrame({"file": [key[0]], "at": [key[1]], "payload_bytes": [told[3]], "digest": [told[4]]})

    pieces = _pieces(spark, path, magic).mapInArrow(place, "file string, block long, place long, piece binary")
    pieces = pieces.join(bases.select("file", "block", "base"), ["file", "block"]).withColumn("place", F.col("place") + F.col("base"))
    cells = cut.select("file", "at", "next", F.explode(F.sequence(F.floor(F.col("at") / CELL_BYTES), F.floor(F.col("next") / CELL_BYTES))).alias("cell"))
    met = pieces.withColumn("cell", F.floor(F.col("place") / CELL_BYTES)).join(cells, ["file", "cell"]).where("place > at AND place < next")
    return met.select("file", "at", "place", "piece").groupBy("file", "at").applyInPandas(whole, "file string, at long, payload_bytes long, digest string")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read them back: (page_id, payload_bytes,
    payload_digest, record_type, refers_to), as write_archives and read_archives define them."""
    spark = pages.sparkSession
    path = f"{common.shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, min_bytes)
    read = read_archives(spark, path)
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


#: DuckDB SQL for op13; base32 by eight digits of 40 bits each.
ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload) AS largest FROM p
)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('{_BASE32}', 1 + (('0x' || substr(digest, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) % 32, 1)), '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
FROM g
"""
