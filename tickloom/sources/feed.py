"""Pages of a cursor feed as a data source, for batches and streams.

A feed's pages are JSON files SYMBOL_INTERVAL_FIRST_LAST.json, each a list of rows of the feed's twelve
fields; FIRST and LAST are the open times, in milliseconds, of its first and last row. What was read of
a set is known by a cursor, the open time of its last row and one millisecond more. A stream's offset
holds the cursors of all sets, from the names alone, so that a restart opens no page again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tickloom.sources.bars import FEED_FIELDS

SCHEMA = "symbol string, interval string, open_time long, " + ", ".join(f"{f} string" for f in FEED_FIELDS[1:])
_NAME = re.compile(r"([A-Z0-9]+)_([0-9]+[mhdwM])_(\d+)_(\d+)\.json")


@dataclass
class Page(InputPartition):
    """A page, and which of its open times to read: from `start`, before `end`."""

    path: str
    symbol: str
    interval: str
    start: int
    end: int


def _folder(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri) if "://" in uri else (pyarrow.fs.LocalFileSystem(), uri)


def pages(uri: str) -> list[tuple[str, str, str, int, int]]:
    """(path, symbol, interval, first, last) of a folder's pages; other names do not count."""
    files, folder = _folder(uri)
    found = files.get_file_info(pyarrow.fs.FileSelector(folder))
    parts = [(f.path, _NAME.fullmatch(f.base_name)) for f in found if f.is_file]
    return sorted((path, m[1], m[2], int(m[3]), int(m[4])) for path, m in parts if m)


def _rows(uri: str, page: Page | None) -> Iterator[tuple]:
    if page is None:  # a folder without pages
        return
    files, _ = _folder(uri)
    with files.open_input_stream(page.path) as f:
        rows = json.loads(f.read())
    for row in rows:
        if page.start <= int(row[0]) < page.end:
            yield (page.symbol, page.interval, int(row[0]), *[None if x is None else str(x) for x in row[1 : len(FEED_FIELDS)]])


class _Batch(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Page]:
        return [Page(path, s, i, first, last + 1) for path, s, i, first, last in pages(self.uri)]

    def read(self, page: Page) -> Iterator[tuple]:
        return _rows(self.uri, page)


class _Stream(DataSourceStreamReader):
    def __init__(self, uri: str):
        self.uri = uri

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        cursors: dict[str, int] = {}
        for _, s, i, _, last in pages(self.uri):
            cursors[f"{s}_{i}"] = max(cursors.get(f"{s}_{i}", 0), last + 1)
        return cursors

    def partitions(self, start: dict, end: dict) -> list[Page]:
        out = []
        for path, s, i, first, last in pages(self.uri):
            low, high = start.get(f"{s}_{i}", 0), end.get(f"{s}_{i}", 0)
            if last >= low and first < high:
                out.append(Page(path, s, i, low, high))
        return out

    def read(self, page: Page) -> Iterator[tuple]:
        return _rows(self.uri, page)

    def commit(self, end: dict) -> None:
        pass


class PageFeed(DataSource):
    """spark.dataSource.register(PageFeed); spark.read.format("pages").load(folder), or readStream. A
    set's rows that come later than newer ones of the set are not read by a stream."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])
