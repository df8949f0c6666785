"""A table log as files of rows: Spark reads, writes and streams it under the format name ``rowlog``.

Each write appends whole rows; of the records of a key the last counts. A record
is ``key SP (column SP length SP bytes SP)* LF``, so a key or column has no
white space. A write adds files of bounded size and then one entry to ``_log``,
which names them with their least and greatest key; what is not named there does
not exist. One program writes at a time.

Reading has a task for each file, and none for files whose keys cannot meet the
filters on ``row_key``. A stream reads the entries that came since. Files are
reached through Arrow's file systems: local paths and URIs of its stores.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from lodestack.session import make_importable

#: What a log holds; ``seq`` ascends with the writes, and within a file with its rows.
SCHEMA = "row_key string, cols map<string, binary>, seq long"
#: Bytes after which a task begins another file.
ROLL = 64 << 20
_BITS = 40


def register(spark: SparkSession) -> None:
    """Make the format known, and let filters reach it."""
    make_importable(spark)
    spark.dataSource.register(RowLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def encode(key: str, cols: dict[str, bytes]) -> bytes:
    """One record. Null cells are absent."""
    names = [key, *cols]
    if any(not n or n.split() != [n] for n in names):
        raise ValueError(f"a key or column is empty or has white space: {names!r}")
    cells = b"".join(b"%b %d %b " % (c.encode(), len(v), v) for c, v in cols.items() if v is not None)
    return key.encode() + b" " + cells + b"\n"


def decode(raw: bytes) -> Iterator[tuple[str, dict[str, bytes]]]:
    """(key, columns) of the records of a file; a last record that is cut short is dropped."""
    at, size = 0, len(raw)
    while at < size:
        end = raw.find(b" ", at)
        if end < 0:
            return
        key, cols, at = raw[at:end].decode(), {}, end + 1
        while at < size and raw[at] != 10:
            name_end = raw.find(b" ", at)
            length_end = raw.find(b" ", name_end + 1)
            if name_end < 0 or length_end < 0:
                return
            stop = length_end + 1 + int(raw[name_end + 1 : length_end])
            if stop >= size:
                return
            cols[raw[at:name_end].decode()] = raw[length_end + 1 : stop]
            at = stop + 1
        if at >= size:
            return
        yield key, cols
        at += 1


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _entries(path: str) -> list[list[dict]]:
    """The files of each write, in order."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/_log", allow_not_found=True))
    names = sorted(f.path for f in found if f.base_name.endswith(".json"))
    return [json.loads(store.open_input_stream(n).read()) for n in names]


@dataclass
class _Files(WriterCommitMessage):
    files: list[dict]


@dataclass
class _File(InputPartition):
    name: str
    seq: int


def _read(path: str, part: _File | None) -> Iterator[tuple]:
    if part is None:  # so Spark asks where there are no files to read
        return
    store, root = _store(path)
    with store.open_input_stream(f"{root}/{part.name}") as f:
        for n, (key, cols) in enumerate(decode(f.read())):
            yield key, cols, part.seq + n


def _parts(entries: list[list[dict]], first: int = 0) -> list[tuple[dict, _File]]:
    """Each file with its place: writes come one after another, and the files of one in their order."""
    return [(f, _File(f["file"], (k << _BITS) + f["start"])) for k, files in enumerate(entries) if k >= first for f in files]


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.low, self.high = path, [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("row_key",) and isinstance(f.value, str) if hasattr(f, "value") else False:
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.low.append(f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.high.append(f.value)
            yield f  # files are left out, rows are still Spark's to filter

    def partitions(self) -> list[InputPartition]:
        low, high = max(self.low, default=None), min(self.high, default=None)
        return [p for f, p in _parts(_entries(self.path)) if (low is None or f["high"] >= low) and (high is None or f["low"] <= high)]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"writes": 0}

    def latestOffset(self) -> dict:
        return {"writes": len(_entries(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [p for _, p in _parts(_entries(self.path)[: end["writes"]], start["writes"])]

    def read(self, partition: _File) -> Iterator[tuple]:
        return _read(self.path, partition)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("a row log is only appended to")
        self.path = path

    def write(self, iterator: Iterator) -> _Files:
        store, root = _store(self.path)
        store.create_dir(root)
        made, out, size = [], None, 0
        for row in iterator:
            raw = encode(row.row_key, row.cols or {})
            if out is None or size > ROLL:
                if out is not None:
                    out.close()
                made.append({"file": f"{uuid.uuid4().hex}.rows", "n": 0, "low": row.row_key, "high": row.row_key})
                out, size = store.open_output_stream(f"{root}/{made[-1]['file']}"), 0
            out.write(raw)
            size += len(raw)
            made[-1] |= {"n": made[-1]["n"] + 1, "low": min(made[-1]["low"], row.row_key), "high": max(made[-1]["high"], row.row_key)}
        if out is not None:
            out.close()
        return _Files(made)

    def commit(self, messages: list[_Files | None]) -> None:
        store, root = _store(self.path)
        files, start = [f for m in messages if m is not None for f in m.files], 0
        for f in files:
            f["start"], start = start, start + f["n"]
        if not files:
            return
        store.create_dir(f"{root}/_log")
        name = f"{root}/_log/{len(_entries(self.path)):012d}.json"
        with store.open_output_stream(f"{name}.new") as out:
            out.write(json.dumps(files).encode())
        store.move(f"{name}.new", name)

    def abort(self, messages: list[_Files | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            for f in m.files if m is not None else ():
                store.delete_file(f"{root}/{f['file']}")


class RowLog(DataSource):
    """The format ``rowlog``; ``load`` and ``save`` take the folder."""

    @classmethod
    def name(cls) -> str:
        return "rowlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)
