"""WARC records: reading, writing, and the derivatives of responses.

``derive`` turns every response record into a ``metadata`` record (fields
about the capture) and a ``conversion`` record (its plain text). Both name the
response in WARC-Refers-To, are linked to each other by WARC-Concurrent-To,
and carry the source's headers and digests on.

A record is a row ``key, headers array<struct<name,value>>, block binary``;
one that was read from a file has its ``path`` as well.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.session import make_importable

from . import html_extract, scratch

RECORD = "key long, headers array<struct<name:string,value:string>>, block binary"
_HEADERS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
CRLF = b"\r\n"

#: Headers of a response that its derivatives carry on unchanged, if present.
CARRIED = ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Payload-Digest", "WARC-Identified-Payload-Type")


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(*parts: str) -> str:
    """The same id for the same parts: a task that runs again writes the same records."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=5)}>"


def _get(headers: list[tuple[str, str]], name: str) -> str | None:
    name = name.lower()
    return next((v for k, v in headers if k.lower() == name), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    keys, headers, blocks = zip(*rows, strict=True) if rows else ((), (), ())
    named = [None if h is None else [{"name": k, "value": v} for k, v in h] for h in headers]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(named, _HEADERS), pa.array(blocks, pa.binary())], names=["key", "headers", "block"])


def responses_of(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of stored pages: status 200, ``text/html`` in UTF-8, captured at ``date``.

    A null page is an empty body, a null url an empty target. Equal rows get
    equal record ids.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for key, target, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                target, body = _line(target or ""), (page or "").encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n%b" % (len(body), body)
                payload = digest(body)
                rows.append((key, [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", str(key), target, payload)), ("WARC-Target-URI", target), ("WARC-Date", date), ("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))], block))
            yield _batch(rows)

    return scratch.columns(pages, page_id=page_id, url=url, html=html).mapInArrow(run, RECORD)


def _line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text).strip()


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status line, headers, body) of an HTTP response; a block without an empty line is all body."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *lines = head.decode("latin-1").split("\r\n")
    headers = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines) if c]
    if "chunked" in (_get(headers, "Transfer-Encoding") or "").lower():
        body = _unchunked(body)
    if "gzip" in (_get(headers, "Content-Encoding") or "").lower():
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError, zlib.error):
            pass  # stored decoded, as many crawlers do
    return first, headers, body


def _unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while (end := body.find(CRLF, at)) >= 0:
        try:
            n = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return body


def _text_of(headers: list[tuple[str, str]], body: bytes) -> str | None:
    """Plain text of a body; None if it is of no textual kind."""
    kind = (_get(headers, "Content-Type") or "text/html").lower()
    found = re.search(r"charset=[\"']?([\w.:-]+)", kind) or re.search(rb"<meta[^>]+charset=[\"']?([\w.:-]+)", body[:2048], re.I)
    name = found[1] if found else "utf-8"
    try:
        text = body.decode(name if isinstance(name, str) else name.decode(), "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    if "html" in kind:
        return html_extract.plain_text(text)
    return text if kind.startswith("text/") else None


def _derive(key, source: list[tuple[str, str]], block: bytes) -> Iterator[tuple]:
    if (_get(source, "WARC-Type") or "").lower() != "response":
        return
    status, http, body = split_http(block)
    refers = _get(source, "WARC-Record-ID") or record_id("response", digest(block))
    carried = [(k, v) for k in CARRIED if (v := _get(source, k)) is not None]
    if _get(source, "WARC-Payload-Digest") is None:
        carried.append(("WARC-Payload-Digest", digest(body)))
    ids = {k: record_id(k, refers) for k in ("metadata", "conversion")}
    text = _text_of(http, body)
    fields = [("http-status", status), *((f"http-{k.lower()}", v) for k, v in http), ("source-block-digest", _get(source, "WARC-Block-Digest") or digest(block)), ("source-length", str(len(block))), ("payload-length", str(len(body)))]
    if text is not None:
        raw = text.encode()
        fields += [("conversion-id", ids["conversion"]), ("conversion-length", str(len(raw))), ("conversion-digest", digest(raw))]
    about = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode()
    yield key, _headed("metadata", ids, refers, carried, "application/warc-fields", about, text is not None), about
    if text is not None:
        yield key, _headed("conversion", ids, refers, carried, "text/plain; charset=utf-8", raw, True), raw


def _headed(kind: str, ids: dict[str, str], refers: str, carried: list[tuple[str, str]], mime: str, block: bytes, both: bool) -> list[tuple[str, str]]:
    other = ids["conversion" if kind == "metadata" else "metadata"]
    return [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Refers-To", refers), *([("WARC-Concurrent-To", other)] if both else []), *carried, ("WARC-Block-Digest", digest(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]


def derive(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of the responses among ``records``, with their ``key`` (and ``path``, if there is one).

    Records of other types have no derivatives. A response of no textual kind
    has a metadata record only. Null headers or blocks count as empty; repeated
    records have equal derivatives, other columns are not looked at. The
    records stay in their partition.
    """
    carried = [c for c in ("path",) if c in records.columns]

    def run(batches):
        for batch in batches:
            rows, of, held = [], [], 0

            def made():
                out = _batch(rows)
                return pa.RecordBatch.from_arrays([*out.columns, *[c.take(pa.array(of, pa.int64())) for c in batch.columns[3:]]], names=[*out.schema.names, *carried])  # noqa: B023

            for i in range(batch.num_rows):
                headers = [(h["name"], h["value"]) for h in batch.column(1)[i].as_py() or ()]
                for row in _derive(batch.column(0)[i].as_py(), headers, batch.column(2)[i].as_py() or b""):
                    rows.append(row)
                    of.append(i)
                    held += len(row[2])
                if held > FLUSH:
                    yield made()
                    rows, of, held = [], [], 0
            yield made()

    make_importable(records.sparkSession)
    return records.select("key", "headers", "block", *carried).mapInArrow(run, RECORD + "".join(f", {c} string" for c in carried))


def header(name: str) -> F.Column:
    """The value of a record's header, or null."""
    return F.try_element_at(F.filter("headers", lambda h: F.lower(h["name"]) == name.lower()), F.lit(1))["value"]


def serialized(records: DataFrame) -> DataFrame:
    """``value``: each record as bytes, without the two line ends that follow it."""
    lines = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\r\n")
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), lines, F.lit("\r\n\r\n"), F.coalesce(F.col("block"), F.lit(b"")).cast("string")).alias("value"))


#: Bytes of blocks that are handed on at once.
FLUSH = 1 << 22
#: A gzip member without content. Spark's text writer wants something between its rows, and this is nothing to a reader.
NOTHING = gzip.compress(b"", mtime=0)


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One WARC file for each partition (``.warc.gz`` with a gzip member for each record, or plain ``.warc``).

    Spark's text writer puts the bytes down as they are; the files get their
    names when all of them are written.
    """
    raw, spark = serialized(records), records.sparkSession
    if compression == "none":
        raw.write.option("lineSep", "\r\n\r\n").text(path)
    else:

        def members(batches):
            for batch in batches:
                for value in batch.column(0):
                    yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(value.as_py() + CRLF + CRLF, 6, mtime=0)], pa.binary())], names=["value"])

        packed = raw.select(F.col("value").cast("binary")).mapInArrow(members, "value binary").select(F.col("value").cast("string"))
        packed.write.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.listStatus(folder):  # a name for each partition
        name = found.getPath().getName()
        if name.endswith(".txt"):
            files.rename(found.getPath(), hadoop.Path(folder, name[:-4] + (".warc" if compression == "none" else ".warc.gz")))


_MARK = b"WARC/"
_HEAD = re.compile(rb"\d+\.\d+\r?\n[!-9;-~]+:")


class Assembler:
    """Records out of the pieces of a file between its ``WARC/`` marks, one piece at a time.

    A record goes on over marks in its headers or block until it has the length
    that it names. What belongs to no record is dropped, and so is a record
    without a valid length.
    """

    def __init__(self) -> None:
        self.open: bytearray | None = None
        self.need = 0

    def feed(self, piece: bytes) -> tuple[list[tuple[str, str]], bytes] | None:
        """The record that the piece completes, if any."""
        if self.open is None:
            if not _HEAD.match(piece):
                return None
            self.open, self.need = bytearray(piece), 0
        else:
            self.open += _MARK + piece
        if not self.need:
            end = self.open.find(b"\r\n\r\n")
            if end < 0:
                return None
            lines = bytes(self.open[:end]).decode("utf-8", "replace").split("\r\n")[1:]
            self.headers = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines) if c]
            try:
                self.start = end + 4
                self.need = self.start + max(0, int(_get(self.headers, "Content-Length") or 0))
            except ValueError:
                self.open = None
                return None
        if len(self.open) < self.need:
            return None
        block, self.open = bytes(memoryview(self.open)[self.start : self.need]), None
        return self.headers, block


def parse(raw: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """(headers, block) of the records of an uncompressed file; a record that is cut short is dropped."""
    made = Assembler()
    for piece in raw.split(_MARK):
        if (record := made.feed(piece)) is not None:
            yield record


def read(spark: SparkSession, path: str, skip_broken: bool = False) -> DataFrame:
    """Records of the WARC files below ``path``: ``key, headers, block, path``; ``key`` ascends with the place in the file.

    Files are streamed by Spark's text reader, cut at the marks of records, so
    a task holds some records and never a file. Files that end in ``.gz`` are
    inflated as they are read; all others are plain and split by size (a record
    over the border of two splits is put together from its parts). With
    ``skip_broken`` a file that cannot be read to its end gives what precedes
    the damage; otherwise it is an error.
    """
    make_importable(spark)

    def pieces(names: str) -> DataFrame:
        found = spark.read.option("lineSep", _MARK.decode()).option("recursiveFileLookup", "true").option("pathGlobFilter", names).option("ignoreCorruptFiles", str(skip_broken)).text(path)
        return found.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary"))

    def run(batches):
        """Records, and with null headers the parts of those that begin or end in another split."""
        at, made, n, lead = None, Assembler(), 0, False
        rows, paths, begins, held = [], [], [], 0

        def flush():
            nonlocal rows, paths, begins, held
            out = _batch(rows)
            more = [pa.array(paths, pa.string()), pa.array(begins, pa.bool_())]
            rows, paths, begins, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([*out.columns, *more], names=[*out.schema.names, "path", "begins"])

        def add(headers, block, begun=True):
            nonlocal n, held
            rows.append((at[1] + n, headers, block))
            paths.append(at[0])
            begins.append(begun)
            n += 1
            held += len(block)

        for batch in batches:
            for where, start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (where, start) != at:
                    if made.open is not None:
                        add(None, bytes(made.open))
                    at, made, n, lead = (where, start), Assembler(), 0, start > 0
                raw = piece.as_py()
                record = made.feed(raw)
                lead = lead and made.open is None and record is None
                if record is not None:
                    add(*record)
                elif lead:
                    add(None, raw, False)
                if held > FLUSH or len(rows) >= 1000:
                    yield flush()
        if made.open is not None:
            add(None, bytes(made.open))
        yield flush()

    def joined(part: pa.Table) -> pa.Table:
        """The record that begins in one split and ends in another."""
        made, rows = Assembler(), []
        part = part.sort_by("key")
        for block in part["block"].to_pylist():
            if (record := made.feed(block)) is not None:
                rows.append((part["first"][0].as_py(), *record))
                break
        out = _batch(rows)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*out.columns, pa.array([part["path"][0].as_py()] * len(rows), pa.string())], names=[*out.schema.names, "path"])])

    kind = RECORD + ", path string"
    whole, split = (pieces(names).mapInArrow(run, kind + ", begins boolean") for names in ("*.gz", "*[^z]"))
    records = [found.where("headers is not null").drop("begins") for found in (whole, split)]
    # Each border has a group of its own: what begins before it, and what follows up to the next beginning. The place of that is found without the blocks.
    parts = scratch.table(split.where("headers is null"))
    earlier = Window.partitionBy("path").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    places = parts.select("path", "key", F.last(F.when(F.col("begins"), F.col("key")), ignorenulls=True).over(earlier).alias("first")).where("first is not null")
    over = parts.join(places, ["path", "key"]).select("path", "key", "first", "block").groupBy("path", "first").applyInArrow(joined, kind)
    return records[0].unionByName(records[1]).unionByName(over)


def digests(derived: DataFrame) -> DataFrame:
    """One row for each derived record."""
    names = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "block_digest": "WARC-Block-Digest"}
    return derived.select(F.col("key").alias("page_id"), *[header(v).alias(k) for k, v in names.items()], F.length("block").cast("long").alias("content_length"), F.sha2("block", 256).alias("block_sha256"))
