"""How five quality filters act together, in every order.

1. Each task tells which of the filters A to D a text fails and finds equal
   texts among its own rows; of those, only the rows of the smallest id go on.
2. These are routed by the xxhash of their text. Under each fingerprint stands
   a chain of whole texts with their smallest id, so texts that collide are told
   apart. Every id that is not the smallest is emitted: it fails filter E.
3. Rows (id, part, failed filters) join the labels, and ``combineByKey`` merges
   them into one vector of counts a part: a document count, a good and a toxic
   one for each of the 32 sets of failed filters.
4. All 120 orders follow from the vector alone.

A text that a third of all rows share is sent once for each ``HELD`` bytes of a task, and a
part's vector has a fixed size. The chains of a partition are bounded by
giving the shuffle a partition for every ``ROUTED`` bytes of text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

FILTERS = "ABCDE"
A, B, C, D, E = (1 << k for k in range(5))
#: Bytes of text that a task keeps to find equal ones before it sends them on.
HELD = 32 << 20
#: Bytes of text for each partition of the shuffle.
ROUTED = 32 << 20

_SIGNS = re.compile(rb"[#$%&*|]")
_NO_CAPITALS = bytes(c for c in range(256) if not 0x41 <= c <= 0x5A)

#: (fingerprint, (text or None if settled, id, documents by part, failed filters))
Entry = tuple[int, tuple[bytes | None, int | None, dict[str, int], int]]


def failed(raw: bytes, n_chars: int) -> int:
    """The filters A to D that a text fails, as bits.

    A: under 200 words. B: fewer than half of the words distinct. C: more than 3 % of the characters are A-Z.
    D: one of ``#$%&*|``. Words are split at ASCII white space.
    """
    words = raw.split()  # of bytes: exactly \x20 and \x09-\x0D
    out = A * (len(words) < 200)
    out |= B * (100 * len(set(words)) < 50 * len(words))
    out |= C * (100 * len(raw.translate(None, _NO_CAPITALS)) > 3 * n_chars)
    return out | D * (_SIGNS.search(raw) is not None)


def settled(entries: Iterable[Entry], held_most: int | None = None) -> Iterator[Entry]:
    """``entries`` with each text once, under its smallest id; ids that are not the smallest come out without text, as failing E.

    With ``held_most`` chains are given up, and their texts sent on, at so many bytes of text.
    """
    chains: dict[int, list[list]] = {}
    held = 0
    for fp, (raw, doc_id, parts, mask) in entries:
        if raw is None:
            yield fp, (None, doc_id, parts, mask)
            continue
        chain = chains.setdefault(fp, [])
        same = next((x for x in chain if x[0] == raw), None)
        if same is None:
            chain.append([raw, doc_id, dict(parts), mask])
            held += len(raw)
            if held_most and held > held_most:
                yield from ((k, tuple(x)) for k, chain in chains.items() for x in chain)
                chains, held = {}, 0
        elif doc_id == same[1]:
            for part, n in parts.items():
                same[2][part] = same[2].get(part, 0) + n
        elif doc_id > same[1]:
            yield doc_id, (None, doc_id, parts, mask | E)
        else:
            yield same[1], (None, same[1], same[2], mask | E)
            same[1:3] = doc_id, dict(parts)
    yield from ((k, tuple(x)) for k, chain in chains.items() for x in chain)


def _read(rows: Iterable) -> Iterator[Entry]:
    for doc_id, part, text in rows:
        text = text or ""
        raw = text.encode("utf-8", "surrogatepass")
        fp = xxhash.xxh64_intdigest(raw)
        yield fp, (None if doc_id is None else raw, doc_id, {part or "": 1}, failed(raw, len(text)))


def _first(rows: Iterable) -> Iterator[Entry]:
    return settled(_read(rows), HELD)


def _last(entries: Iterable[Entry]) -> Iterator[tuple[int | None, str, int, int]]:
    return ((doc_id, part, mask, n) for _, (_, doc_id, parts, mask) in settled(entries) for part, n in parts.items())


def _route(fp: int) -> int:
    return fp


def failures(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``doc_id, part, failed, n``: the filters that documents fail as bits (A is the lowest); ``n`` equal rows are one.

    E fails where a smaller id has the same text. A null text is empty, a null ``lang``
    the part ``''``. Rows of one id are not smaller than each other. A row without an id is no smaller id and has none.
    """
    src = scratch.columns(docs, doc_id=doc_id, lang=lang, text=text)
    spark = src.sparkSession
    parts = max(scratch.partitions_of(spark), -(-scratch.text_bytes(src) // ROUTED))
    routed = src.select(F.col("doc_id").cast("long"), "lang", "text").rdd.mapPartitions(_first).partitionBy(parts, _route)
    return spark.createDataFrame(routed.mapPartitions(_last), "doc_id long, part string, failed int, n long", verifySchema=False)


def _vector(row: tuple[int, int, int, int]) -> np.ndarray:
    return _counted(np.zeros((32, 3), np.int64), row)


def _counted(vector: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
    mask, n, good, toxic = row
    vector[mask] += (n, n * good, n * toxic)
    return vector


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a += b
    return a


def vectors(found: DataFrame, labels: DataFrame) -> RDD:
    """(part, counts by failed filters: documents, good ones, toxic ones).

    A document is good if a label of it says quality 1, toxic if one says toxic 1.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("int").alias(c)
    marks = scratch.table(scratch.columns(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id is not null").groupBy("doc_id").agg(flag("quality"), flag("toxic")))
    zero = F.lit(0)
    rows = found.join(marks.hint("merge"), "doc_id", "left").select("part", "failed", "n", F.coalesce("quality", zero), F.coalesce("toxic", zero))
    return rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4]))).combineByKey(_vector, _counted, _merged, scratch.partitions_of(found.sparkSession))


def report(part: str, vector: np.ndarray) -> Iterator[tuple]:
    """A row for each order of the filters and step."""
    masks = np.arange(32)
    fails = {f: masks & (1 << k) > 0 for k, f in enumerate(FILTERS)}
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        left = np.ones(32, bool)
        for step, f in enumerate(order, 1):
            removed = vector[left & fails[f]].sum(axis=0)
            redundant = vector[~left & fails[f], 0].sum()
            left = left & ~fails[f]
            shapley[f] += int(removed[0])
            alone = vector[1 << FILTERS.index(f), 0]
            rows.append((f, "".join(order), step, vector[left, 0].sum(), removed[0], redundant, alone, removed[1], removed[2]))
    for f, order, step, *counts in rows:
        yield part, order, step, *map(int, counts), shapley[f]


AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, **names: str) -> DataFrame:
    """A row for each part, each of the 120 orders of the filters (``filter_order``) and each ``step`` (1-5) in it.

    Documents of the part: ``kept`` after the step, ``removed`` in it,
    ``redundant`` (fail its filter, removed before), ``unique_fails`` (fail
    this filter alone), ``good_lost`` and ``toxic_lost`` (removed here, with such a label),
    ``shapley`` (what the filter removes, summed over all orders). See
    ``failures`` for nulls and repeated rows. Empty ``docs`` give no rows; labels of no document play no part.
    """
    counted = vectors(failures(docs, **names), labels)
    return docs.sparkSession.createDataFrame(counted.flatMap(lambda kv: report(*kv)), AUDIT, verifySchema=False)
