"""Removal of passages of 50 words that an earlier document already has.

Method: a count-min sketch prefilter, then exact grouping.

1. Every task sketches its documents. A window is represented by its anchor,
   the leftmost least-hashed gram of ten words inside it; equal windows have
   equal anchors at equal places, so the number of documents that hold a
   window never exceeds the number that hold its anchor, and the count-min
   estimate of the anchor overestimates the window's count. Anchors are about
   a twentieth of the windows, which is what makes the sketch small.
2. The partial sketches are merged slice by slice; two rows of counters remain
   as one bit a cell, "two documents or more".
3. A second pass emits the windows whose estimate in both rows is two or
   more, once for each document, under the 128-bit BLAKE2b digest of their
   words. They are grouped: a window goes from every document but the smallest
   ``doc_id``. No repeated window is lost, a wrong estimate only costs a
   shuffled row, and no two different windows with one digest are known.

The sketch has four cells for each expected anchor up to ``max_sketch_bits``
(by default 2**29 cells, 64 MB, in each of two rows). Past that bound the
estimates grow looser and more windows are grouped; the result is the same.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkernel import NON_SPACE, U64, Words, chunks, gram_starts, grams, mix, sliding_argmin, split

GRAM = 10
#: The greatest id; a row without an id comes after it.
LAST = (1 << 63) - 1
#: Cells of the filter of ids that several rows have (8 MB of bits).
IDS = 1 << 26


def _cells(values: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(values + U64(row + 1)) & U64(width - 1)).astype(np.int64)


def _anchored(words, size: int, seed: int = 0):
    """(starts of windows, anchor of each as a word index, gram hashes)."""
    gram = min(GRAM, size)
    starts = gram_starts(words.first, size)
    keys = grams(words.hashes[seed], gram, 1)
    at = sliding_argmin(keys, size - gram + 1)[starts] if len(starts) else starts
    return starts, at, keys


def _flagged(words, size: int, width: int, bits: np.ndarray):
    """Starts of the windows that the sketch takes for repeated."""
    starts, at, keys = _anchored(words, size)
    if not len(starts):
        return starts
    used = np.unique(at)
    hot = np.ones(len(used), bool)
    for row in range(2):
        hot &= scratch.bit(bits[row], _cells(keys[used], row, width))
    mark = np.zeros(len(keys), bool)
    mark[used[hot]] = True
    return starts[mark[at]]


def _digests(words: Words, size: int, starts: np.ndarray) -> list[bytes]:
    """The BLAKE2b digest of each window: its words joined by one space."""
    if not len(starts):
        return []
    at = np.concatenate(([0], np.cumsum(words.ends - words.starts + 1)))
    joined = np.full(at[-1], 0x20, np.uint8)
    letters = np.ones(at[-1], bool)
    letters[at[1:] - 1] = False
    joined[letters] = words.data[NON_SPACE[words.data]]
    text, of = memoryview(joined), hashlib.blake2b
    return [of(text[a:z], digest_size=16).digest() for a, z in zip(at[starts].tolist(), (at[starts + size] - 1).tolist(), strict=True)]


def _loose(ids: pa.Array, texts: pa.Array, repeated: np.ndarray) -> pa.Array:
    """A key by the text for each row that its id does not tell from all others (null or repeated); null for the rest.

    ``repeated`` is a filter of ids; an id that it takes for repeated by mistake only gets a key it does not need.
    """
    out: list[int | None] = [None] * len(ids)
    none = ids.is_null().to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(none | scratch.bit(repeated, scratch.cell_of(ids.fill_null(0).to_numpy().view(U64), IDS))).tolist():
        out[i] = int.from_bytes(hashlib.blake2b((texts[i].as_py() or "").encode(), digest_size=8).digest(), "little", signed=True)
    return pa.array(out, pa.int64())


def sketch(docs: DataFrame, size: int, least_bits: int = 16, max_sketch_bits: int = 29) -> tuple[int, list[np.ndarray]]:
    """(cells in a row, the bits of two rows) of the merged count-min sketch over ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    expected = scratch.text_bytes(docs) * 2 // (7 * max(2, size - GRAM + 2))
    width = scratch.width_for(expected, least_bits, max_sketch_bits)

    def partial(batches):
        kept, held = [[], []], 0

        def emit():
            out = [(row * (width // scratch.SLICE) + k, n, raw) for row in range(2) if kept[row] for k, n, raw in scratch.sketch_rows(np.concatenate(kept[row]))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["slice", "n", "cells"]) if out else None

        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(0)):
                words = split(data, offsets, NON_SPACE)
                _, at, keys = _anchored(words, size)
                if not len(at):
                    continue
                used = np.unique(at)
                doc = words.doc_of()[used]
                order = np.lexsort((keys[used], doc))
                key, doc = keys[used][order], doc[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                for row in range(2):
                    kept[row].append(_cells(key[first], row, width))
                held += int(first.sum())
                if held > 1 << 21:
                    yield emit()
                    kept, held = [[], []], 0
        if held:
            yield emit()

    rows = docs.select("text").mapInArrow(partial, scratch.SKETCH_ROW)
    bits = scratch.repeated_cells(rows, 2 * width, min(scratch.partitions_of(spark), 2 * width // scratch.SLICE))
    return width, [bits[: width // 8], bits[width // 8 :]]


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 50, max_sketch_bits: int = 29, carry: tuple[str, ...] = (), as_is: bool = False) -> DataFrame:
    """Every row of ``docs`` with the words of repeated passages taken out.

    Returns ``doc_id, n_words, n_removed, kept_text``: the words left, joined
    by one space (with ``as_is`` a text that loses nothing stays unchanged, and
    a null text stays null), and the columns named in ``carry``. A word goes if
    a window of ``size`` words over it also starts in a document with a smaller
    ``doc_id``; windows are judged on the input. A null text has no words; a
    document of fewer than ``size`` words has no window and stays whole. Rows
    that share a ``doc_id`` are one document: they never remove each other's
    words. A row with a null ``doc_id`` comes after all that have one, and rows
    without an id never remove each other's words either. Other columns of
    ``docs`` are not looked at.
    """
    spark = docs.sparkSession
    src = scratch.columns(docs, doc_id=doc_id, text=text)
    names = [f"carry_{i}" for i in range(len(carry))]
    whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[F.col(c).alias(name) for c, name in zip(carry, names, strict=True)])
    extra = "".join(f", {name} {dict(docs.dtypes)[c]}" for c, name in zip(carry, names, strict=True))
    width, bits = sketch(src, size, max_sketch_bits=max_sketch_bits)
    twice = src.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    shared = spark.sparkContext.broadcast((bits, scratch.bitmap(twice, IDS)))

    def windows(batches):
        bits, repeated = shared.value
        for batch in batches:
            ids, loose = batch.column(0), _loose(batch.column(0), batch.column(1), repeated)
            for lo, _, data, offsets in chunks(batch.column(1)):
                words = split(data, offsets, NON_SPACE)
                at = _flagged(words, size, width, bits)
                if not len(at):
                    continue
                prints = np.frombuffer(b"".join(_digests(words, size, at)), np.int64).reshape(-1, 2)
                doc = words.doc_of()[at]
                order = np.lexsort((at, prints[:, 1], prints[:, 0], doc))
                prints, doc, at = prints[order], doc[order], at[order]
                first = np.ones(len(doc), bool)
                first[1:] = (prints[1:] != prints[:-1]).any(axis=1) | (doc[1:] != doc[:-1])
                rows, place = pa.array(lo + doc[first]), (at - words.first[doc])[first].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(prints[first, 0]), pa.array(prints[first, 1]), ids.take(rows), loose.take(rows), pa.array(place)], names=["a", "b", "doc", "loose", "place"])

    def candidates() -> DataFrame:
        return src.mapInArrow(windows, "a long, b long, doc long, loose long, place int")

    latest = F.max(F.coalesce("doc", F.lit(LAST))).alias("latest")
    owners = scratch.table(candidates().groupBy("a", "b").agg(F.min("doc").alias("owner"), latest).where("owner < latest").drop("latest"))
    hits = candidates().join(owners.hint("merge"), ["a", "b"]).where("doc > owner or doc is null")
    gone = hits.groupBy("doc", "loose").agg(F.collect_set("place").alias("gone"))

    def marked(batch):
        """(words of each text, whether it has a flagged window) of a batch."""
        n_words, flagged = [], []
        for lo, hi, data, offsets in chunks(batch.column(1)):
            words = split(data, offsets, NON_SPACE)
            mark = np.zeros(hi - lo, bool)
            mark[words.doc_of()[_flagged(words, size, width, shared.value[0])]] = True
            n_words.append(np.diff(words.first))
            flagged.append(mark)
        return (np.concatenate(n_words), np.concatenate(flagged)) if n_words else (np.zeros(0, np.int64), np.zeros(0, bool))

    out_names = ["doc_id", "n_words", "n_removed", "kept_text", *names]
    out_type = f"doc_id long, n_words long, n_removed long, kept_text string{extra}"

    def untouched(texts: pa.Array) -> pa.Array:
        return texts if as_is else pa.array([b" ".join(t.split()).decode() for t in _raw(texts)], pa.string())

    def clean(batches):
        for batch in batches:
            n_words, flagged = marked(batch)
            rest = batch.filter(pa.array(~flagged))
            yield pa.RecordBatch.from_arrays([rest.column(0), pa.array(n_words[~flagged]), pa.array(np.zeros(rest.num_rows, np.int64)), untouched(rest.column(1)), *rest.columns[2:]], names=out_names)

    def suspects(batches):
        for batch in batches:
            n_words, flagged = marked(batch)
            rest = batch.filter(pa.array(flagged))
            yield pa.RecordBatch.from_arrays([rest.column(0), _loose(rest.column(0), rest.column(1), shared.value[1]), pa.array(n_words[flagged]), rest.column(1), *rest.columns[2:]], names=["doc_id", "loose", "n_words", "text", *names])

    def removed(batches):
        for batch in batches:
            n_removed, texts = [], []
            for i, raw in enumerate(_raw(batch.column(2))):
                found = batch.column(3)[i].values
                if found is None:
                    n_removed.append(0)
                    texts.append(untouched(batch.column(2).slice(i, 1))[0].as_py())
                    continue
                words = split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), NON_SPACE)
                at = _recurring(words, size, found.to_numpy().astype(np.int64))
                ends = np.zeros(len(words.starts) + 1, np.int64)
                ends[at] += 1
                ends[at + size] -= 1
                keep = np.cumsum(ends)[:-1] == 0
                n_removed.append(int((~keep).sum()))
                texts.append(b" ".join(compress(raw.split(), keep)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string()), *batch.columns[4:]], names=out_names)

    plain = whole.mapInArrow(clean, out_type)
    held = whole.mapInArrow(suspects, f"doc_id long, loose long, n_words long, text string{extra}")
    same = _same(held, gone, doc_id="doc", loose="loose")
    cut = held.join(gone.hint("merge"), same, "left").select("doc_id", "n_words", "text", "gone", *names).mapInArrow(removed, out_type)
    out = plain.unionByName(cut)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", *[F.col(name).alias(c) for name, c in zip(names, carry, strict=True)])


def _recurring(words: Words, size: int, places: np.ndarray) -> np.ndarray:
    """Starts of all windows of one text that are equal to those at ``places``; their words decide."""
    keys = grams(words.hashes[0], size)
    again = np.flatnonzero(np.isin(keys, keys[places]))
    if len(again) == len(places):
        return places
    known = set(_digests(words, size, places))
    return again[[d in known for d in _digests(words, size, again)]]


def _same(a: DataFrame, b: DataFrame, **keys: str) -> Column:
    """Equality of the keys, null with null."""
    left, *rest = (a[x].eqNullSafe(b[y]) for x, y in keys.items())
    for condition in rest:
        left = left & condition
    return left


def _raw(texts: pa.Array) -> list[bytes]:
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def digests(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
