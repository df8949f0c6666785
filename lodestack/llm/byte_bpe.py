"""Byte-level BPE with the ranks of a public vocabulary file.

A text is cut by a pattern; each match is merged on its own. The merge works
on a segment tree over the byte positions of the match: a leaf holds the rank
of the pair that starts at that live position (infinite if the pair has
none), an inner node the least rank of its two children, the left one on a
tie, so the root names the leftmost pair of least rank. A merge writes the new
token at the left position, takes the right one out, and updates the leaves of
the two live neighbours on the way to the root: O(log n) each.

Short matches are merged side by side: the trees of many distinct matches are
the rows of one numpy array and every step merges one pair in each of them.
A long match has a tree of its own in plain Python lists.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

#: Matches longer than this many bytes get a tree of their own.
SHORT = 64
#: Characters of text whose matches are merged together.
GROUP = 3_000_000
#: Distinct matches whose ids a task remembers; beyond it the memory starts afresh.
REMEMBER = 500_000
NONE = np.iinfo(np.int32).max


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines ``base64 rank`` (a fixed vocabulary of public size)."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except FileNotFoundError:  # a path that only Spark's readers reach
        raw = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]
        self.pairs: dict[int, int] = {}
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.pairs = dict(zip(keys, values, strict=True))
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int32)[order]
        self.known: dict[str, tuple[str, int, bytes, bytes]] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], np.int32(NONE))

    def merge_many(self, pieces: list[bytes]) -> tuple[list[int], list[int]]:
        """The ids of short matches, end to end, and how many each has. Every piece is of 1 to ``SHORT`` bytes; all trees go in step."""
        n = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        size = 1 << max(1, int(lengths.max() - 1).bit_length())
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        place = np.arange(size, dtype=np.int16)
        live = place < lengths[:, None]
        token = np.where(live, self.single[raw], np.int32(-1))
        after = np.where(place + 1 < lengths[:, None], place + 1, -1).astype(np.int16)
        before = np.where(live, place - 1, -1).astype(np.int16)
        tree = np.full((n, 2 * size), NONE, np.int32)
        tree[:, size : 2 * size - 1] = self._rank(token[:, :-1], token[:, 1:])
        where = np.zeros((n, 2 * size), np.int16)
        where[:, size:] = place
        for at in range(size - 1, 0, -1):
            take = tree[:, 2 * at + 1] < tree[:, 2 * at]
            tree[:, at] = np.where(take, tree[:, 2 * at + 1], tree[:, 2 * at])
            where[:, at] = np.where(take, where[:, 2 * at + 1], where[:, 2 * at])

        def update(rows: np.ndarray, leaf: np.ndarray, rank: np.ndarray) -> None:
            at = leaf + size
            tree[rows, at] = rank
            while at[0] > 1:
                at = at >> 1
                a, b = tree[rows, 2 * at], tree[rows, 2 * at + 1]
                take = b < a
                tree[rows, at] = np.where(take, b, a)
                where[rows, at] = np.where(take, where[rows, 2 * at + 1], where[rows, 2 * at])

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            left = where[rows, 1].astype(np.int64)
            right = after[rows, left].astype(np.int64)
            token[rows, left] = tree[rows, 1]
            token[rows, right] = -1
            then = after[rows, right].astype(np.int64)
            after[rows, left] = then
            has = then >= 0
            before[rows[has], then[has]] = left[has]
            update(rows, right, np.full(len(rows), NONE, np.int32))
            update(rows, left, np.where(has, self._rank(token[rows, left], token[rows, np.maximum(then, 0)]), np.int32(NONE)))
            prev = before[rows, left].astype(np.int64)
            has = prev >= 0
            if has.any():
                update(rows[has], prev[has], self._rank(token[rows[has], prev[has]], token[rows[has], left[has]]))
            rows = rows[tree[rows, 1] < NONE]
        kept = token >= 0
        return token[kept].tolist(), kept.sum(axis=1).tolist()

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one match of any length."""
        n = len(piece)
        size = 1 << (n - 1).bit_length() if n > 1 else 1
        token = self.single[np.frombuffer(piece, np.uint8)].tolist()
        far, get = (NONE, 0), self.pairs.get
        tree = [far] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = (get(token[i] << 32 | token[i + 1], NONE), i)
        for at in range(size - 1, 0, -1):
            a, b = tree[2 * at], tree[2 * at + 1]
            tree[at] = b if b[0] < a[0] else a
        after, before = [*range(1, n), -1], list(range(-1, n - 1))

        def update(leaf: int, rank: int) -> None:
            at = size + leaf
            tree[at] = (rank, leaf)
            while at > 1:
                at >>= 1
                a, b = tree[2 * at], tree[2 * at + 1]
                best = b if b[0] < a[0] else a
                if tree[at] == best:
                    break
                tree[at] = best

        while n > 1 and tree[1][0] < NONE:
            rank, left = tree[1]
            right = after[left]
            then, prev = after[right], before[left]
            token[left], token[right] = rank, -1
            after[left] = then
            if then >= 0:
                before[then] = left
            update(right, NONE)
            update(left, get(rank << 32 | token[then], NONE) if then >= 0 else NONE)
            if prev >= 0:
                update(prev, get(token[prev] << 32 | rank, NONE))
        return [t for t in token if t >= 0]

    def learn(self, matches: set[str]) -> None:
        """Encode the distinct matches that are not known yet."""
        if len(self.known) + len(matches) > REMEMBER:
            self.known.clear()
        short: dict[int, list[tuple[str, bytes]]] = {}
        for m in matches:
            if m in self.known:
                continue
            raw = m.encode()
            if (rank := self.ranks.get(raw)) is not None:
                self._keep(m, [rank])
            elif len(raw) <= SHORT:
                short.setdefault((len(raw) - 1).bit_length(), []).append((m, raw))
            else:
                self._keep(m, self.merge_one(raw))
        for group in short.values():
            for lo in range(0, len(group), 4096):
                part = group[lo : lo + 4096]
                ids, counts = self.merge_many([raw for _, raw in part])
                names, parts = list(map(self.names.__getitem__, ids)), list(map(self.bytes_of.__getitem__, ids))
                raw_ids, at = np.array(ids, np.int32).tobytes(), 0
                for (m, _), n in zip(part, counts, strict=True):
                    self.known[m] = (",".join(names[at : at + n]), n, b"".join(parts[at : at + n]), raw_ids[4 * at : 4 * (at + n)])
                    at += n

    def _keep(self, match: str, ids: list[int]) -> None:
        self.known[match] = (",".join(map(self.names.__getitem__, ids)), len(ids), self.decode(ids), np.array(ids, np.int32).tobytes())

    def encode_texts(self, texts: list[str]) -> Iterator[list[tuple[str, int, bytes, bytes]]]:
        """For each whole text its matches in order: decimal ids joined by commas, their number, the bytes that the ids decode to, the ids as int32.

        Texts are taken in groups of about ``GROUP`` characters, so that the
        distinct matches of a group are merged together.
        """
        lo = 0
        while lo < len(texts):
            hi, chars, found = lo, 0, []
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= GROUP):
                found.append(self.find(texts[hi]))
                chars += len(texts[hi])
                hi += 1
            self.learn(set().union(*found))
            known = self.known
            for matches in found:
                yield [known[m] for m in matches]
            lo = hi

    def encode(self, text: str) -> list[int]:
        (parts,) = self.encode_texts([text])
        return np.frombuffer(b"".join([x[3] for x in parts]), np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(key: tuple[str, str]) -> Codec:
    return Codec(_ranks_by_key[key], key[1])


_ranks_by_key: dict[tuple[str, str], dict[bytes, int]] = {}


def _worker_codec(shared, key) -> Codec:
    if key not in _ranks_by_key:
        _ranks_by_key[key] = shared.value
    return _codec(key)


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids array<int>, decoded_sha256`` of every row's whole text; null is the empty text and has no ids.

    ``decoded_sha256`` is of the bytes that the ids decode to: it equals the
    text's own digest where the round trip is exact.
    """

    def columns(found):
        raw, counts, digests = [], [], []
        for parts in found:
            raw += [x[3] for x in parts]
            counts.append(sum([x[1] for x in parts]))
            digests.append(hashlib.sha256(b"".join([x[2] for x in parts])).hexdigest())
        ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        ids = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(raw), np.int32)))
        return [pa.array(counts, pa.int64()), ids, pa.array(digests, pa.string())]

    return _run(docs, ranks_path, pattern, doc_id, text, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", columns)


def decode(encoded: DataFrame, ranks_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, content binary``: the bytes of every row's ids (null: none); an id outside the vocabulary is an error."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast({v: k for k, v in read_ranks(spark, ranks_path).items()})

    def run(batches):
        get = shared.value.__getitem__
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(get, row or ())) for row in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "content"])

    return scratch.columns(encoded, doc_id=doc_id, ids=ids).mapInArrow(run, "doc_id long, content binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode its ids, and return digests of both.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256``: nothing but the digests
    leaves the task, so the ids of a text are never shuffled. A null text is the
    empty text, which has no ids; rows are independent, so repeated ones and
    those that share or lack a ``doc_id`` stay as they are. Other columns of
    ``docs`` are not looked at.
    """

    def columns(found):
        counts, ids, decoded = [], [], []
        for parts in found:
            counts.append(sum([x[1] for x in parts]))
            ids.append(hashlib.sha256(",".join([x[0] for x in parts]).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join([x[2] for x in parts])).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _run(docs, ranks_path, pattern, doc_id, text, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _run(docs, ranks_path, pattern, doc_id, text, schema, columns) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    key = (ranks_path, pattern)

    def run(batches):
        codec = _worker_codec(shared, key)
        codec.known.clear()
        for batch in batches:
            made = columns(codec.encode_texts([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[f"c{i}" for i in range(len(made) + 1)])
        codec.known.clear()  # the worker goes on to other work

    return scratch.columns(docs, doc_id=doc_id, text=text).mapInArrow(run, schema)


def token_counts(encoded: DataFrame) -> DataFrame:
    """``token, n`` over ``encode()``'s result."""
    return encoded.select(F.explode("ids").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
