"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

Rare-first prefix filtering:

1. N-grams are counted over all documents in a table whose size follows the
   input up to a bound; a global order puts n-grams of rare cells first (ties by hash).
2. Documents with equal sets form one class. Only classes are compared. They
   are numbered by least n-gram hash and length, so that near copies get
   numbers close to each other, and each run of ``BLOCK`` numbers is a block.
3. A class's prefix is its first n - ceil(t * n) + 1 n-grams in that order:
   linked classes share one. Prefix n-grams of a single class are dropped by
   a count-min sketch that never loses a shared one.
4. Classes meet on (prefix n-gram, length range). A pair is kept if it passes
   the length filter, the positional filter (what can still match behind the
   shared n-gram) and a suffix filter (the sets' histograms bound the overlap).
   The list of a frequent prefix n-gram is dealt in parts that meet two by two.
5. Kept pairs go out by pair of blocks, as a list of places or, where they are
   many, as a bitmap: a group of near copies has its square in pairs, but only
   the square of its blocks in rows. These rows are merged over all prefix
   n-grams, so each pair comes once.
6. Each pair of blocks gets the sets of those of its classes that are in a pair,
   and verifies each pair, once, by the exact overlap of the whole sets.

So what is shuffled and verified follows the pairs that pass all filters,
however the n-grams connect the documents.

N-grams are told apart by 128 bits: two hashes of their words which have no
structure in common (``textkernel``).

Components of the verified links give the smallest reachable id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .components import Forest, connected_components
from .textkernel import NON_SPACE, U64, chunks, gram_starts, grams, mix, multipliers, split

#: Cells of the frequency table as powers of two: one for every ``SPREAD`` bytes of text, within these bounds (of one byte each when broadcast).
LEAST_CELLS, MOST_CELLS, SPREAD = 20, 24, 512
#: Cells of the filter of class representatives (8 MB of bits).
CHOSEN = 1 << 26
#: Classes of one prefix n-gram and length that meet in one task; a longer list is dealt in parts.
LIST = 512
#: Cells of the table of list lengths as powers of two: one for every 64 prefix n-grams, within these bounds (of two bytes each).
LEAST_LISTS, MOST_LISTS = 16, 24
#: Classes in a block: a place in a pair of blocks has two bytes.
BLOCK = 128
#: Pairs that a task gathers before it sends them on.
HELD = 1 << 20
#: Sets larger than this have histograms of 256 bins, others of 64.
LONG = 1024


class Sets(NamedTuple):
    """The distinct n-grams of some texts: ``edges[i]:edges[i+1]`` are those of text i, by their first hash."""

    docs: np.ndarray
    keys: np.ndarray
    checks: np.ndarray
    edges: np.ndarray


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Sets:
    """The sets of n-grams of ``size`` words; a shorter text is one n-gram."""
    words = split(data, offsets, NON_SPACE, lower=True, hashes=2)
    at = gram_starts(words.first, size)
    docs = words.doc_of()[at]
    keys, checks = (grams(h, size, seed)[at] for seed, h in enumerate(words.hashes))
    n = np.diff(words.first)
    for k in range(1, size):
        few = np.flatnonzero(n == k)
        if len(few):
            short = [grams(h, k, seed)[words.first[:-1][few]] for seed, h in enumerate(words.hashes)]
            docs, keys, checks = (np.concatenate(x) for x in ((docs, few), (keys, short[0]), (checks, short[1])))
    order = np.lexsort((keys, docs))
    if _clashes(keys[order], checks[order], docs[order]):
        order = np.lexsort((checks, keys, docs))
    docs, keys, checks = docs[order], keys[order], checks[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]) | (checks[1:] != checks[:-1])
    docs = docs[new]
    return Sets(docs, keys[new], checks[new], np.searchsorted(docs, np.arange(len(offsets))))


def _clashes(keys: np.ndarray, checks: np.ndarray, docs: np.ndarray | None = None) -> bool:
    """Whether sorted n-grams agree in the first hash only: they must be sorted by both."""
    same = (keys[1:] == keys[:-1]) & (checks[1:] != checks[:-1])
    return bool(same.any() if docs is None else (same & (docs[1:] == docs[:-1])).any())


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U64), np.cumsum(values)))
    return total[edges[1:]] - total[edges[:-1]]


def _set_hashes(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, the same in any order."""
    return tuple(mix(_sums(mix(h ^ U64(salt)), sets.edges)).view(np.int64) for h, salt in ((sets.keys, 0x5851F42D4C957F2D), (sets.checks, 0x14057B7EF767814F)))


def _frequencies(docs: DataFrame, size: int) -> np.ndarray:
    """For each cell of n-grams a number from 0 to 255 that grows with its count over all documents (eight steps for each doubling)."""
    spark = docs.sparkSession
    cells = 1 << min(MOST_CELLS, max(LEAST_CELLS, (scratch.text_bytes(docs) // SPREAD).bit_length()))

    def partial(batches):
        total, held, n = np.zeros(cells, np.uint32), [], 0

        def add():
            if held:
                total[:] += np.bincount(np.concatenate(held), minlength=cells).astype(np.uint32)
                held.clear()

        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                words = split(data, offsets, NON_SPACE, lower=True)
                held.append(scratch.cell_of(grams(words.hashes[0], size)[gram_starts(words.first, size)], cells))
                n += len(held[-1])
                if n > cells:
                    add()
                    n = 0
        add()
        parts = total.reshape(-1, scratch.SLICE)
        used = [k for k in range(len(parts)) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), scratch.packed([parts[k].tobytes() for k in used])], names=["slice", "counts"])

    rows = docs.select("text").mapInArrow(partial, "slice int, counts binary")
    steps = lambda counts: np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8)
    return scratch.counted_cells(rows, cells, min(scratch.partitions_of(spark), cells // scratch.SLICE), steps, np.uint8)


def _least_size(n, num: int, den: int):
    """ceil(t * n): the least size of a set that can link with one of n."""
    return -(-num * n // den)


def _signatures(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """doc_id, n, a, b (the set's hash), least (n-gram hash), prefix (uint64 tokens, rare first), bins (histogram)."""
    counts = docs.sparkSession.sparkContext.broadcast(_frequencies(docs, size))

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                sets = shingle_sets(data, offsets, size)
                doc, keys, edges = sets.docs, sets.keys, sets.edges
                n = np.diff(edges)
                a, b = _set_hashes(sets)
                order = np.lexsort((keys, counts.value[scratch.cell_of(keys, len(counts.value))], doc))
                tokens = mix(keys[order])
                take = np.where(n > 0, n - _least_size(n, num, den) + 1, 0)
                least = np.zeros(hi - lo, U64)
                least[n > 0] = keys[edges[:-1][n > 0]]
                wide = np.where(n > LONG, 256, 64)
                at = doc * 256 + ((keys >> U64(56)).astype(np.int64) & (wide[doc] - 1))
                bins = np.minimum(np.bincount(at, minlength=256 * (hi - lo)), 255).astype(np.uint8).reshape(-1, 256)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(a), pa.array(b), pa.array(least.view(np.int64)), scratch.packed([tokens[e : e + k].tobytes() for e, k in zip(edges, take, strict=False)]), scratch.packed([bins[i, : wide[i]].tobytes() for i in range(hi - lo)])],
                    names=["doc_id", "n", "a", "b", "least", "prefix", "bins"],
                )

    return scratch.table(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, a long, b long, least long, prefix binary, bins binary"))


def _tokens(prefixes: pa.Array) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in prefixes] or [np.zeros(0, U64)])


def _list_parts(classes: DataFrame, total: int) -> np.ndarray:
    """For each cell of prefix n-grams, into how many parts of ``LIST`` classes their lists are dealt: by a count that is never too low."""
    spark = classes.sparkSession
    cells, most = 1 << min(MOST_LISTS, max(LEAST_LISTS, (total // 64).bit_length())), LIST

    def partial(batches):
        counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            at, n = np.unique(np.concatenate((counts[0], scratch.cell_of(_tokens(batch.column(0)), cells))), return_counts=True)
            n[np.isin(at, counts[0], assume_unique=True)] += counts[1] - 1
            counts = at, n
        edges = np.concatenate(([0], np.flatnonzero(np.diff(counts[0] >> 16)) + 1, [len(counts[0])])).tolist()
        out = [(int(counts[0][a]) >> 16, z - a, (counts[0][a:z] & 0xFFFF).astype(np.uint16).tobytes() + counts[1][a:z].astype(np.uint32).tobytes()) for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["slice", "n", "cells"])

    def merge(batches):
        at, sums = None, np.zeros(scratch.SLICE, np.int64)

        def done():
            parts = np.minimum(-(-sums // most), 0xFFFF).astype(np.uint16)
            if (parts > 1).any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), scratch.packed([parts.tobytes()])], names=["slice", "parts"])

        for batch in batches:
            for k, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k != at:
                    yield from done()
                    at, sums = k, np.zeros(scratch.SLICE, np.int64)
                raw = raw.as_buffer()
                np.add.at(sums, np.frombuffer(raw, np.uint16, n), np.frombuffer(raw, np.uint32, n, 2 * n))
        yield from done()

    dealt = classes.select("prefix").mapInArrow(partial, scratch.SKETCH_ROW).repartition(min(scratch.partitions_of(spark), cells // scratch.SLICE), "slice").sortWithinPartitions("slice")
    out = np.ones(cells, np.uint16)
    for row in dealt.mapInArrow(merge, "slice int, parts binary").collect():  # bounded by the number of cells
        out[row.slice * scratch.SLICE : (row.slice + 1) * scratch.SLICE] = np.frombuffer(row.parts, np.uint16)
    return out


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """token, parts (of its list), cid, n, pos, bins of prefix n-grams that the sketch takes for shared."""
    spark = classes.sparkSession
    total = classes.agg(F.sum(F.octet_length("prefix")).alias("n")).first().n or 0
    width = scratch.width_for(total // 8, 16, 29)
    lists = spark.sparkContext.broadcast(_list_parts(classes, total // 8))

    def cells(tokens: np.ndarray, row: int) -> np.ndarray:
        return scratch.cell_of(tokens ^ multipliers(3)[row + 1], width)

    def partial(batches):
        for batch in batches:
            tokens = _tokens(batch.column(0))
            out = [(row * (width // scratch.SLICE) + k, n, raw) for row in range(2) for k, n, raw in scratch.sketch_rows(cells(tokens, row))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["slice", "n", "cells"])

    bits = scratch.repeated_cells(classes.select("prefix").mapInArrow(partial, scratch.SKETCH_ROW), 2 * width, min(scratch.partitions_of(spark), 2 * width // scratch.SLICE))
    shared = spark.sparkContext.broadcast([bits[: width // 8], bits[width // 8 :]])

    def run(batches):
        for batch in batches:
            ids, ns, prefixes = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            counts = np.array([len(x.as_buffer()) // 8 for x in prefixes], np.int64)
            if not counts.sum():
                continue
            tokens = _tokens(prefixes)
            row = np.repeat(np.arange(len(ids)), counts)
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
            keep = scratch.bit(shared.value[0], cells(tokens, 0)) & scratch.bit(shared.value[1], cells(tokens, 1))
            at, tokens = row[keep], tokens[keep]
            parts = lists.value[scratch.cell_of(tokens, len(lists.value))].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(parts), pa.array(ids[at]), pa.array(ns[at]), pa.array(pos[keep]), batch.column(3).take(pa.array(at))], names=["token", "parts", "cid", "n", "pos", "bins"])

    return classes.select("cid", "n", "prefix", "bins").mapInArrow(run, "token long, parts long, cid long, n long, pos long, bins binary")


def _filtered(ns: np.ndarray, pos: np.ndarray, bins: pa.Array, meet: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j (sizes ascend) of a prefix n-gram's classes that may ``meet`` and pass the three filters."""
    i, j = np.nonzero(np.triu(meet & (ns[:, None] >= _least_size(ns, num, den)[None, :]), 1))
    overlap = -(-num * (ns[i] + ns[j]) // (num + den))
    ok = np.minimum(ns[i] - pos[i], ns[j] - pos[j]) >= overlap
    i, j, overlap = i[ok], j[ok], overlap[ok]
    if not len(i):
        return i, j
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in bins]
    small = np.stack([x.reshape(-1, 64).sum(axis=0, dtype=np.int64) for x in raw])
    full = np.stack([(x.reshape(-1, 64) == 255).any(axis=0) for x in raw])
    any_full = full.any()
    fit = np.empty(len(i), bool)
    for lo in range(0, len(i), 8192):
        p, q = i[lo : lo + 8192], j[lo : lo + 8192]
        most = np.minimum(small[p], small[q])
        if any_full:
            most = np.where(full[p] & full[q], 1 << 40, np.where(full[p], small[q], np.where(full[q], small[p], most)))
        fit[lo : lo + 8192] = most.sum(axis=1) >= overlap[lo : lo + 8192]
    i, j, overlap = i[fit], j[fit], overlap[fit]
    fine = np.array([len(x) == 256 for x in raw])
    fine = np.flatnonzero(fine[i] & fine[j])
    if len(fine):
        keep, long_ = np.ones(len(i), bool), {k: raw[k].astype(np.int64) for k in np.unique((i[fine], j[fine])).tolist()}
        for x in fine.tolist():
            u, v = long_[i[x]], long_[j[x]]
            keep[x] = ((u == 255) & (v == 255)).any() or np.where(u == 255, v, np.where(v == 255, u, np.minimum(u, v))).sum() >= overlap[x]
        i, j = i[keep], j[keep]
    return i, j


def _by_blocks(a: np.ndarray, b: np.ndarray, block: int) -> pa.RecordBatch:
    """Pairs of class numbers as rows (bi, bj, places): by pair of blocks a sorted list of places, or a bitmap of all places where that is shorter."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    bi, bj, code = a // block, b // block, (a % block) * block + b % block
    order = np.lexsort((code, bj, bi))
    bi, bj, code = bi[order], bj[order], code[order]
    other = np.ones(len(bi), bool)
    other[1:] = (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
    new = other.copy()
    new[1:] |= code[1:] != code[:-1]
    bi, bj, code, other = bi[new], bj[new], code[new].astype(np.uint16), other[new]
    first = np.flatnonzero(other)
    raw, most = code.tobytes(), block * block // 8
    places = []
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(code)], strict=True):
        if 2 * (hi - lo) < most:
            places.append(raw[2 * lo : 2 * hi])
        else:
            bits = np.zeros(block * block, bool)
            bits[code[lo:hi]] = True
            places.append(np.packbits(bits).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bi[first]), pa.array(bj[first]), scratch.packed(places)], names=["bi", "bj", "places"])


def _places(raw: pa.BinaryScalar, block: int) -> np.ndarray:
    data = np.frombuffer(raw.as_buffer(), np.uint8)
    return np.flatnonzero(np.unpackbits(data)) if len(data) == block * block // 8 else data.view(np.uint16).astype(np.int64)


def _kept_pairs(shared: DataFrame, num: int, den: int) -> DataFrame:
    """bi, bj, places of the pairs that pass the filters on one of their common prefix n-grams; several rows for a pair of blocks."""
    block = BLOCK
    span = F.floor(F.log("n") / math.log(den / num)).cast("long")
    sized = shared.withColumn("bin", F.explode(F.array(span, span - 1))).withColumn("home", F.col("bin") == span)
    sized = sized.withColumn("own", F.pmod(F.xxhash64("cid"), "parts")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cells = sized.select("token", "bin", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "home", "cid", "n", "pos", "bins")

    def run(batches):
        held, n = [], 0
        for (_, _, i, j), rows in _cells_of(batches, 4, least=2):
            own, home, cid = rows.column(4).to_numpy(), rows.column(5).to_numpy(zero_copy_only=False), rows.column(6).to_numpy()
            if not home.any():
                continue
            meet = home[:, None] | home[None, :]
            if i != j:
                meet &= own[:, None] != own[None, :]
            p, q = _filtered(rows.column(7).to_numpy(), rows.column(8).to_numpy(), rows.column(9), meet, num, den)
            if len(p):
                held.append((cid[p], cid[q]))
                n += len(p)
            if n > HELD:
                yield _by_blocks(*map(np.concatenate, zip(*held, strict=True)), block)
                held, n = [], 0
        if held:
            yield _by_blocks(*map(np.concatenate, zip(*held, strict=True)), block)

    dealt = cells.repartition("token", "bin", "i", "j").sortWithinPartitions("token", "bin", "i", "j", "n", "cid")
    return dealt.mapInArrow(run, "bi long, bj long, places binary")


def _tasks(pairs: DataFrame) -> DataFrame:
    """bi, bj, places of each pair of blocks once, with a null cid; and bi, bj, cid of each class in a pair of theirs."""
    block = BLOCK

    def run(batches):
        for batch in _batched(_cells_of(batches, 2)):
            out = []
            for (bi, bj), rows in batch:
                codes = np.unique(np.concatenate([_places(x, block) for x in rows.column(2)]))
                merged = _by_blocks(bi * block + codes // block, bj * block + codes % block, block)
                out.append((bi, bj, None, merged.column(2)[0].as_py()))
                out += [(bi, bj, c, None) for c in np.unique(np.concatenate((bi * block + codes // block, bj * block + codes % block))).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bi", "bj", "cid", "places"])

    return scratch.table(pairs.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(run, "bi long, bj long, cid long, places binary"))


def _batched(items, size: int = 256):
    held = []
    for x in items:
        held.append(x)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _verified(tasks: DataFrame, classes: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """cid, other, weight of verified links: spanning edges (weight 0) and, with other null, linked documents of a class.

    ``tasks``: what ``_tasks`` gives; ``classes``: cid, a, b, rep, n_docs.
    """
    spark, block = docs.sparkSession, BLOCK
    # A class without ids has a null rep; its rows are one as a key of the join.
    keyed = lambda df: df.withColumn("no_id", F.col("rep").isNull()).withColumn("rep", F.coalesce("rep", F.lit(0).cast("long")))
    wanted = scratch.table(keyed(classes.join(tasks.where("cid is not null").select("cid").distinct().hint("merge"), "cid")))
    picks = spark.sparkContext.broadcast(scratch.bitmap(wanted.where("not no_id").select(F.xxhash64("rep")), CHOSEN))

    def sets_of(batches):
        for batch in batches:
            named = batch.column(2)
            take = scratch.bit(picks.value, scratch.cell_of(named.fill_null(0).to_numpy().view(U64), CHOSEN)) | named.is_null().to_numpy(zero_copy_only=False)
            ids, texts = (batch.column(k).filter(pa.array(take)) for k in (0, 1))
            for lo, hi, data, offsets in chunks(texts):
                found = shingle_sets(data, offsets, size)
                a, b = _set_hashes(found)
                has = np.flatnonzero(np.diff(found.edges))
                both = [found.keys[s:e].tobytes() + found.checks[s:e].tobytes() for s, e in zip(found.edges[has].tolist(), found.edges[has + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(pa.array(has)), pa.array(a[has]), pa.array(b[has]), scratch.packed(both)], names=["rep", "a", "b", "keys"])

    named = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id")).alias("named"))
    made = keyed(named.mapInArrow(sets_of, "rep long, a long, b long, keys binary")).groupBy("a", "b", "rep", "no_id").agg(F.first("keys").alias("keys"))
    sets = scratch.table(wanted.hint("merge").join(made, ["a", "b", "rep", "no_id"]).select("cid", "n_docs", "keys"))
    none = lambda t: F.lit(None).cast(t)
    members = tasks.where("cid is not null").select("bi", "bj", "cid").join(sets.hint("merge"), "cid").select("bi", "bj", "cid", "n_docs", "keys", none("binary").alias("places"))
    lists = tasks.where("cid is null").select("bi", "bj", "cid", none("long").alias("n_docs"), none("binary").alias("keys"), "places")

    def verify(batches):
        for (bi, bj), rows in _cells_of(batches, 2):
            # Sorted by cid, the list comes first.
            codes = _places(rows.column(5)[0], block)
            cid, docs_of = rows.column(2).slice(1).to_numpy(), rows.column(3).slice(1).to_numpy()
            sets = [np.frombuffer(x.as_buffer(), U64).reshape(2, -1) for x in rows.column(4).slice(1)]
            pairs = np.zeros((len(cid), len(cid)), bool)
            pairs[np.searchsorted(cid, bi * block + codes // block), np.searchsorted(cid, bj * block + codes % block)] = True
            p, q = _linked(sets, pairs, num, den)
            if not len(p):
                continue
            forest = Forest()
            edges = [(a, b) for a, b in zip(cid[p].tolist(), cid[q].tolist(), strict=True) if forest.union(a, b)]
            weight = np.bincount(p, docs_of[q], len(cid)) + np.bincount(q, docs_of[p], len(cid))
            out = [(a, b, 0) for a, b in edges] + [(int(cid[k]), None, int(weight[k])) for k in np.flatnonzero(weight)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["cid", "other", "weight"])

    cells = members.unionByName(lists).repartitionByRange("bi", "bj").sortWithinPartitions("bi", "bj", "cid")  # ranges, so that few cells share a task by chance
    return scratch.table(cells.mapInArrow(verify, "cid long, other long, weight long"))


def _products(row: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
    """How many columns each two of ``n`` rows share; the entries come by ascending column."""
    out = np.zeros((n, n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    step = max(1, (1 << 22) // n)
    for lo in range(0, last, step):
        s, e = np.searchsorted(column, (lo, lo + step))
        part = np.zeros((n, min(step, last - lo)), np.float32)
        part[row[s:e], column[s:e] - lo] = 1
        out += part @ part.T
    return out


def _linked(sets: list[np.ndarray], pairs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (p, q) whose whole sets are similar: few pairs one by one, many by products of matrices."""
    p, q = np.nonzero(pairs)
    if not len(p):
        return p, q
    n = len(sets)
    sizes = np.array([s.shape[1] for s in sets])
    row = np.repeat(np.arange(n), sizes)
    keys, checks = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    if _clashes(keys[order], checks[order]):
        order = np.lexsort((checks, keys))
    row, keys, checks = row[order], keys[order], checks[order]
    new = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
    column = np.concatenate(([0], np.cumsum(new)))
    if len(p) * 16 < n * n:
        by_row = np.argsort(row, kind="stable")
        own = np.split(column[by_row], np.cumsum(sizes)[:-1])
        common = np.array([len(np.intersect1d(own[a], own[b], assume_unique=True)) for a, b in zip(p.tolist(), q.tolist(), strict=True)], np.int64)
    else:
        common = _products(row, column, n)[p, q].astype(np.int64)
    ok = den * common >= num * (sizes[p] + sizes[q] - common)
    return p[ok], q[ok]


def _cells_of(batches: Iterator[pa.RecordBatch], key: int, least: int = 1) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key values, rows) of each run of at least ``least`` rows with equal first ``key`` columns; what a run holds is bounded by how it was dealt."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(key)])
        cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        edges = np.concatenate(([0], cut, [batch.num_rows])).tolist()
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo < least and lo and hi < batch.num_rows:
                continue
            mine = tuple(keys[:, lo].tolist())
            if at is not None and mine != at:
                if sum(map(len, held)) >= least:
                    yield at, _one(held)
                held = []
            at = mine
            held.append(batch.slice(lo, hi - lo))
    if sum(map(len, held)) >= least:
        yield at, _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def similarity_classes(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links`` for every row of ``docs``.

    Words are runs of non-white-space after lower-casing A-Z; a document's set
    are its distinct n-grams of ``size`` words, or its whole sequence if it
    has fewer. Documents link when the Jaccard similarity of their sets is at
    least ``threshold`` (a ratio of integers, so the test is exact).
    ``component_id`` is the smallest ``doc_id`` reachable by links,
    ``n_links`` the number of other rows directly linked. A null text or one
    without words has an empty set, links with nothing and is its own
    component. Rows with equal texts link, also under one ``doc_id``. A null
    ``doc_id`` is ignored when the smallest is looked for.
    """
    num, den = threshold
    src = scratch.columns(docs, doc_id=doc_id, text=text)
    rows = _signatures(src, size, num, den)
    some = rows.where("n > 0")
    grouped = some.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), *[F.first(c).alias(c) for c in ("n", "least", "prefix", "bins")])
    near = ["least", "n", "a", "b"]
    placed = grouped.repartitionByRange(*near).sortWithinPartitions(*near).drop("least")
    classes = scratch.table(placed.withColumn("cid", F.monotonically_increasing_id()))
    short = classes.select("cid", "a", "b", "rep", "n", "n_docs")
    tasks = _tasks(_kept_pairs(_shared_tokens(classes), num, den))
    found = _verified(tasks, short.select("cid", "a", "b", "rep", "n_docs"), src, size, num, den)
    joined = connected_components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    links = found.where("other is null").groupBy("cid").agg(F.sum("weight").alias("links"))
    linked = scratch.table(joined.select(F.col("node").alias("cid"), F.col("component").alias("comp")).join(short.select("cid", "rep").hint("merge"), "cid"))
    least = scratch.table(linked.groupBy("comp").agg(F.min("rep").alias("least")))  # staged: a large component's rows can be split
    labels = short.join(linked.join(least.hint("merge"), "comp").select("cid", "least"), "cid", "left").join(links, "cid", "left")
    labels = labels.select("a", "b", F.coalesce("least", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"))
    full = some.select("doc_id", "n", "a", "b").join(labels.hint("merge"), ["a", "b"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)
