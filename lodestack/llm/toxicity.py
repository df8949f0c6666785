"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents (positives) and documents of unknown kind train
linear classifiers in numpy. With class prior p and logistic loss l, the risk
is  p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)]):  the second part is
the risk on negatives, which the unlabelled documents hold mixed with a share p
of positives. Where a batch drives that part below zero, the step goes the
other way on it, so it cannot be fitted into the negative.

Features are present or absent: hashes of the lower-cased words and of their
first 4 to 7 bytes (a stem with unseen endings still counts). Those that stand
out among the positives are kept, by a test on document counts.

The sample that is fitted is bounded by ``max_positives`` and
``max_unlabelled`` ids, the least by hash, with one text each; every row is scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .textkernel import ALNUM, LOW_BYTES, U64, chunks, lanes, mix, split

PREFIXES = (4, 5, 6, 7)
#: The score from which a text counts as toxic.
CUT = 0.7


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature hash) of every word and of its beginnings, repeats included."""
    words = split(data, offsets, ALNUM, lower=True)
    doc, length = words.doc_of(), words.ends - words.starts
    keys, docs = [words.hashes[0]], [doc]
    head = lanes(words.data)[words.starts]
    for k in PREFIXES:
        longer = length > k
        keys.append(mix((head[longer] & LOW_BYTES[k]) + U64(k << 56)))
        docs.append(doc[longer])
    return np.concatenate(docs), np.concatenate(keys)


def _distinct(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[new], keys[new]


class Model:
    """A linear classifier over chosen feature hashes."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float) -> None:
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(keys >> U64(48)).astype(np.int64)] = True

    def find(self, docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text index, feature index) of the chosen features present, each once for each text."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        take = self.filter[(keys >> U64(48)).astype(np.int64)]
        docs, keys = docs[take], keys[take]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        pair = np.unique(docs[hit] * len(self.keys) + at[hit])
        return pair // len(self.keys), pair % len(self.keys)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, feature = self.find(*_features(data, offsets))
        f = self.bias + np.bincount(doc, self.weights[feature], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def fit_nnpu(pos: list[np.ndarray], unl: list[np.ndarray], n_features: int, prior: float, seed: int = 0, epochs: int = 100, rate: float = 0.05, decay: float = 1e-5, batch: int = 512) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier; rows are arrays of the indices of features present."""
    rng = np.random.default_rng(seed)
    w = np.zeros(n_features + 1)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0

    def rows_of(rows, pick):
        chosen = [rows[i] for i in pick]
        index = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        return index.astype(np.int64), np.repeat(np.arange(len(chosen)), [len(c) for c in chosen])

    def pull(index, row, slope):
        g = np.bincount(index, slope[row], n_features + 1)
        g[-1] = slope.sum()
        return g

    steps = max(1, -(-len(unl) // batch))
    share = max(1, len(pos) // steps)
    for _ in range(epochs):
        p_order, u_order = rng.permutation(len(pos)), rng.permutation(len(unl))
        for s in range(steps):
            pi, pr = rows_of(pos, p_order[s * share : (s + 1) * share])
            ui, ur = rows_of(unl, u_order[s * batch : (s + 1) * batch])
            n_p, n_u = min(share, len(pos) - s * share), min(batch, len(unl) - s * batch)
            if n_p <= 0 or n_u <= 0:
                continue
            fp = w[-1] + np.bincount(pr, w[pi], n_p)
            fu = w[-1] + np.bincount(ur, w[ui], n_u)
            sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            on_negative = pull(ui, ur, su / n_u) - prior * pull(pi, pr, sp / n_p)
            grad = prior * pull(pi, pr, (sp - 1) / n_p) + on_negative if negative >= 0 else -on_negative
            grad[:-1] += decay * w[:-1]
            t += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            np.maximum(w[:-1], 0, out=w[:-1])  # the features were chosen as signs of the positive class
    return w[:-1], float(w[-1])


def _sampled(docs: DataFrame, ids: DataFrame, kind: int) -> DataFrame:
    """One text for each of a bounded list of ids, which is broadcast: the least, where rows share an id."""
    texts = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.select(F.lit(kind).alias("kind"), "text")


def train(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, prior: float, max_positives: int = 4000, max_unlabelled: int = 8000, max_features: int = 4096, least_z: float = 5.0, models: int = 3) -> Model:
    """Fit on the texts of ``docs(doc_id, text)`` whose ids are in ``positives`` or ``unlabelled`` (one column, ``doc_id``).

    Without positives, without unlabelled rows or where no feature tells them
    apart the model has no features and scores every text alike, by the prior.
    """
    take = lambda ids, n: ids.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = scratch.table(_sampled(docs, take(positives, max_positives), 1).unionByName(_sampled(docs, take(unlabelled, max_unlabelled), 0)))
    sizes = {r.kind: r.n for r in sample.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Model(np.zeros(0, U64), np.zeros(0), float(np.log(max(prior, 1e-6) / max(1e-6, 1 - prior))))
    if not n_p or not n_u:
        return nothing

    def counted(batches):
        for batch in batches:
            kind = batch.column(0).to_numpy()
            for lo, hi, data, offsets in chunks(batch.column(1)):
                doc, keys = _distinct(*_features(data, offsets))
                mine = kind[lo:hi][doc]
                values, at = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.bincount(at, mine == 1, len(values)).astype(np.int64)), pa.array(np.bincount(at, mine == 0, len(values)).astype(np.int64))], names=["feature", "p", "u"])

    counts = sample.mapInArrow(counted, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    mean = (F.col("p") + F.col("u")) / (n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(mean * (1 - mean) * (1 / n_p + 1 / n_u) + 1e-12)
    kept = counts.where("p >= 3").withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(max_features).select("feature").collect()
    if not kept:
        return nothing
    keys = np.array([r.feature for r in kept], np.int64).view(U64)
    blank = Model(keys, np.zeros(len(keys)), 0.0)

    def indexed(batches):
        for batch in batches:
            kind, out = batch.column(0).to_pylist(), []
            for lo, hi, data, offsets in chunks(batch.column(1)):
                doc, feature = blank.find(*_features(data, offsets))
                out += np.split(feature, np.searchsorted(doc, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array([x.tolist() for x in out], pa.list_(pa.int32()))], names=["kind", "features"])

    rows = sorted(sample.mapInArrow(indexed, "kind int, features array<int>").collect())  # at most max_positives + max_unlabelled
    pos = [np.array(r.features, np.int64) for r in rows if r.kind == 1]
    unl = [np.array(r.features, np.int64) for r in rows if r.kind == 0]
    return Model(blank.keys, *cross_fitted(pos, unl, len(keys), prior, models))


def cross_fitted(pos: list[np.ndarray], unl: list[np.ndarray], n_features: int, prior: float, models: int) -> tuple[np.ndarray, float]:
    """The mean of classifiers that each leave one fold out, shifted so that the best cut lies at ``CUT``.

    The cut is chosen on the folds left out, without negatives: it maximises
    recall ** 2 / (share of unlabelled texts above it), which orders cuts as the
    F-measure would (Lee and Liu, 2003).
    """
    fitted, out_p, out_u = [], [], []
    of = lambda rows, w, b: np.array([w[r].sum() + b for r in rows])
    for k in range(models):
        keep = lambda rows, k=k: [r for i, r in enumerate(rows) if i % models != k] or rows
        w, b = fit_nnpu(keep(pos), keep(unl), n_features, prior, k)
        fitted.append((w, b))
        out_p.append(of(pos[k::models], w, b))
        out_u.append(of(unl[k::models], w, b))
    high, low = np.sort(np.concatenate(out_p)), np.sort(np.concatenate(out_u))
    recall = 1 - np.arange(len(high)) / len(high)
    share = (len(low) - np.searchsorted(low, high) + 0.5) / len(low)
    best = int(np.argmax(recall**2 / np.maximum(share, recall * prior)))
    under = low[low < high[best]]
    cut = (high[best] + (under[-1] if len(under) else high[best] - 1)) / 2
    shift = np.log(CUT / (1 - CUT)) - cut
    return np.mean([w for w, _ in fitted], axis=0), float(np.mean([b for _, b in fitted]) + shift)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The test fold: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def class_prior(labels: DataFrame, toxic: str = "toxic") -> float:
    """Share of toxic rows among labelled rows."""
    found = labels.where(F.col(toxic).isNotNull()).agg(F.avg(F.col(toxic).cast("double")).alias("p")).first().p
    return min(0.9, max(0.001, found)) if found is not None else 0.05


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` of every row's whole text; null counts as the empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.scores(data, offsets) for _, _, data, offsets in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], names=["doc_id", "score"])

    return scratch.columns(docs, doc_id=doc_id, text=text).mapInArrow(run, "doc_id long, score double")


def keep_below(docs: DataFrame, model: Model, most: float = CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``most``; no row is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)
    scratch.columns(docs, text=text)

    def run(batches):
        for batch in batches:
            found = [shared.value.scores(data, offsets) for _, _, data, offsets in chunks(batch.column(place))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) < most))

    return docs.mapInArrow(run, docs.schema)


def train_on_labels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", **bounds: int) -> Model:
    """A model from the training fold only: its toxic rows, its class prior, and unlabelled texts outside the test fold."""
    src = scratch.columns(docs, doc_id=doc_id, text=text)
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).where(~held_out())
    return train(src, known.where("toxic = 1").select("doc_id"), src.where(~held_out()).select("doc_id"), class_prior(known), **bounds)


def classify(docs: DataFrame, labels: DataFrame, most: float = CUT, **names: str) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    A null text is scored as the empty text, which has no features; so is a
    text without words. Rows are scored one by one: repeated rows get equal
    scores, and rows that share a ``doc_id`` are fitted as one (the least of
    their texts). A row with a null ``doc_id`` is scored, not held out, and
    never fitted. An id that is labelled twice is a positive if any of its
    labels is. Ties in the choice of the sample go by hash of the id and then the
    id, ties among features by their hash. Without labels, or where no feature
    tells them apart, every text has the same score.
    """
    model = train_on_labels(docs, labels, **names)
    texts = {k: v for k, v in names.items() if k in ("doc_id", "text")}
    return score(docs, model, **texts).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= most).cast("int").alias("predicted"))
