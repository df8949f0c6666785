"""Line dedup, dominance counting and the filter audit against brute force, and their awkward rows."""

import datetime
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import dominance, filter_audit, line_dedup

DOCS = "doc_id long, text string, lang string"


# ---- line dedup


def key(line):
    bare = line.strip(" \t\n\x0b\x0c\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in bare)


def lines_by_hand(docs, min_docs=2, min_chars=10):
    holders = {}
    for i, text in docs:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(held := holders.get(key(x), ())) < min_docs or i == min(held)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


AWKWARD = [
    (1, "Shared line of text\nown line number one\nshort"),
    (2, "  SHARED line of text\t\nshort\n\n"),
    (2, "  SHARED line of text\t\nshort\n\n"),
    (2, "another text of the same id\nshared LINE of text"),
    (3, None),
    (4, ""),
    (5, "\n\n"),
    (6, "nine char\nnine char"),
    (7, "nine char\nTen chars!"),
    (8, "ten chars!\r\nTen chars!\nÉtat de la ligne"),
    (9, "état de la ligne\nÉtat de la ligne\nlast"),
    (10, "within itself twice\nWithin itself twice"),
    (11, "within itself twice"),
    (None, "shared line of text\nnobody's own line"),
    (12, "nobody's own line"),
    (13, " shared line of text"),
    (14, "x" * 200_000 + "\nshared line of text\n" + "\n".join(f"line number {k} of it" for k in range(3000))),
]


@pytest.mark.parametrize("min_docs", [2, 3])
def test_lines_of_awkward_documents(spark, rows, min_docs):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in AWKWARD], "doc_id long, text string, pos int, owner string").repartition(3)
    assert rows(line_dedup.dedup_lines(df, min_docs=min_docs)) == lines_by_hand(AWKWARD, min_docs)


def test_lines_at_random(spark, rows):
    rng = random.Random(5)
    pool = [f"{rng.choice(['The', 'a'])} line {rng.choice('äBc')} {k}" for k in range(12)]
    docs = [(rng.randrange(40), "\n".join(rng.choice(pool) + rng.choice(["", " ", "!"]) for _ in range(rng.randrange(0, 9)))) for _ in range(60)]
    assert rows(line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))) == lines_by_hand(docs)


def test_lines_of_no_documents(spark):
    out = line_dedup.digests(line_dedup.dedup_lines(spark.createDataFrame([], DOCS)))
    assert out.count() == 0 and out.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_line_dedup_is_native(spark, tmp_path):
    text = line_dedup.digests(line_dedup.dedup_lines(spark.createDataFrame(AWKWARD, "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("Python", "Pandas", "Arrow"))


# ---- dominance counting


def above_by_hand(points):
    out = []
    for i, slot, level, _ in points:
        if slot is None or level is None:
            out.append((i, slot, level, None, None))
            continue
        up = [w or 0 for _, s, v, w in points if s is not None and v is not None and s <= slot and v > level]
        out.append((i, slot, level, len(up), sum(up)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("slots", "levels"), [(8, 5), (40, 200), (1, 60), (60, 1)])
def test_dominance_equals_brute_force(spark, rows, slots, levels):
    rng = random.Random(slots)
    pick = lambda n: None if rng.random() < 0.05 else rng.randrange(-n, n)
    points = [(rng.choice([k, None, 7]), pick(slots), pick(levels), rng.choice([0, 1, 2, 3, None])) for k in range(500)]
    df = spark.createDataFrame(points, "id long, slot long, level long, weight long").withColumns({"n": F.lit(1), "w": F.lit("x"), "strip": F.lit(2)})
    assert rows(dominance.dominance_counts(df.repartition(5))) == above_by_hand(points)


def test_dominance_of_a_hot_cell_and_far_values(spark, rows):
    points = [(k, 3, 7, 1) for k in range(400)] + [(k, 3, 8, 2) for k in range(400, 403)] + [(1000, -(1 << 61), 1 << 61, 5), (1001, 1 << 61, -(1 << 61), 1)]
    df = spark.createDataFrame(points, "id long, slot long, level long, weight long")
    assert rows(dominance.dominance_counts(df)) == above_by_hand(points)


def test_dominance_of_nothing(spark):
    empty = spark.createDataFrame([], "id long, slot long, level long, weight long")
    assert dominance.dominance_counts(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, 2, 1), (1, None, 2, 1)], "id long, slot long, level long, weight long")
    assert [tuple(r) for r in dominance.dominance_counts(nulls).collect()] == [(1, None, 2, None, None)] * 2


def test_level_sums_update_singly_and_at_once():
    rng = np.random.default_rng(1)
    levels = rng.integers(-50, 50, 300)
    sums, seen = dominance.LevelSums(levels), []
    for size in (1, 2, 40, 3, 120, 1):
        some = rng.choice(levels, size)
        weights = rng.integers(0, 9, (2, size))
        sums.add(sums.ranks(some), weights)
        seen += list(zip(some, *weights, strict=True))
        asked = np.unique(levels)
        want = [[sum(x[k] for x in seen if x[0] > level) for level in asked] for k in (1, 2)]
        assert sums.above(sums.ranks(asked)).tolist() == want


def test_points_of_sales(spark):
    at = datetime.datetime(1969, 12, 31, 23, 59, 59, 500_000)
    rows = [(12, at, 9.994), (13, at, -0.006), (14, None, 10.0), (None, datetime.datetime(2024, 3, 31, 0, 0), None), (15, at, float("nan")), (16, at, float("inf")), (17, at, 1e300), (18, at, 1e17), (19, at, 1.005)]
    df = spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            got = [tuple(r) for r in dominance.sales_points(df).collect()]
            assert [r[1] for r in got] == [-1, -1, None, 19813, -1, -1, -1, -1, -1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r[2] for r in got] == [0, -1, 1, None, None, None, None, int(1e17 * 100 // 1000), 0]
    assert [r[3] for r in got] == [1 + (zlib.crc32(str(r[0]).encode()) % 3 if r[0] is not None else 0) for r in rows]


# ---- filter audit


def audit_by_hand(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = [w for w in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
        fails = "".join(
            f
            for f, bad in zip(
                "ABCDE",
                (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i),
                strict=True,
            )
            if bad
        )
        rows.append((lang or "", fails, *(int(i is not None and any(x[0] == i and x[k] == 1 for x in labels)) for k in (1, 2))))
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        steps = []
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, before = [r for r in left if f in r[1]], [r for r in mine if r not in left]
                redundant = sum(1 for r in mine if f in r[1]) - len(gone)
                left = [r for r in left if f not in r[1]]
                steps.append([part, "".join(order), step, len(left), len(gone), redundant, sum(1 for r in mine if r[1] == f), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        for s in steps:
            out.append((*s[:-1], sum(x[4] for x in steps if x[-1] == s[-1])))
    return sorted(out, key=repr)


def some_text(rng):
    n = rng.choice([0, 3, 150, 220, 260])
    words = [rng.choice(["Alpha", "beta", "gamma"]) if rng.random() < rng.choice([0.0, 0.9]) else f"w{rng.randrange(10**6)}" for _ in range(n)]
    return rng.choice([" ", "\t\x0b", "  "]).join(words) + rng.choice(["", "", "#", "$1"])


def test_audit_equals_brute_force(spark, rows):
    rng = random.Random(3)
    texts = [some_text(rng) for _ in range(40)] + [None, "", "A" * 50]
    docs = [(rng.choice([k, 5, None, 60 - k]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for k in range(150)]
    labels = [(rng.randrange(60), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(50)] + [(None, 1, 1), (10**6, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS + ", n int, part string").repartition(4)
    got = rows(filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert got == audit_by_hand(docs, labels)


def test_texts_given_up_early_are_settled_later():
    docs = [(9, "a" * 400), (3, "a" * 400), (3, "a" * 400), (7, "b"), (1, "c" * 300), (2, "a" * 400), (8, "b")]
    entries = list(filter_audit._read((i, "", t) for i, t in docs))
    for limit in (1, 500, 10**6):
        out = list(filter_audit.settled(filter_audit.settled(entries, limit)))
        found = sorted((i, bool(mask & filter_audit.E), sum(parts.values())) for _, (_, i, parts, mask) in out)
        merged = {}
        for i, fails, n in found:
            merged[i, fails] = merged.get((i, fails), 0) + n
        assert merged == {(9, True): 1, (3, True): 2, (7, False): 1, (1, False): 1, (2, False): 1, (8, True): 1}


def test_texts_that_collide_are_kept_apart():
    out = list(filter_audit.settled([(1, (b"x", 5, {"en": 1}, 0)), (1, (b"y", 6, {"en": 1}, 0)), (1, (b"x", 4, {"fr": 1}, 0))]))
    assert sorted((i, parts, mask) for _, (_, i, parts, mask) in out) == [(4, {"fr": 1}, 0), (5, {"en": 1}, filter_audit.E), (6, {"en": 1}, 0)]


def test_audit_of_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert one.count() == 600
