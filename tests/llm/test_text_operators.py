"""Passage dedup, decontamination, similarity classes and BPE against brute force."""

import base64
import hashlib
import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestack.llm import bm25, byte_bpe, components, decontaminate, jaccard_join, substring_dedup, textkernel

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=1, n=60):
    """Documents with shared passages, copies, near copies, junk, and awkward texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["été", "Über", "alpha", "x1", "日本", "b", "Γάμμα"]) + str(rng.randrange(400))
    passage = [word() for _ in range(70)]
    base = [word() for _ in range(120)]
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.choice([0, 1, 3, 20, 60, 150]))]
        kind = i % 6
        if kind == 0:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage[rng.randrange(15) :]
        elif kind == 1:
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                ws[rng.randrange(len(ws))] = word()
        elif kind == 2 and out:
            ws = (rng.choice(out)[1] or "").split()
        out.append((i, rng.choice([" ", "\n", "  \t"]).join(ws)))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "same " * 130), (n + 4, "same " * 260), (n + 5, "nbsp stays " * 60), (n + 6, "Z" * 5000)]


def brute_passages(docs, size):
    words = {i: SPACE.findall(t or "") for i, t in docs}
    owner = {}
    for i, ws in sorted(words.items()):
        for p in range(len(ws) - size + 1):
            owner.setdefault(tuple(ws[p : p + size]), i)
    out = []
    for i, ws in words.items():
        gone = set()
        for p in range(len(ws) - size + 1):
            if owner[tuple(ws[p : p + size])] < i:
                gone |= set(range(p, p + size))
        out.append((i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("size", [50, 12, 4])
def test_passages_match_brute_force(spark, size):
    docs = corpus()
    got = substring_dedup.dedup_passages(spark.createDataFrame(docs, DOCS).repartition(5), size=size)
    assert sorted(map(tuple, got.collect())) == brute_passages(docs, size)


def test_a_saturated_sketch_loses_nothing(spark):
    docs = corpus(3)
    got = substring_dedup.dedup_passages(spark.createDataFrame(docs, DOCS), size=10, max_sketch_bits=16)
    assert sorted(map(tuple, got.collect())) == brute_passages(docs, 10)


def test_passages_carry_columns_and_leave_clean_texts(spark):
    rows = [(1, "a  b\nc", "en", 5), (2, " ".join(map(str, range(60))), "fr", 6), (3, " ".join(map(str, range(60))) + " tail", None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, doc int")
    got = {r.doc_id: r for r in substring_dedup.dedup_passages(df, carry=("lang", "doc"), as_is=True).collect()}
    assert got[1].kept_text == "a  b\nc" and got[1].doc == 5
    assert got[3].kept_text == "tail" and got[3].n_removed == 60 and got[3].lang is None


def test_empty_tables(spark, rows):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert rows(substring_dedup.dedup_passages(none)) == []
    assert rows(jaccard_join.similarity_classes(none)) == []
    assert rows(decontaminate.decontaminate(none, items)) == []
    assert rows(byte_bpe.round_trip(none, RANKS, public_tokenizers.PATTERN)) == []
    some = spark.createDataFrame([(1, "a b"), (None, None)], DOCS)
    assert rows(decontaminate.decontaminate(some, items)) == sorted([(1, 2, 0, [], False), (None, 0, 0, [], False)], key=repr)
    assert len(rows(substring_dedup.dedup_passages(some))) == 2
    assert len(rows(jaccard_join.similarity_classes(some))) == 2


def thue_morse(n):
    """A word over a and b, and its complement: equal under any polynomial modulo 2**64 from about 1,024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_collide_under_polynomials_stay_apart(spark, n):
    first, second = thue_morse(n)
    docs = spark.createDataFrame([(1, " ".join([first] * 60)), (2, " ".join([second] * 60))], DOCS)
    assert {r.doc_id: r.n_removed for r in substring_dedup.dedup_passages(docs).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.component_id for r in jaccard_join.similarity_classes(docs, size=3).collect()} == {1: 1, 2: 2}
    items = spark.createDataFrame([(7, " ".join([first] * 10))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.decontaminate(docs, items).collect()} == {1: True, 2: False}
    found = bm25.top_k(docs, docs, k=5)
    assert {(r.query_id, r.doc_id) for r in found.collect()} == {(1, 1), (2, 2)}


def test_word_order_is_not_lost():
    """Two words in the order of Thue and Morse: windows of them differ although their words' sums agree."""
    a, b = (" ".join(w) for w in thue_morse(64))
    for size in (2, 5, 12, 50):
        grams = []
        for text in (a, b):
            raw = text.encode()
            words = textkernel.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            grams.append({tuple(text.split()[p : p + size]): g for p, g in enumerate(textkernel.grams(words.hashes[0], size).tolist())})
        every = grams[0] | grams[1]
        assert len(set(every.values())) == len(every) and all(grams[0][k] == grams[1][k] for k in grams[0].keys() & grams[1].keys())


def test_passages_of_rows_with_one_id_or_none(spark):
    rng = random.Random(31)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, other = text(60), text(55)
    docs = [(1, f"{shared} {text(9)}"), (2, f"{text(5)} {shared}"), (2, f"{text(7)} {shared} {other}"), (2, other), (None, f"{shared} a"), (None, f"{other} b"), (None, f"{other} b"), (None, f"{text(55)}"), (3, "x" * 100_000 + " y")]
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.dedup_passages(spark.createDataFrame(docs, DOCS).repartition(3)).collect())
    assert got == [(0, 55, 0), (0, 56, 55), (0, 56, 55), (0, 61, 60), (1, 69, 0), (2, 55, 0), (2, 65, 60), (2, 122, 60), (3, 2, 0)]


def brute_hits(docs, items, size):
    words = {i: ALNUM.findall(lower(t)) for i, t in docs}
    out = []
    for d, ws in words.items():
        hit, ids = set(), set()
        for item, text in items:
            its = ALNUM.findall(lower(text))
            n = min(size, len(its))
            for s in range(len(its) - n + 1) if n else ():
                for p in range(len(ws) - n + 1):
                    if ws[p : p + n] == its[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item))
        out.append((d, len(ws), len(hit), sorted(ids), bool(hit)))
    return sorted(out)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.5 else f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 5, 10, 14, 30])))) for i in range(25)] + [(100, None), (3, "the of"), (101, "!!!")]
    docs = []
    for i in range(80):
        ws = [word() for _ in range(rng.choice([0, 5, 40, 200]))]
        if i % 3 == 0:
            its = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = [w.upper() for w in its[rng.randrange(3) :]]
        docs.append((i, rng.choice([" ", ", ", "-"]).join(ws)))
    docs += [(80, None), (81, "")]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_hits(docs, items, 10)


def test_decontamination_of_awkward_rows(spark):
    docs = [(1, "the " * 5000), (2, "nothing here"), (2, "of THE end"), (3, "x" * 50_000), (None, "the")]
    items = spark.createDataFrame([(5, "the", 1), (5, "the", 2), (6, "of the", 3)], "item_id long, text string, token long")
    df = spark.createDataFrame(docs, DOCS).withColumn("token", F.lit(1)).withColumn("row", F.lit("clash")).withColumn("words", F.lit(0)).repartition(3)
    got = sorted(map(tuple, decontaminate.decontaminate(df, items).collect()), key=repr)
    want = [(1, 5000, 5000, ["5"], True), (2, 2, 0, [], False), (2, 3, 2, ["5", "6"], True), (3, 1, 0, [], False), (None, 1, 1, ["5"], True)]
    assert got == sorted(want, key=repr)


def brute_classes(docs, size, num, den):
    sets = {}
    for i, t in docs:
        ws = SPACE.findall(lower(t))
        sets[i] = {tuple(ws[p : p + size]) for p in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set()
    links = {i: set() for i in sets}
    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    out = []
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((i, len(sets[i]), min(seen), len(links[i])))
    return sorted(out)


@pytest.mark.parametrize(("size", "num", "block"), [(3, 90, 256), (5, 80, 256), (1, 50, 256), (3, 60, 4)])
def test_classes_match_brute_force(spark, monkeypatch, size, num, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "LIST", 8 if block == 4 else 1024)
    docs = corpus(7, 120)
    got = jaccard_join.similarity_classes(spark.createDataFrame(docs, DOCS).repartition(5), size=size, threshold=(num, 100))
    assert sorted(map(tuple, got.collect())) == brute_classes(docs, size, num, 100)


def test_near_copies_without_ids_link(spark):
    base = [f"w{k}" for k in range(60)]
    first, second, third = " ".join(base), " ".join([*base, "x1"]), " ".join([*base, "x1", "x2"])
    docs = [(1, first), (None, second), (None, second), (9, third)]
    got = jaccard_join.similarity_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), size=3, threshold=(98, 100)).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.n_links) for r in got) == [(0, 1, 3), (0, 1, 3), (1, 1, 2), (9, 1, 2)]


def test_a_chain_through_a_row_without_id(spark):
    rng = random.Random(32)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    one, two = list(base), list(base)
    one[100] = "x"
    two[100], two[20] = "x", "y"
    docs = [(1, " ".join(base)), (None, " ".join(one)), (7, " ".join(two)), (9, " ".join(base[:100]))]
    got = jaccard_join.similarity_classes(spark.createDataFrame(docs, DOCS).withColumn("rep", F.lit(5)).withColumn("cid", F.lit("clash")).repartition(3), size=3, threshold=(96, 100))
    assert sorted((r.doc_id or 0, r.component_id, r.n_links) for r in got.collect()) == [(0, 1, 2), (1, 1, 1), (7, 1, 1), (9, 9, 0)]


def test_rows_with_one_id_and_null_ids(spark):
    text = " ".join(map(str, range(30)))
    got = jaccard_join.similarity_classes(spark.createDataFrame([(1, text), (1, text), (None, text), (2, "x y z")], DOCS))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, 26, 1, 2), (1, 26, 1, 2), (None, 26, 1, 2), (2, 1, 2, 0)], key=repr)


@pytest.mark.parametrize("one_task", [components.ONE_TASK, 0])
def test_components(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1064)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    forest = components.Forest()
    for a, b in edges:
        forest.union(a, b)
    want = {(x, forest.root(x)) for e in edges if e[0] != e[1] for x in e}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(6))
    assert {tuple(r) for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.fixture(scope="module")
def public():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return byte_bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(public):
    codec, library = public
    rng = random.Random(5)
    texts = ["", " ", "\n\n  x", "it's WE'LL", "a" * 3000, " " * 900 + "b", "é" * 500, "日本語" * 200, "😀" * 90, "<|endoftext|>", "\x00\x7f"]
    texts += ["".join(rng.choice("abce tion ñé\n日😀0189!?") for _ in range(rng.randrange(400))) for _ in range(300)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_the_two_trees_agree(public):
    codec, _ = public
    rng = random.Random(6)
    pieces = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 60))).encode() for _ in range(300)]
    ids, counts = codec.merge_many(pieces)
    at = 0
    for piece, n in zip(pieces, counts, strict=True):
        assert ids[at : at + n] == codec.merge_one(piece)
        at += n


def test_bpe_of_very_long_matches_and_clashing_columns(spark, public):
    _, library = public
    texts = ["a" * 20_000, "é" * 9_000 + " " * 5_000, "0123456789" * 1_000, "x" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0))
    got = {r.doc_id: r for r in byte_bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()}
    for k, text in enumerate(texts):
        ids = library.encode_ordinary(text)
        assert got[k].n_tokens == len(ids) and got[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_over_rows(spark, public):
    codec, library = public
    docs = spark.createDataFrame([(1, "Hello, world"), (2, None), (2, ""), (None, "x " * 2000)], DOCS)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    got = sorted(map(tuple, byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    want = []
    for i, t in [(1, "Hello, world"), (2, ""), (2, ""), (None, "x " * 2000)]:
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), digest(",".join(map(str, ids)).encode()), digest(t.encode())))
    assert got == sorted(want, key=repr)
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    back = {(r.doc_id, bytes(r.content)) for r in byte_bpe.decode(encoded, RANKS).collect()}
    assert back == {(1, b"Hello, world"), (2, b""), (None, b"x " * 2000)}
    assert byte_bpe.token_counts(encoded).agg({"n": "sum"}).first()[0] == sum(w[1] for w in want)


def test_windows_of_many_items_are_met_once(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(k, f"x{k} {text} y") for k in range(20)], DOCS)
    hits = {}
    for m in (10, 40):
        items = spark.createDataFrame([(k, text) for k in range(m)] + [(100, " ".join(text.split()[:15])), (None, text)], "item_id long, text string")
        _, found, sets = decontaminate.contaminated_spans(docs, items)
        hits[m] = found.count()
        assert sets.count() <= m + (m + 1)
        got = decontaminate.decontaminate(docs, items).collect()
        assert {(r.n_words, r.n_hit, r.contaminated) for r in got} == {(32, 30, True)}
        assert {tuple(r.item_ids) for r in got} == {tuple(sorted([*map(str, range(m)), "100"]))}
    assert hits[10] == hits[40] == 20 * 21


def test_items_without_ids_and_very_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BATCH", 7)
    rng = random.Random(4)
    long_item = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    items = spark.createDataFrame([(None, "one two three"), (5, " ".join(long_item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "zero one two three four"), (2, " ".join(long_item[1000:1012])), (3, " ".join(long_item[1000:1009])), (4, " ".join(long_item))], DOCS)
    got = {r.doc_id: (r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {1: (3, [], True), 2: (12, ["5"], True), 3: (0, [], False), 4: (3000, ["5"], True)}
