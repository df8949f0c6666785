"""Toxicity, search, HTML, WARC, licences and quotations."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bm25, html_extract, licenses, quotes, toxicity, warc

DOCS = "doc_id long, text string"


def toxic_corpus(n=900):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(500)}"
    docs, labels = [], []
    for i in range(n):
        bad = i % 8 == 0
        ws = [word() for _ in range(rng.choice([6, 30, 200]))]
        for _ in range(3 if bad else 0):
            ws.insert(rng.randrange(len(ws) + 1), rng.choice(["VILE", "rotten###", "foulmouth" + rng.choice("abcdefgh"), "nasty."]))
        docs.append((i, " ".join(ws)))
        if i % 2 == 0 or rng.random() < 0.3:
            labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_the_test_fold(spark):
    docs, labels = toxic_corpus()
    extra = [(10_000, None), (10_001, ""), (10_002, "x" * 300_000), (None, "vile rotten nasty")]
    got = toxicity.classify(spark.createDataFrame(docs + extra, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == len(docs) + len(extra)
    for i, _ in docs:
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= rows[i].score <= 1 and rows[i].predicted == int(rows[i].score >= 0.7)
    test = [i for i, _ in docs if rows[i].held_out]
    right = [rows[i].predicted == int(i % 8 == 0) for i in test]
    assert sum(right) / len(right) > 0.97
    assert rows[10_000].score == rows[10_001].score < 0.7 and rows[None].predicted == 1


def test_held_out_labels_do_not_matter(spark):
    docs, labels = toxic_corpus(400)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1}
    flipped = [(i, 1 - t if i in held else t) for i, t in labels]
    df = spark.createDataFrame(docs, DOCS)
    a, b = ([tuple(r) for r in toxicity.classify(df, spark.createDataFrame(x, "doc_id long, toxic int")).orderBy("doc_id").collect()] for x in (labels, flipped))
    assert a == b


def test_a_handful_of_labels_does_not_make_every_text_toxic(spark):
    docs = [(k, f"plain words number {k}") for k in range(15)] + [(100, ""), (101, None)]
    labels = [(k, int(k < 5)) for k in range(15)]
    got = toxicity.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 17 and not any(r.predicted for r in got) and len({r.score for r in got}) == 1


def test_rows_that_share_an_id_are_fitted_as_one(spark, monkeypatch):
    docs, labels = toxic_corpus(300)
    docs += [(0, f"VILE nasty. copy {k}") for k in range(2000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("toxic", F.lit("clash")).withColumn("kind", F.lit(1)).repartition(3)
    seen = []
    monkeypatch.setattr(toxicity, "cross_fitted", lambda pos, unl, *rest: seen.append((len(pos), len(unl))) or (np.zeros(rest[0]), 0.0))
    got = toxicity.classify(df, spark.createDataFrame(labels + labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    toxicity.train_on_labels(df, spark.createDataFrame(labels, "doc_id long, toxic int"), max_positives=20, max_unlabelled=80)
    assert seen[0][0] <= sum(t for _, t in labels) and seen[0][1] <= 300 and seen[1] == (20, 80)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = toxicity.classify(spark.createDataFrame([(1, "a"), (2, None)], DOCS), none).collect()
    assert len(some) == 2 and all(r.predicted == 0 for r in some)
    assert toxicity.classify(spark.createDataFrame([], DOCS), none).collect() == []


def test_risk_is_clipped_at_zero():
    pos, unl = [np.array([0])] * 50, [np.array([0])] * 10 + [np.array([1])] * 90
    w, b = toxicity.fit_nnpu(pos, unl, 2, prior=0.1)
    assert w[0] + b > 1 and w[1] + b < 0 and np.isfinite(w).all()


def test_keep_below_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "good", "en"), (2, "vile", None)], "doc_id long, text string, score string")
    keys = np.sort(toxicity._features(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))[1])
    model = toxicity.Model(keys, np.full(len(keys), 9.0), -3.0)
    assert [tuple(r) for r in toxicity.keep_below(docs, model).collect()] == [(1, "good", "en")]


def brute_bm25(docs, queries, k, k1=1.2, b=0.75):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words = [(i, terms(t)) for i, t in docs]
    df = Counter(w for _, ws in words for w in set(ws))
    mean = sum(len(ws) for _, ws in words) / len(words)
    out = []
    for q, text in queries:
        scored = []
        for i, ws in words:
            tf = Counter(ws)
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ws) / mean)) for w in set(terms(text)) if w in tf)
            if s:
                scored.append((-round(s, 9), i))
        out += [(q, r + 1, i, round(-s, 6)) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard_docs", [10_000, 60])
def test_search_is_exact(spark, shard_docs):
    rng = random.Random(9)
    text = lambda n: " ".join(f"t{int(rng.paretovariate(0.6)) % 300}" for _ in range(n))
    docs = [(i, text(rng.choice([1, 5, 40, 200]))) for i in range(400)] + [(400, None), (401, ""), (402, "t1 T2"), (403, "t1 t2")]
    queries = [d for d in docs if d[0] % 25 == 0] + [(9001, "nowhere"), (9002, None), (9003, "t1")]
    got = bm25.top_k(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(queries, DOCS), k=7, shard_docs=shard_docs)
    assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got.collect()) == brute_bm25(docs, queries, 7)


@pytest.mark.parametrize("k", [1, 10, 3000])
def test_pruned_search_finds_what_whole_scoring_finds(k):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.zipf(1.3, n) % 5000).astype(np.uint64) for n in rng.choice([0, 3, 30, 300, 4000], 2000)]
    sets[700:760] = [sets[5]] * 60  # copies tie
    tf = [rng.integers(1, 9, len(s)).astype(np.uint32) for s in sets]
    tf[700:760] = [tf[5]] * 60
    ids, lengths = rng.permutation(2000), np.array([t.sum() for t in tf], float)
    shard = bm25.Shard(ids, lengths, sets, tf, float(lengths.mean()), 1.2, 0.75)
    idf = 12 / (1 + np.log1p(np.arange(5000)[::-1]))
    whole = [dict(zip(s.tolist(), (t * 2.2 / (t + 1.2 * (0.25 + 0.75 * n / lengths.mean()))).tolist(), strict=True)) for s, t, n in zip(sets, tf, lengths, strict=True)]
    for query in [sets[5], sets[9], sets[11][:4], np.arange(40, dtype=np.uint64), np.array([1, 9999], np.uint64)]:
        weights = idf[query.astype(int) % 5000]
        scores = [sum(w * d.get(t, 0.0) for t, w in zip(query.tolist(), weights.tolist(), strict=True)) for d in whole]
        want = sorted((-round(s, 9), int(i)) for s, i in zip(scores, ids, strict=True) if s > 0)[:k]
        for least in (0.0, -want[-1][0]) if want else (0.0,):
            found, got = shard.search(query, weights, k, least)
            assert found.tolist() == [i for _, i in want]
            assert np.allclose(got, [-s for s, _ in want], rtol=0, atol=1e-8)


def test_near_ties_go_by_the_smaller_id():
    lengths, one = np.ones(4), [np.array([7], np.uint64)] * 4
    shard = bm25.Shard(np.array([4, 3, 2, 1]), lengths, one, [np.array([1], np.uint32)] * 4, 1.0, 1.2, 0.75)
    shard.part = shard.part + np.array([0.0, 1e-11, 3e-11, 9e-11])  # of documents 1 to 4
    shard.own_part = shard.own_part + np.array([0.0, 1e-11, 3e-11, 9e-11])
    found, _ = shard.search(np.array([7], np.uint64), np.array([1.0]), 2)
    assert found.tolist() == [1, 2]


def test_search_of_repeated_long_and_clashing_rows(spark):
    docs = [(1, "a b"), (1, "a b"), (2, "b " * 200_000), (3, "a " + "z" * 100_000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("id", F.lit(9)).withColumn("term", F.lit("a")).withColumn("score", F.lit(0))
    asked = [(1, "a b"), (3, "a " + "z" * 100_000)]
    got = bm25.top_k(df, spark.createDataFrame(asked, DOCS).withColumn("id", F.lit(9)), k=4, shard_docs=2).collect()
    assert sorted((r.query_id, r.rank, r.doc_id, round(r.score, 6)) for r in got) == brute_bm25(docs, asked, 4)


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a"), (None, "a")], DOCS)
    assert bm25.top_k(none, some).collect() == []
    assert bm25.top_k(some, none).collect() == []
    assert [(r.query_id, r.doc_id) for r in bm25.top_k(some, some).collect()] == [(1, 1)]


ARTICLE = "<p>One, two, three: a paragraph that is long enough to earn its points, and more.</p>"

LINE = ARTICLE[3:-4]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("plain words", "plain words"),
        ("<article><h1>T &amp; U</h1><p><b>A&#160;b<br>c<p>d</p></article><footer>x</footer>", "T & U\nA b c\nd"),
        (f"<nav><a href=x>m</a></nav><div class='sidebar'>{ARTICLE}</div><div class='post'>{ARTICLE}<div class='ad'>buy</div></div>", "One, two, three: a paragraph that is long enough to earn its points, and more."),
        (f"<main>{ARTICLE}<section id='comments'>{ARTICLE}</section><form><p>mail</p></form></main>", "One, two, three: a paragraph that is long enough to earn its points, and more."),
        ("<article><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>yes &lt;b&gt;</p></article>", "yes <b>"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one\ntwo\na\nb"),
        ("<article><header><h1>H</h1><p>by me</p></header><p>text</p></article>", "H\ntext"),
        ("<article><p class=notice hidden>n</p><p>kept 1 < 2</article>", "kept 1 < 2"),
        ("<article><p title='a > b'>q</p><p>un<i>bro</i>ken", "q\nunbroken"),
        (f"<div class='main with-sidebar'><div class='main-menu'>m</div><div class='sponsored-content'>{ARTICLE}</div>{ARTICLE}<div id=articleComments>{ARTICLE}</div></div>", LINE),
        (f"<form id=f><div class=wrap>{ARTICLE * 5}</div></form>", "\n".join([LINE] * 5)),
        (f"<body><div id=page-header>x</div><div role=alert>{ARTICLE}</div><div class='post-header'><h2>Head</h2></div><section>{ARTICLE * 2}</section><section>{ARTICLE}</section></body>", f"Head\n{LINE}\n{LINE}\n{LINE}"),
    ],
)
def test_main_text(html, want):
    assert html_extract.main_text(html) == want


def test_broken_markup_is_read_in_linear_time():
    for bad in ("<" * 50_000, "<a " * 20_000, "<p>" * 20_000 + "x", '<a href="' * 5_000, "<!--" * 10_000, "<div>" * 30_000 + "deep, text" + "</div>" * 30_000):
        html_extract.main_text(bad)
        html_extract.plain_text(bad)


@pytest.mark.parametrize("classes", ["layout-with-sidebar", "container sidebar-right", "page-no-nav", "has-banner modal-open"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_wrappers_named_after_what_stands_beside_keep_the_article(classes, tag):
    said = "The harbour was rebuilt, slowly, after the storm had taken most of its walls."
    aside = '<div class="sidebar"><p>Other news, as listed here, of no great length or use.</p></div>'
    html = f'<body><div class="{classes}"><{tag}><p>{said}</p></{tag}>{aside}</div><div class="comments"><article><p>Well said, I think, and so do many others here.</p></article></div></body>'
    assert html_extract.main_text(html) == said


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<body><article><p>First one, here.</p></article><article>{ARTICLE}</article></body>", f"First one, here.\n{LINE}"),
        (f"<body><div>{ARTICLE * 2}</div><p>Short one.</p></body>", f"{LINE}\n{LINE}\nShort one."),
        (f"<article>{ARTICLE}<ul><li><a href=a>x</a><li><a href=b>y</a><li><a href=c>z</a></ul></article>", f"{LINE}\nx\ny\nz"),
        (f"<article><p class=byline>By me</p><section class=social-science>{ARTICLE}</section><div class='ad-hoc'>{ARTICLE}</div></article>", f"By me\n{LINE}\n{LINE}"),
        ("<article><p>Press <button>Go</button> to see <output>5</output> of <math><mi>x</mi></math>.</p><button>Buy</button></article>", "Press Go to see 5 of x."),
        (f"<body>intro <a href=x>text</a> that goes on, and on, for some while<div class=left-sidebar>{ARTICLE}</div><div>{ARTICLE}</div>tail</body>", f"intro text that goes on, and on, for some while\n{LINE}\ntail"),
    ],
)
def test_article_text_is_not_dropped(html, want):
    assert html_extract.main_text(html) == want


def test_pages_without_article_elements_match_their_making():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    line = lambda n: " ".join(word() + ("," if rng.random() < 0.1 else "") for _ in range(n)) + "."
    menu = lambda: "<ul>" + "".join(f"<li><a href='/{word()}'>{word()}</a>" for _ in range(rng.randrange(3, 9))) + "</ul>"
    for _ in range(200):
        said = [line(rng.randrange(3, 8))] + [line(rng.choice([4, 30, 90])) for _ in range(rng.randrange(2, 12))]
        body = f"<h1>{said[0]}</h1>" + "".join(f"<p>{x.replace(' ', rng.choice([' ', chr(10), '  ']))}</p>" for x in said[1:])
        around = [f"<nav>{menu()}</nav>", f"<div class='{rng.choice(['sidebar', 'right-sidebar', 'main-menu'])}'>{menu()}</div>", f"<div class=ad><p>{line(40)}</p></div>", f"<footer>{line(9)}</footer>", f"<form><label>{line(4)}</label><input></form>", f"<div id=comments><p>{line(30)}</p></div>", menu()]
        rng.shuffle(around)
        k = rng.randrange(len(around) + 1)
        wrap = rng.choice(["<div class=content>%s</div>", "<div><div class='post wide'>%s</div></div>", "<main>%s</main>", "<section>%s</section>"])
        html = f"<html><head><title>{line(3)}</title></head><body>{''.join(around[:k])}{wrap % body}{''.join(around[k:])}</body></html>"
        assert html_extract.main_text(html) == "\n".join(said), html


@pytest.mark.parametrize("bad", ["<div><p>word, word, word", "<p><article>", "<header><h1>", "<ul><li>", "<table><tr><td>x", "<form><p>", "<dl><dd>x", "<a>x<div>"])
def test_a_megabyte_of_nested_tags(bad):
    start = time.perf_counter()
    html_extract.main_text(bad * (500_000 // len(bad)))
    assert time.perf_counter() - start < 10  # some tenths of a second; quadratic work takes many minutes


def test_very_long_pages(spark):
    paragraphs = [f"Paragraph {k}, which is long enough to count, and goes on." for k in range(20_000)]
    html = "<body><nav><a href=x>menu</a></nav><article>" + "".join(f"<p>{x}</p>" for x in paragraphs) + "</article></body>"
    (row,) = html_extract.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    assert row.text == "\n".join(paragraphs) and row.n_chars == len(row.text)


def test_extract_rows(spark, rows):
    df = spark.createDataFrame([(1, "u", "<p>é</p>", 0), (1, "u", "<p>é</p>", 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    assert rows(html_extract.extract(df)) == sorted([(1, "u", "é", 1), (1, "u", "é", 1), (None, None, "", 0)], key=repr)
    assert rows(html_extract.extract(df.limit(0))) == []


PAGES = [(1, "http://a/x", "<html><title>t</title><body><p>Hé</p><nav>menu</nav></body></html>"), (2, "http://b/\r\ny", ""), (3, None, None)]


def headers(row):
    return {h["name"]: h["value"] for h in row.headers}


def test_derivatives_refer_to_their_response(spark):
    responses = warc.responses_of(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    source = {r.key: headers(r) for r in responses.collect()}
    made = warc.derive(responses).collect()
    assert sorted((r.key, headers(r)["WARC-Type"]) for r in made) == [(k, t) for k in (1, 2, 3) for t in ("conversion", "metadata")]
    by = {(r.key, headers(r)["WARC-Type"]): r for r in made}
    for r in made:
        h = headers(r)
        assert h["WARC-Refers-To"] == source[r.key]["WARC-Record-ID"]
        assert h["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and int(h["Content-Length"]) == len(r.block)
        for name in ("WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest"):
            assert h[name] == source[r.key][name]
        other = by[(r.key, "metadata" if h["WARC-Type"] == "conversion" else "conversion")]
        assert h["WARC-Concurrent-To"] == headers(other)["WARC-Record-ID"]
    assert bytes(by[(1, "conversion")].block).decode() == "Hé\nmenu"
    assert len({headers(r)["WARC-Record-ID"] for r in made}) == len(made)


def test_files_round_trip(spark, tmp_path):
    blocks = [(1, b"\x00\xff\r\n\r\nWARC/1.1"), (2, b""), (3, "é".encode())]
    records = spark.createDataFrame([(k, [("WARC-Type", "resource"), ("WARC-Record-ID", f"<{k}>"), ("Content-Length", str(len(b)))], bytearray(b)) for k, b in blocks], warc.RECORD)
    for how in ("gzip", "none"):
        path = str(tmp_path / how)
        warc.write(records, path, how)
        got = {headers(r)["WARC-Record-ID"]: bytes(r.block) for r in warc.read(spark, path).collect()}
        assert got == {f"<{k}>": b for k, b in blocks}
    assert warc.derive(records).collect() == []


def test_one_member_for_each_record(spark, tmp_path):
    records = spark.createDataFrame([(k, [("WARC-Type", "resource"), ("Content-Length", "3")], bytearray(b"abc")) for k in range(5)], warc.RECORD)
    warc.write(records.coalesce(1), str(tmp_path / "w"))
    (file,) = (tmp_path / "w").glob("*.warc.gz")
    raw, sizes = file.read_bytes(), []
    while raw:
        member = zlib.decompressobj(31)
        sizes.append(len(member.decompress(raw)))
        raw = member.unused_data
    assert len([n for n in sizes if n]) == 5 and len(set(sizes)) == 2
    got = warc.read(spark, str(tmp_path / "w")).collect()
    assert sorted(r.key for r in got) == list(range(5)) and {r.path for r in got} == {f"file:{file}"}


def test_large_files_are_split_and_streamed(spark, tmp_path):
    rng = random.Random(41)
    blocks = [rng.choice([b"WARC/1.1\r\n", b"WARC/", b"x", b"\r\n\r\n"]) * rng.randrange(1, 3000) for _ in range(300)]
    records = spark.createDataFrame([(k, [("WARC-Type", "resource"), ("WARC-Target-URI", f"http://a/WARC/1/{k}"), ("Content-Length", str(len(b)))], bytearray(b)) for k, b in enumerate(blocks)], warc.RECORD)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        for how in ("none", "gzip"):
            warc.write(records.coalesce(1).sortWithinPartitions("key"), str(tmp_path / how), how)
            (tmp_path / how / "broken.warc").write_bytes(b"junk WARC/1.0\r\nContent-Length: x\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\nshort")
            got = sorted(warc.read(spark, str(tmp_path / how)).collect(), key=lambda r: r.key)
            assert [bytes(r.block) for r in got] == blocks and [headers(r)["WARC-Target-URI"][16:] for r in got] == [str(k) for k in range(300)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


class Visible(HTMLParser):
    """The text of a page, block by block: a builder of its own."""

    def __init__(self):
        super().__init__()
        self.out, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        self.out[-1] += " " if tag == "br" else ""
        if tag in "p div ul li nav article footer h1 body".split():
            self.out.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")
        if tag in "p div ul li nav article footer h1 body".split():
            self.out.append("")

    def handle_data(self, data):
        if not self.skip:
            self.out[-1] += data


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_derivatives_match_an_independent_builder(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html", F.lit("clash").alias("key"), F.lit(1).alias("block"))
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = []
    for r in pages.collect():
        body = r.html.encode()
        page = Visible()
        page.feed(r.html)
        text = "\n".join(x for x in (" ".join(line.split()) for line in page.out) if x).encode()
        response = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
        want.append((r.page_id, "conversion", r.url, sha1(body), sha1(text), len(text), hashlib.sha256(text).hexdigest()))
        about = [("http-status", "HTTP/1.1 200 OK"), ("http-content-type", "text/html; charset=utf-8"), ("http-content-length", len(body)), ("source-block-digest", sha1(response)), ("source-length", len(response)), ("payload-length", len(body)), ("conversion-id", None), ("conversion-length", len(text)), ("conversion-digest", sha1(text))]
        want.append((r.page_id, "metadata", r.url, sha1(body), about))
    derived = warc.derive(warc.responses_of(pages)).collect()
    ids = {(r.key, headers(r)["WARC-Type"]): headers(r)["WARC-Record-ID"] for r in derived}
    got = []
    for r in derived:
        h = headers(r)
        common = (r.key, h["WARC-Type"], h["WARC-Target-URI"], h["WARC-Payload-Digest"])
        assert h["WARC-Block-Digest"] == sha1(bytes(r.block)) and h["Content-Length"] == str(len(r.block))
        if h["WARC-Type"] == "conversion":
            got.append((*common, h["WARC-Block-Digest"], len(r.block), hashlib.sha256(bytes(r.block)).hexdigest()))
        else:
            fields = [tuple(x.split(": ", 1)) for x in bytes(r.block).decode().split("\r\n")[:-1]]
            assert dict(fields)["conversion-id"] == ids[(r.key, "conversion")]
            got.append((*common, [(k, None if k == "conversion-id" else int(v) if k.endswith("length") else v) for k, v in fields]))
    assert sorted(got, key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2]) and len(got) == len(set(ids)) == 2 * pages.count()


def test_warc_edge_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses_of(none)).collect() == []
    twice = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>" + "long " * 300_000)], "page_id long, url string, html string")
    made = warc.derive(warc.responses_of(twice)).collect()
    assert len(made) == 6 and len({headers(r)["WARC-Record-ID"] for r in made}) == 4
    assert max(len(r.block) for r in made) == 5 * 300_000 - 1
    assert len(warc.derive(spark.createDataFrame([(1, None, None), (2, [("WARC-Type", "response")], None)], warc.RECORD)).collect()) == 2


def test_http_bodies():
    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Type: text/plain\r\n\r\n3\r\nabc\r\n2;x\r\nde\r\n0\r\n\r\n"
    assert warc.split_http(body)[2] == b"abcde"
    (meta,) = warc._derive(1, [("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG")
    assert ("WARC-Type", "metadata") in meta[1] and "WARC-Concurrent-To" not in dict(meta[1])


def brute_cosine(text, template, df, n):
    words = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()))
    known = set().union(*(words(t) for _, t in licenses.TEMPLATES))
    weigh = lambda c: {w: tf * (math.log((n + 1) / ((df[w] if w in known else 0) + 1)) + 1) for w, tf in c.items()}
    a, b = weigh(words(text)), weigh(words(template))
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b)) if a and b else 0.0


def test_licences_match_brute_force(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(["the", "of", "a", "lorem", "ipsum", "version", "work"]) for _ in range(12))
    texts = []
    for i in range(120):
        lines = [filler() for _ in range(rng.randrange(6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(licenses.TEMPLATES)[1])
        if i % 9 == 0:
            lines.append("# Licensed under the Apache License (Version 2.0)")
        texts.append((i, "\n".join(lines)))
    texts += [(200, None), (201, ""), (202, "\n\n")]
    df = Counter(w for _, t in texts for w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())))
    got = {r.key: r for r in licenses.own_licences(spark.createDataFrame(texts, DOCS).repartition(3)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in texts:
        lines, runs = (t or "").split("\n"), []
        for k, line in enumerate(lines):
            if word.search(line.lower()):
                runs.append([k]) if not runs or runs[-1][-1] < k - 1 else runs[-1].append(k)
        units = [(0, k, x) for k, x in enumerate(lines)] + [(1, r[0], "\n".join(lines[k] for k in r)) for r in runs if len(r) > 1] + [(2, None, t or "")]
        ranked = []
        for kind, k, u in units:
            has = set(word.findall(u.lower()))
            for tid, (name, tpl) in enumerate(licenses.TEMPLATES):
                if all(has & set(ws) for of, ws in licenses.needs(licenses.TEMPLATES) if of == tid):
                    ranked.append((-round(brute_cosine(u, tpl, df, len(texts)), 9), kind, k or 0, tid, name, k))
        best = min(ranked)
        if -best[0] >= 0.6:
            assert (got[i].own_license, got[i].in_line) == best[4:] and got[i].own_score == pytest.approx(-best[0]), (i, t)
        else:
            assert got[i].own_license is None


def wrapped(text, width, mark=" * "):
    out = [""]
    for w in text.split():
        if len(out[-1]) + len(w) >= width:
            out.append("")
        out[-1] += f" {w}" if out[-1] else w
    return "\n".join(mark + x for x in out)


@pytest.mark.parametrize("n", [1_000, 100_000])
@pytest.mark.parametrize("share", [0.0, 0.01, 0.3])
def test_near_licences_are_told_apart(n, share):
    owner = "Copyright (C) 2024 Some Person." if share < 0.3 else ""
    gpl = owner + " This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."
    bsd = licenses._BSD
    notices = {
        "GPL-2.0": gpl.format("General Public License", 2),
        "GPL-3.0": gpl.format("General Public License", 3).replace("software;", "software:"),
        "AGPL-3.0": gpl.format("Affero General Public License", 3),
        "LGPL-2.1": gpl.format("Lesser General Public License", "2.1").replace("program", "library"),
        "BSD-2-Clause": f"{owner}\n{bsd}",
        "BSD-3-Clause": f"{owner}\n{bsd} 3. {licenses._BSD3}",
        "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    }
    words = {w for _, t in licenses.TEMPLATES for w in licenses._hashes(t).view(np.int64).tolist()}
    matcher = licenses.Matcher(licenses.TEMPLATES, dict.fromkeys(words, int(share * n)), n, 0.6)
    code = "\n".join(f"value_{k} = compute_{k}(argument_{k}) + offset_{k % 7}" for k in range(60))
    for name, text in notices.items():
        for width in (40, 72, 10**6):
            raw = f"{code}\n/*\n{wrapped(text, width)}\n */\n{code}".encode()
            best, found, place = matcher.best(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            assert licenses.TEMPLATES[found[0]][0] == name and best[0] >= 0.6 and place[0] >= 61, (name, width, share, best)
    versionless = "This work is licensed under the GNU General Public License.".encode()
    best, found, _ = matcher.best(np.frombuffer(versionless, np.uint8), np.array([0, len(versionless)]))
    assert found[0] < 0 or best[0] < 0.6 or not licenses.TEMPLATES[found[0]][0].startswith("GPL")


def test_licences_of_awkward_files(spark):
    mit = "Released under the MIT License."
    files = [("a/LICENSE", mit), ("a/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/x", "word " * 200_000 + "\n" + mit), ("a/y", ""), ("a/y", "")]
    df = spark.createDataFrame(files, "path string, text string").withColumn("key", F.lit("clash")).withColumn("dir", F.lit(1)).withColumn("license", F.lit("none"))
    got = sorted((r.path, r.license, r.license_from, r.in_line) for r in licenses.scan(df).collect())
    assert got == [("a/COPYING", "GPL-3.0", "a/COPYING", 0), ("a/LICENSE", "MIT", "a/LICENSE", 0), ("a/x", "MIT", "a/x", 1), ("a/y", "GPL-3.0", "a", None), ("a/y", "GPL-3.0", "a", None)]


def test_licences_are_inherited_from_the_nearest_directory(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [("LICENSE", mit), ("a/x.py", "code"), ("a/b/COPYING", gpl), ("a/b/c/y.py", None), ("a/b/z.py", mit), ("ab/w.py", ""), ("a/b/c/y.py", None), (None, "q"), ("a/LICENSE.txt", "no licence at all")]
    got = licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()
    assert len(got) == len(files)
    by = {r.path: (r.license, r.license_from) for r in got}
    assert by["a/x.py"] == ("MIT", "") and by["ab/w.py"] == ("MIT", "") and by["LICENSE"] == ("MIT", "LICENSE")
    assert by["a/b/c/y.py"] == ("GPL-3.0", "a/b") and by["a/b/z.py"] == ("MIT", "a/b/z.py") and by[None] == (None, None)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).collect() == []


CHAT = "conv_id long, turn long, role string, text string"


def test_quotations(spark):
    rows = [
        (1, 0, "a", "Where is the Station?\nI am lost."),
        (1, 1, "b", "Which city, please?"),
        (1, 2, "c", "On Monday a wrote:\n> Where is the station?\n> I am lost.\nNext to the park."),
        (1, 3, "a", "c wrote:\n> b wrote:\n>> Which city,  please\n> is what I ask\nBerlin."),
        (1, 4, "d", "Thanks."),
        (1, 5, "e", "> Which city, please?\nYes, which?"),
        (1, 6, "f", "> never said\nHm."),
        (2, 0, "a", "> Which city, please?\nother conversation"),
        (2, 1, "a", None),
        (2, 1, "a", None),
        (None, 3, "x", "> a\nb"),
        (3, None, "x", "c"),
    ]
    df = spark.createDataFrame(rows, CHAT).withColumn("own", F.lit(1)).withColumn("h", F.lit("clash")).repartition(3)
    got = quotes.threads(df).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[(1, 2)].own_text == "Next to the park." and by[(1, 2)].reply_to == 0 and by[(1, 2)].n_linked == 1
    assert by[(1, 3)].own_text.endswith("Berlin.")
    assert by[(1, 3)].n_quotes == 3 and by[(1, 3)].n_linked == 1 and by[(1, 3)].reply_to == 2
    assert by[(1, 4)].reply_to == 3 and by[(1, 5)].reply_to == 1 and by[(1, 6)].reply_to == 5
    assert by[(1, 0)].reply_to is None and by[(2, 1)].own_text == "" and by[(2, 1)].reply_to == 0
    assert by[(2, 0)].n_linked == 0 and by[(None, 3)].own_text == "b" and by[(3, None)].reply_path == []
    order = [r.turn for r in quotes.ordered(quotes.threads(df.where("conv_id = 1"))).collect()]
    assert order == [0, 2, 3, 4, 1, 5, 6]
    linked = {(r.conv_id, r.turn, r.depth): r.source for r in quotes.linked_passages(df).where("source is not null").collect()}
    assert linked == {(1, 2, 1): 0, (1, 3, 2): 1, (1, 5, 1): 1}


def test_long_conversations_span_buckets(spark):
    rows = [(1, t, "u", f"message {t}" if t % 700 else f"> message {t // 2 + 1}\nanswer {t}") for t in range(1, 2000)]
    got = {r.turn: r for r in quotes.threads(spark.createDataFrame(rows, CHAT)).collect()}
    assert all(got[t].reply_to == (t // 2 + 1 if t % 700 == 0 else t - 1) for t in range(2, 2000))
    assert got[1999].reply_path[-1] == 1999 and got[701].reply_path == [351, 700, 701]
    assert quotes.threads(spark.createDataFrame([], CHAT)).collect() == []


def test_recurring_lines_do_not_hide_the_source(spark):
    rows = [(1, 1, "a", "Hi all,\n\nThe build is broken.\n\nRegards"), (1, 2, "b", "Hi all,\n\nLunch?"), (1, 3, "c", "> Hi all,\n>\n> The build is broken.\nFixed.")]
    got = {r.turn: r for r in quotes.threads(spark.createDataFrame(rows, CHAT)).collect()}
    assert got[3].n_linked == 1 and got[3].reply_to == 1


def test_a_passage_needs_most_of_its_lines(spark):
    rows = [(1, 1, "a", "Yes"), (1, 2, "b", "Yes\nI see"), (1, 3, "c", "> Yes\n> one\n> two\n> three\nno"), (1, 4, "d", "> Yes\n> I see\n> three\nso")]
    got = {r.turn: (r.n_quotes, r.n_linked, r.reply_to) for r in quotes.threads(spark.createDataFrame(rows, CHAT)).collect()}
    assert got[3] == (1, 0, 2) and got[4] == (1, 1, 2)


def test_a_line_common_to_a_long_conversation(spark):
    rows = [(1, t, "u", f"+1\nown {t}") for t in range(1500)] + [(1, t, "u", f"> +1\n> own {t // 3}\n") for t in range(1500, 2200)]
    got = {r.turn: r for r in quotes.threads(spark.createDataFrame(rows, CHAT).repartition(3)).collect()}
    assert all(got[t].reply_to == t // 3 and got[t].reply_path[-1] == t for t in range(1500, 2200))
    long = "\n".join(f"line {k} of a very long message" for k in range(5000))
    huge = [(2, 1, "a", long), (2, 2, "b", "short"), (2, 3, "c", "\n".join("> " + x for x in long.split("\n")) + "\nagreed")]
    got = {r.turn: r for r in quotes.threads(spark.createDataFrame(huge, CHAT)).collect()}
    assert got[3].reply_to == 1 and got[3].own_text == "agreed"


def test_sources_equal_counting_every_earlier_turn(spark):
    rng = random.Random(13)
    words = [f"line {c}" for c in "abcdefgh"]
    rows, want = [], {}
    for conv in range(12):
        for turn in range(30):
            own = [rng.choice(words) for _ in range(rng.randrange(1, 6))]
            asked = [rng.choice(words[: 8 if conv % 2 else 4]) for _ in range(rng.randrange(0, 6))]
            rows.append((conv, turn, "u", "\n".join([*(f"> {x}" for x in asked), *own])))
            if asked:
                earlier = {r[1]: [x for x in r[3].split("\n") if not x.startswith(">")] for r in rows if r[0] == conv and r[1] < turn}
                whole = [t for t, ls in earlier.items() if " ".join(asked) in {*ls, " ".join(ls)}]
                counts = [(sum(x in ls for x in asked), t) for t, ls in earlier.items()]
                most = max(counts, default=(0, None))
                want[(conv, turn)] = max(whole) if whole else most[1] if most[0] * 2 > len(asked) else None
    got = quotes.linked_passages(spark.createDataFrame(rows, CHAT).repartition(3)).collect()
    assert {(r.conv_id, r.turn): r.source for r in got} == want


def test_no_python_on_the_quotation_path(spark):
    plan = quotes.digests(quotes.threads(spark.createDataFrame([(1, 0, "a", "> x\ny")], CHAT)))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


_TEXT = "The committee met on Tuesday, and after a long debate, it agreed to publish the whole report without any changes."
_MORE = "Members said that the figures, which had been checked twice, would be open to everyone, and that the talks would go on."


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # reader comments, by name and by structure
        (f"<article><h1>T</h1><p>{_TEXT}</p><div class='user-comments'><p>{_MORE}</p></div></article>", f"T\n{_TEXT}"),
        (f"<article><p>{_TEXT}</p><section id='comment-thread'><article><p>{_MORE}</p></article></section></article>", _TEXT),
        (f"<div class='x'><p>{_TEXT}</p></div><ol class='responses'><li>{_MORE}</li><li>{_MORE}</li></ol>", _TEXT),
        (f"<article><p>{_TEXT}</p><h2>Comments</h2><ul><li>{_MORE}</li></ul></article>", _TEXT),
        (f"<article><p>{_TEXT}</p><h2>12 Comments</h2><ul><li>{_MORE}</li></ul><h2>Next part</h2><p>{_MORE}</p></article>", f"{_TEXT}\nNext part\n{_MORE}"),
        (f"<article><h2>Comments</h2><p>{_TEXT}</p></article>", f"Comments\n{_TEXT}"),
        (f"<div class='post comments-open'><p>{_TEXT}</p></div>", _TEXT),
        # adverts and menus
        (f"<article><p>{_TEXT}</p><div class='ad_300x250'><p>{_MORE}</p></div><div id='google_ads_1'>{_MORE}</div></article>", _TEXT),
        (f"<main><ul class='crumbs'><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><h1>T</h1><p>{_TEXT}</p></main>", f"T\n{_TEXT}"),
        (f"<main><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><h1>T</h1><p>{_TEXT}</p><ul><li><a href='/s'>Source</a></li></ul></main>", f"T\n{_TEXT}\nSource"),
        # whole articles
        (f"<div class='body'><div class='sec'><p>{_TEXT}</p><p>{_MORE}</p></div><div class='sec'><p>Short end.</p></div></div>", f"{_TEXT}\n{_MORE}\nShort end."),
        (f"<article><header><h1>T</h1><p class='byline'>By A Writer of the paper, in the city of somewhere</p><p>{_MORE}</p><ul><li><a href='/'>Share</a></li></ul></header><p>{_TEXT}</p></article>", f"T\n{_MORE}\n{_TEXT}"),
        # references end with their text node
        (f"<article><p>{_TEXT} 5 &l<b></b>t; 6 &amp;<i>lt;</i></p></article>", f"{_TEXT} 5 &lt; 6 &lt;"),
    ],
)
def test_what_is_the_article(html, want):
    for page in (html, f"<html><body><nav><a href='/'>x</a></nav>{html}<footer>f</footer></body></html>"):
        assert html_extract.main_text(page) == want


def test_every_border_of_a_file_is_mended_alone(spark, tmp_path):
    rng = random.Random(8)
    made, raw = [], b""
    for k in range(120):
        block = rng.choice([b"x WARC/1.0 y ", b"plain "]) * rng.choice([1, 40, 900])
        made.append((f"<urn:{k}>", block))
        raw += f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(raw)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = warc.read(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in ("a.warc", "b.warc"):
        mine = sorted((r for r in found if r.path.endswith(name)), key=lambda r: r.key)
        assert [(dict(map(tuple, r.headers))["WARC-Record-ID"], bytes(r.block)) for r in mine] == made


def test_queries_start_in_several_shards(spark, rows, monkeypatch):
    rng = random.Random(12)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(rng.randrange(1, 25)))) for k in range(150)], "doc_id long, text string").repartition(3)
    queries = docs.where("doc_id % 3 = 0")
    tables, made = [], bm25.scratch.table
    monkeypatch.setattr(bm25.scratch, "table", lambda df: tables.append(df) or made(df))
    rounded = lambda df: rows(df.withColumn("score", F.round("score", 9)))
    want = rounded(bm25.top_k(docs, queries, k=4))
    tables.clear()
    assert rounded(bm25.top_k(docs, queries, k=4, shard_docs=3)) == want
    begun = next(t for t in tables if t.columns == ["query_id", "doc_id", "score"])
    held = begun.groupBy(F.spark_partition_id()).agg(F.count_distinct("query_id").alias("n")).collect()
    assert len(held) > 1 and sum(r.n for r in held) < len(held) * queries.count()


def test_each_shard_is_searched_by_a_task_of_its_own(spark, rows, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 11} w{k % 13}") for k in range(120)], "doc_id long, text string")
    tables, made = [], bm25.scratch.table
    monkeypatch.setattr(bm25.scratch, "table", lambda df: tables.append(df) or made(df))
    found = rows(bm25.top_k(docs, docs.where("doc_id % 10 = 0"), k=3, shard_docs=5))
    begun = next(t for t in tables if t.columns == ["query_id", "doc_id", "score"])
    of_shard = F.pmod(F.xxhash64("doc_id"), F.lit(24))  # of 120 documents by 5
    held = begun.groupBy(F.spark_partition_id()).agg(F.count_distinct(of_shard).alias("n")).collect()
    assert len(held) == 10 and all(r.n == 1 for r in held)  # twice the root of 24
    monkeypatch.undo()
    assert found == rows(bm25.top_k(docs, docs.where("doc_id % 10 = 0"), k=3))


@pytest.mark.parametrize("bytes_held", [1 << 25, 1 << 10])
def test_copies_of_queries_are_not_as_many_as_shards(spark, rows, monkeypatch, bytes_held):
    rng = random.Random(15)
    docs = spark.createDataFrame([(k, " ".join(f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(rng.randrange(1, 20)))) for k in range(400)], "doc_id long, text string").repartition(3)
    queries = docs.where("doc_id % 10 = 0")
    rounded = lambda df: rows(df.withColumn("score", F.round("score", 9)))
    want = rounded(bm25.top_k(docs, queries, k=4))
    dealt, deal = [], type(docs).repartitionById
    monkeypatch.setattr(type(docs), "repartitionById", lambda self, n, *by: dealt.append((self, n)) or deal(self, n, *by))
    monkeypatch.setattr(bm25, "QUERY_BYTES", bytes_held, raising=False)
    assert rounded(bm25.top_k(docs, queries, k=4, shard_docs=2)) == want
    waves = len(dealt) // 2
    assert (waves > 1) == (bytes_held < 1 << 25)
    at_once = [df.count() for df, _ in dealt[1::2]]  # 200 shards, of which the first step asks 15 for each query
    assert sum(at_once) <= waves * 400 + 8 * 40 and all(n <= 8 for _, n in dealt[1::2])  # tasks: twice the four cores


def test_queries_together_open_only_blocks_of_their_kind():
    rng = np.random.default_rng(6)
    sets = [np.unique(5000 * (i % 4) + rng.zipf(1.2, 120) % 400).astype(np.uint64) for i in range(1600)]
    tf = [rng.integers(1, 4, len(s)).astype(np.uint32) for s in sets]
    lengths = np.array([t.sum() for t in tf], float)
    shard = bm25.Shard(rng.permutation(1600), lengths, sets, tf, float(lengths.mean()), 1.2, 0.75)
    queries = [(sets[i], 1 + rng.random(len(sets[i]))) for i in rng.integers(0, 1600, 300)]
    opened, packed = [], shard.packed
    shard.packed = type("Counted", (list,), {"__getitem__": lambda self, j: opened.append(j) or list.__getitem__(self, j)})(packed)
    shard.search_all([q for q in queries if q[0][0] < 5000], 5, np.zeros(300))
    shard.packed = packed
    assert 0 < len(set(opened)) <= shard.blocks / 2  # a quarter of the documents has a term of these
    for least in (np.zeros(len(queries)), rng.uniform(0, 60, len(queries))):
        together = shard.search_all(queries, 5, least)
        for (terms, weights), low, (ids, scores) in zip(queries, least, together, strict=True):
            whole = [(-round(float(s), 9), int(i)) for i, s in zip(shard.ids, _whole(shard, terms, weights), strict=True) if s > 0 and s >= low]
            assert ids.tolist() == [i for _, i in sorted(whole)[:5]] and np.allclose(scores, [-s for s, _ in sorted(whole)[:5]], rtol=0, atol=1e-8)


def _whole(shard, terms, weights):
    """The score of each document of a shard, from its own terms."""
    by = dict(zip(terms.tolist(), weights.tolist(), strict=True))
    of = np.array([by.get(t, 0.0) for t in shard.terms.tolist()])
    return [of[shard.own_term[lo:hi]] @ shard.own_part[lo:hi] for lo, hi in zip(shard.own_from, shard.own_to, strict=True)]
