"""The registered queries against their SQL, and the pipeline stage by stage."""

import random
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from lodestack.llm import oracle_more, queries, quotes
from lodestack.sources import staging

DATA = Path("/root/testdata/sf0.001")


def shaped(df):
    return sorted(tuple("null" if x is None or x is pd.NA or x is pd.NaT or x != x else str(int(x) if isinstance(x, float) and x == int(x) else x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sql, name):
    assert shaped(queries.QUERIES[name](spark, str(DATA)).toPandas()) == shaped(sql.sql(queries.SQL[name]).df())


def test_quotations_equal_their_sql(spark):
    rng = random.Random(11)
    rows, said = [], {}
    for conv in range(6):
        for turn in range(25):
            own = " ".join(rng.choice(["Yes", "no,", "maybe", "it", "is"]) for _ in range(rng.randrange(1, 5)))
            text = own if rng.random() < 0.3 else f"{own}\n{own[::-1]}"
            before = [t for (c, t) in said if c == conv]
            if before and rng.random() < 0.6:
                source = rng.choice(before)
                lines = [f"> {x}" for x in said[(conv, source)].split("\n")][: rng.randrange(1, 4)]
                text = "\n".join([*(["On Friday someone wrote:"] if rng.random() < 0.5 else []), *lines, text])
            said[(conv, turn)] = text
            rows.append((conv, turn, "user", text))
    rows += [(6, 0, "user", None), (6, 1, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    got = quotes.digests(quotes.threads(df.repartition(3))).toPandas()
    assert shaped(got) == shaped(con.sql(oracle_more.quotation_sql()).df())
    assert got.n_linked.sum() > 20 and got.reply_path.str.count(r"\.").max() > 3


def written(root):
    return [p for p in Path(root).rglob("*.parquet") if p.is_file()]


def test_pipeline_of_awkward_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(staging, "folder", lambda _: str(tmp_path / "shared"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept_id long, gone string, owner int"
    rest = ("en", "s", 0, "c", 1, "g", 2)
    rng = random.Random(14)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    base, item, passage = text(120), text(12), text(60)
    docs = [(i, text(80), *rest) for i in range(30)]
    docs += [(None, base, *rest), (None, base + " more", *rest), (None, text(50), *rest), (None, f"{text(20)} {item} {text(9)}", *rest), (None, None, *rest), (None, "", *rest)]
    docs += [(40, text(90), *rest), (40, text(70), *rest), (41, f"{passage} {text(30)}", *rest), (None, f"{text(30)} {passage}", *rest)]
    folder = tmp_path / "data"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(folder)).collect()
    ids = Counter(r.doc_id for r in got)
    assert all(ids[i] == 1 for i in range(30)) and ids[40] == 2 and ids[41] == 1
    assert ids[None] == 5  # one of the two near copies, the other text, the two empty ones and what is left beside the passage
    none = folder.parent / "none"
    spark.createDataFrame([], schema).write.parquet(str(none / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(str(folder / f"{name}.parquet")).limit(0).write.parquet(str(none / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(none)).collect() == []
    left = {p.relative_to(tmp_path / "shared").parts[:2] for p in written(tmp_path / "shared")}
    assert {kind for kind, _ in left} == {"pipeline"} and len(left) == 2  # the last stage's input of each run, until the program ends


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage, item, base = text(60), text(12), text(150)
    docs = [(i, text(80), "en", "s", 0) for i in range(200)]
    docs += [(200, base, "en", "s", 0), (201, base + " " + text(3), "en", "s", 0), (202, base, None, None, 0)]
    docs += [(300, f"{text(30)} {passage} {text(30)}", "en", "s", 0), (301, f"{text(40)}\n{passage}\n{text(40)}", "de", "t", 0)]
    docs += [(400, f"{text(40)} {item.upper()} {text(9)}", "en", "s", 0), (500, None, "en", "s", 0), (501, "", "en", "s", 0)]
    docs += [(600 + i, f"{text(20)} awful{i % 4} {text(20)} awful{(i + 1) % 4}", "en", "s", 0) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 0, int(i >= 600)) for i, *_ in docs if i < 200 or i >= 600], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append({r[0] for r in now.select("doc_id").collect()})
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "token_ids"]
    everything = {d[0] for d in docs}
    assert kept[0] == {i for i in everything if i < 600}
    assert kept[1] == kept[0] - {201, 202} and kept[2] == kept[1] and kept[3] == kept[2] - {400} == kept[4]
    cut = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "repeated_passages")).collect()}
    assert passage in cut[300].text and passage.split()[30] not in cut[301].text and cut[301].lang == "de" and cut[301].n_chars == len(cut[301].text)
    assert cut[0].text == docs[0][1]
    tokens = {r.doc_id: r for r in now.collect()}
    assert tokens[500].n_tokens == 0 and tokens[0].n_tokens == len(tokens[0].ids) > 80
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in tokens.values())
