"""The registered queries against their SQL on the smallest tables, and the pipeline."""

from __future__ import annotations

import os

import duckdb
import pytest

import corpus_pipeline
from rungfleet.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _text(v) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted("|".join(map(_text, r)) for r in df.select(*cols).collect())
    want = con.sql(f"select {', '.join(cols)} from ({queries.ORACLE_SQL[name]}) q").fetchall()
    assert got == sorted("|".join(map(_text, r)) for r in want)


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = documents.columns, documents.count()
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= rows
        rows = docs.count()
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == rows


def test_pipeline_keeps_and_drops_what_it_should(spark, tmp_path):
    """Planted documents go or stay by the stage that is there for them."""
    import random

    from .test_operators import sentence

    rng = random.Random(31)
    docs = {i: sentence(rng, 40) + (" awful horrid" if i % 8 == 0 else "") for i in range(600)}
    base = sentence(rng, 120).split(" ")
    docs[700] = " ".join(base)
    docs[701] = " ".join([*base[:60], "edited", *base[61:]])
    docs[702] = docs[700]
    passage, item = sentence(rng, 60), sentence(rng, 30)
    heads = {k: sentence(rng, 80) for k in (710, 711)}
    docs |= {k: f"{heads[k]} {passage}" for k in heads}
    docs[720] = f"{sentence(rng, 90)} {item} {sentence(rng, 90)}"
    docs[730] = "awful horrid " + sentence(rng, 50)
    docs |= {740: None, 741: ""}
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in docs.items()]
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, 1, int(i % 8 == 0)) for i in range(600)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item)], "item_id long, text string"),
    }
    for name, (values, schema) in tables.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    clean = {i for i in range(600) if i % 8} | {700, 710, 711}
    assert set(out) == clean
    words = lambda t: len(t.split(" "))
    assert all(out[i].size == words(docs[i]) for i in range(1, 600, 8))
    assert all(words(heads[k]) - 1 <= out[k].size < words(docs[k]) - 50 for k in heads)
    per = {}
    for r in out.values():
        per.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 0.5 for taken, target in per.values())
