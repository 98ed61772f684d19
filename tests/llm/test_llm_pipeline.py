"""The pipeline's stages on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from evigraph.llm import ngramjoin, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        if name != "best_fit_packing":
            assert docs.columns == columns, name
        assert docs.count() > 0
        if name == "quality_rules":
            judged = quality.judge(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in judged.where("kept").collect()}
        if name == "ngram_jaccard":
            again = ngramjoin.join(docs)
            assert again.where("doc_id <> component_id").count() == 0
        if name == "best_fit_packing":
            fill = docs.groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
            assert fill.max() <= 2048 and len(fill) <= 1.1 * fill.sum() / 2048 + 1


ODD = [
    (None, "a text without an id " * 20, "en", None), (1, None, None, "s"), (2, "", "en", "s"), (3, " \n ", "xx", None), (4, "same words here " * 30, "en", "s"),
    (4, "same words here " * 30, "en", "s"), (5, "long " * 60_000, "en", "t"), (6, "\n".join(f"line number {i} of this text has words" for i in range(40)), "en", "t"),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows_and_clashing_columns(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _t string, _doc string, _row string, size string, removed string, kept string, _j_id string"
    df = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 7) for r in ODD], schema)
    for own in (df, df.limit(0)):
        out = stage(spark, own, SF)
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == df.columns
            assert all(r[c] == "x" for r in rows for c in df.columns[5:])
        assert own is df or not rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    columns = sorted(names)
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want
