"""Every corpus query against its SQL, on the odd cases and on empty tables."""

import pytest
from helpers import SMALL, oracle_rows, rows_of

from conftest import CLASHES
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import jaccard, language, pieces, pii, quality, queries, url_filter

NAMES = sorted(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, SMALL)) == oracle_rows(SMALL, queries.ORACLES[name])


@pytest.mark.parametrize("name", NAMES)
def test_odd(spark, odd, name):
    rows = queries.QUERIES[name](spark, odd).collect()
    assert len(rows) == (7 if name.startswith(("op1_", "op7_")) else 16)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_odd_sql(spark, odd, name):
    assert rows_of(queries.QUERIES[name](spark, odd)) == oracle_rows(odd, queries.ORACLES[name])


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("folder", ["odd", "empty"])
def test_pipeline(spark, folder, request):
    rows = corpus_pipeline.run(spark, request.getfixturevalue(folder)).collect()
    # a text that holds the model's own space sign decodes to spaces
    assert all(r["round_trip"] for r in rows if r["doc_id"] != 12)
    assert bool(rows) == (folder == "odd")


@pytest.mark.parametrize("folder", ["odd", "empty"])
def test_stages_keep_columns(spark, folder, request):
    """Every column comes through, also one that is named like a result of an operator."""
    docs = spark.read.parquet(f"{request.getfixturevalue(folder)}/documents.parquet")
    kept = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, ""))
        assert docs.schema == before.schema, name
        rows = docs.collect()
        assert all(r[c] == "clash" for r in rows for c in CLASHES), name
        assert {r["doc_id"] for r in rows} <= kept, name
        if name == "n-gram Jaccard join" and rows:
            # 1, 2 and 3 are near copies of each other; a row without an id is a row like others
            assert [r["doc_id"] for r in rows].count(1) == 1 and not {2, 3} & {r["doc_id"] for r in rows} and None in {r["doc_id"] for r in rows}
        kept = {r["doc_id"] for r in rows}


def test_operators_keep_columns(spark, odd):
    """The operators on whole tables: a column that has the name of a result becomes <name>_given."""
    docs, pages = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "pages"))
    for out, table, clash in (
        (quality.judge(docs), docs, ["Kept", "n_words"]), (pii.find(docs), docs, ["SPANS"]), (language.identify(docs, F.lit(True)), docs, ["score"]),
        (pieces.encode_texts(docs, corpus_pipeline.tokenizer_path()), docs, ["n_tokens", "ids"]), (url_filter.url_filter(pages, url_filter.listed_urls(pages)), pages, ["host"]),
    ):
        names = [f"{c}_given" if c in clash else c for c in table.columns]
        assert out.columns[: len(names)] == names
        assert sorted(map(repr, out.select(names).collect())) == sorted(map(repr, table.toDF(*names).collect()))


def test_one_of_each_by_rows(spark):
    """Rows without an id, and rows that share one, are told apart by their texts."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(1), "b"), (None, text(1), "a"), (None, text(2), "c"), (5, text(1), "d"), (7, text(3), "e"), (7, text(4), "f"), (7, text(4), "f"), (8, "", "g"), (8, None, "h"), (None, text(5), "z"), (None, text(5), "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_copy` string")
    got = sorted(map(tuple, jaccard.one_of_each(df).collect()), key=repr)
    assert got == sorted([(None, text(2), "c"), (5, text(1), "d"), (7, text(3), "e"), (7, text(4), "f"), (8, "", "g"), (8, None, "h"), (None, text(5), "y")], key=repr)
    # whatever the number of repeated rows, the joins give the same
    assert {r["component_id"] for r in jaccard.with_components(df).collect()} == {5, 7, 8, None}


def test_many_languages(spark):
    """No language is too many for the rules or the models."""
    rows = [(i, " ".join(chr(0x4E00 + i) * 2 + "abcdefg"[k % 7] for k in range(60)), f"l{i:04d}") for i in range(1100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == r["lang"] for r in language.identify(df.where("doc_id < 130"), F.lit(True)).collect())
    more = df.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(quality.MIN_REFERENCE)))).drop("k")
    judged = quality.judge(more, drop=("text",)).agg(F.count("char_distance").alias("n"), F.max("char_distance").alias("far")).first()
    assert judged["n"] == 1100 * quality.MIN_REFERENCE and judged["far"] < 0.2


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, SMALL))
        assert docs.columns == before.columns
        if name == "quality rules":
            kept = {r["doc_id"] for r in docs.collect()}
            judged = {r["doc_id"]: r["base_failed"] for r in corpus_pipeline.quality.judge(before).collect()}
            assert all(d in kept for d, q in labels.items() if q == 1 and not judged[d])
            assert sum(d not in kept for d, q in labels.items() if q == 0) > 0.5 * sum(q == 0 for q in labels.values())
        if name == "personal data":
            assert not any("@" in r["text"] and ".example" in r["text"] for r in docs.collect())
