"""The pipeline on nulls, empty and long texts, repeated rows, clashing names and an empty table."""

import re

import pytest

import corpus_pipeline
from annotara.llm.common import stored

NAMES = "doc_id long, text string, lang string, score double, __score double, at string, __at string, fp long, digest string, run string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('pipeline')}"
    long = " ".join(f"word{i % 977}" for i in range(200_000))
    texts = [None, "", " \n", "some words that stay here", "some words that stay here", "some  words that stay here ", long, long + " end", "mail ann@x.org or 555-123-4567", "nitwit " * 9]
    rows = [(i, t, "en", 0.5, 0.1, "a", "b", 7, "d", "r") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id has this text", *[None] * 8), (3, "another text of the id", "fr", *[None] * 7)]
    spark.createDataFrame(rows, NAMES).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 9)) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_on_hard_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"cases-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "exact_dedup":
            texts = [re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in docs.collect()]
            assert len(texts) == len(set(texts)) and "" in texts and {r.doc_id for r in docs.collect()} >= {5, 6, 8, None}
        if name == "simhash_dedup":
            assert not {6, 7} <= {r.doc_id for r in docs.collect()}
        if name == "pii":
            own = next(r for r in docs.collect() if r.doc_id == 8)
            assert "ann@" not in own.text and "555-123-4567" not in own.text
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).toPandas()
    assert len(pieces.groupby(["doc_id", "doc_tokens"], dropna=False)) == sizes[-1] and (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_an_empty_table_gives_no_rows(spark, folder, tmp_path):
    path = f"file://{tmp_path}"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
