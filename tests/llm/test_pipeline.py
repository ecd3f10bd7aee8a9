"""The pipeline over the smallest table: what each stage keeps, against the operators' own brute force."""

import re

import pytest

import corpus_pipeline
from annotara.llm import pii, toxicity
from annotara.llm.common import stored
from test_llm_operators import brute_fingerprint, clip

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_stages_keep_columns_and_shrink(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [docs.count(), *(s.count() for s in stages[:-1])]
    assert all(s.columns == docs.columns for s in stages[:-1])
    assert rows[0] > rows[1] >= rows[2] >= rows[3] == rows[4]


def test_toxic_documents_are_gone(spark, stages):
    scores = toxicity.query(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in stages[0].select("doc_id").collect()} == {r[0] for r in scores.where("predicted = 0").select("doc_id").collect()}


def test_no_two_texts_are_equal(stages):
    texts = [re.sub("[\x20\x09-\x0d]", "", r[0] or "") for r in stages[1].select("text").collect()]
    assert len(texts) == len(set(texts))


def test_sequences_hold_every_document_once(stages):
    pieces = stages[4].toPandas()
    assert set(pieces.doc_id) == {r[0] for r in stages[3].select("doc_id").collect()}
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_run_keeps_the_documents_of_a_brute_force(spark, stages):
    own = ["doc_id", "text"]
    rows = [[tuple(r) for r in s.select(own).collect()] for s in stages[:-1]]
    groups = {}
    for i, t in rows[0]:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i, t))
    exact = sorted(min(g)[1:] for g in groups.values())
    assert sorted(rows[1]) == exact
    prints, group = [brute_fingerprint(t) for _, t in exact], list(range(len(exact)))
    for i in range(len(exact)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    near = sorted(min(x for x, g in zip(exact, group, strict=True) if g == k) for k in set(group))
    assert sorted(rows[2]) == near
    write = pii.writer(pii.KEY)
    private = [(i, pii.pseudonymised(t, write)[0]) for i, t in near]
    assert sorted(rows[3]) == private
    pieces = corpus_pipeline.run(spark, SF).toPandas()
    assert pieces.groupby("doc_id").length.sum().to_dict() == {i: len(clip(t)) + 1 for i, t in private}
