"""Exact dedup: the state outlives a run, micro-batches are bounded, names don't clash, long texts are whole."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from annotara.llm import exact_dedup
from annotara.llm.common import stored


def norm(t):
    return re.sub("[\x20\x09-\x0d]", "", t or "")


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0])) for k, v in groups.items()}
    return {r[0]: (best[norm(r[1])][0], len(groups[norm(r[1])])) for r in rows}


def parts():
    rng = random.Random(8)
    words = ["a", "b b", "c\n", "d", "é", "", "  "]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 3)))) for i in range(240)]
    rows[7] = (7, None)
    return rows[:100], rows[100:180], rows[180:]


def frame(spark, rows):
    return stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "state-tests")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.substring(exact_dedup.sha256(t), 1, 1)])  # the second one collides
def test_later_runs_meet_earlier_rows(spark, tmp_path, digest):
    folder, seen = f"file://{tmp_path}/state", []
    for i, rows in enumerate(parts()):
        seen += rows
        want = brute(seen)
        docs = frame(spark, rows)
        for _ in range(2):  # repeated under its name, as after a failure, a run adds nothing
            got = exact_dedup.dedup_groups(docs, digest, state=folder, run=f"day{i}").collect()
            assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {r[0]: want[r[0]] for r in rows}
            assert {r.doc_id for r in got if r.kept} == {r[0] for r in rows if want[r[0]][0] == r[0]}


def test_a_run_that_failed_before_its_stream_is_taken_up(spark, tmp_path, monkeypatch):
    folder, (a, b, _) = f"file://{tmp_path}/state", parts()
    exact_dedup.exact_dedup(frame(spark, a), state=folder, run="1").count()
    docs = frame(spark, b)

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, "state_of", lost)
        with pytest.raises(RuntimeError):
            exact_dedup.exact_dedup(docs, state=folder, run="2")
    kept = exact_dedup.exact_dedup(docs, state=folder, run="2")
    want = brute([*a, *b])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in b if want[r[0]][0] == r[0])


def test_micro_batches_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BATCH", 1)
    folder, rows = f"{tmp_path}/state", parts()[0]
    got = exact_dedup.dedup_groups(frame(spark, rows), state=f"file://{folder}", run="1").collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == brute(rows)
    assert len([p for p in (tmp_path / "state" / "checkpoint" / "commits").iterdir() if p.name.isdigit()]) > 1


@pytest.mark.parametrize("name", ["__at", "at", "AT", "run", "digest"])
def test_names_of_columns_don_t_clash(spark, name):
    rows = [(1, "a b", 7), (2, "ab", 8), (3, None, 9), (4, "", None), (4, "", None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` long")
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and Counter(tuple(r) for r in kept.collect()) == Counter([rows[0], rows[2]])


def test_long_texts_are_read_as_a_whole(spark):
    t = "word " * 300_000
    docs = spark.createDataFrame([(1, t), (2, t + "x"), (3, t[:-1] + "\n"), (4, " " + t)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.query(docs).collect()}
    assert got == {1: (4, 3), 2: (2, 1), 3: (4, 3), 4: (4, 3)}
