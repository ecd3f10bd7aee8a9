"""Suffix dedup where many different runs share a gram, on long texts, and with clashing names, against brute force."""

import random
from collections import Counter

import pytest
from test_llm_operators import brute_removal

from annotara.llm import suffix_dedup


def near_copies(n, length, changes, seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdefgh ij klmno") for _ in range(length))
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(changes):
            t[rng.randrange(length)] = rng.choice("XYZÉ0123456789")
        out.append((i, f"{i} " + "".join(t)))
    return out


@pytest.mark.parametrize(("most", "changes"), [(1024, 2), (50, 2), (50, 5), (2, 1)])
def test_many_runs_of_one_gram(spark, most, changes):
    rows = near_copies(150, 700, changes, most + changes)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(docs, most=most).collect()
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_removal(rows, 200), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_split_groups_stay_small(spark, monkeypatch):
    sizes = []
    real = suffix_dedup.sorted_groups

    def seen(members, width):
        sizes.append(members.groupBy("key").count().agg({"count": "max"}).first()[0] or 0)
        return real(members, width)

    monkeypatch.setattr(suffix_dedup, "sorted_groups", seen)
    docs = spark.createDataFrame(near_copies(400, 500, 3, 9), "doc_id long, text string")
    assert suffix_dedup.remove_repeats(docs, most=40).count() == 400
    assert len(sizes) > 1 and max(sizes) <= 40


def test_one_text_of_a_megabyte(spark):
    """Texts of one letter, of one line over and over, and of random letters with one repeated passage."""
    rng = random.Random(3)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(1_000_000))
    passage = "".join(rng.choice("ABCDEFG ") for _ in range(400))
    rows = [(1, "z" * 1_200_000), (2, "one line over and over é\n" * 50_000), (3, noise[:500_000] + "1" + passage + "2" + noise[500_000:] + "3" + passage)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, file long")
    got = {r.doc_id: r for r in suffix_dedup.query(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (1_200_000, 1) and got[2].n_removed == got[2].n_bytes == 26 * 50_000
    assert (got[3].n_removed, got[3].n_spans) == (800, 2)
