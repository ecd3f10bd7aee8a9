"""SimHash: keys that many fingerprints share, links equal to brute force, names of columns, long texts."""

import random
from collections import Counter

import numpy as np
import pytest

from annotara.llm import simhash_dedup as S


def within(bits, n, seed, base=0):
    rng = np.random.default_rng(seed)
    out = np.full(n, base, np.uint64)
    for b in bits:
        out ^= rng.integers(0, 2, n).astype(np.uint64) << np.uint64(b)
    return np.unique(out)


def brute(fp, start=None):
    """Components as a set of frozensets; start: only links whose chains from there keep to their budgets."""
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(fp)):
        x = fp[i] ^ fp[i + 1 :]
        ok = np.bitwise_count(x) <= 3
        for j in (np.flatnonzero(ok) + i + 1).tolist():
            if start is None or all(sum((int(fp[i] ^ fp[j]) >> 8 * ((start + k) % 8) & 255).bit_count() for k in range(n)) <= n * 3 // 8 for n in range(1, 9)):
                parent[find(j)] = find(i)
    groups = {}
    for i in range(len(fp)):
        groups.setdefault(find(i), set()).add(int(fp[i]))
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize(("tag", "n"), [(0, 50), (5, 3000), (23, 3000)])
def test_links_within_a_key(tag, n):
    free = S.free_bits(tag)
    assert len(free) == 32
    fp = within(free[: 14 if n > 100 else 6], n, tag, 0x0123456789ABCDEF)
    got = {frozenset([root, *map(int, others)]) for root, others in S.linked(fp, tag // 3, free)}
    assert got == brute(fp, tag // 3)


def test_longer_keys_keep_every_link():
    rng = np.random.default_rng(1)
    for _ in range(60):
        x = rng.integers(0, 1 << 63, 1, dtype=np.int64).view(np.uint64)
        y = x.copy()
        for b in rng.choice(64, 3, replace=False):
            y ^= np.uint64(1) << np.uint64(b)
        a, b = S.chain_keys(x)[0], S.chain_keys(y)[0]
        key = a[a == b][:1]
        for level in range(len(S.PIECE)):
            more = [S.longer_keys(key, fp.view(np.int64), level)[0] for fp in (x, y)]
            shared = np.intersect1d(*more)
            assert len(shared) and (shared >= 0).all()
            tag, _ = S.taken(shared, level + 1)
            assert (tag == key[0] >> (32 + sum(w + 2 for w in S.PIECE[:level]))).all()
            key = shared[:1]


def edges_of(spark, fp, most):
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(6)
    return {(r.u, r.v) for r in S.components(S.star_edges(nodes, most)).collect()}


@pytest.mark.parametrize("most", [8192, 40, 3])
def test_split_keys_give_the_same_components(spark, most):
    rng = np.random.default_rng(3)
    fp = np.unique(np.concatenate([within(S.free_bits(7)[:12], 900, 2), within(range(64), 200, 4), rng.integers(0, 40, 30).astype(np.uint64)]))
    want = set()
    for g in brute(fp):
        signed = np.array(sorted(g), np.uint64).view(np.int64)
        want |= {(int(x), int(signed.min())) for x in signed if x != signed.min()}
    assert edges_of(spark, fp, most) == want


def test_a_key_of_200_000_fingerprints_is_dealt_to_many_tasks(spark):
    """All agree in two neighbouring segments and two more; 60 pairs are linked."""
    free = S.free_bits(0)
    rng, fp = np.random.default_rng(5), within(free, 200_000, 6)
    near = fp[:60] ^ (np.uint64(1) << np.uint64(free[3])) ^ (np.uint64(1) << np.uint64(free[20]))
    fp = np.unique(np.concatenate([fp, near]))
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(8)
    sizes = []
    real = S.run_edges

    def seen(keyed, level):
        sizes.append(keyed.groupBy("key").count().agg({"count": "max"}).first()[0])
        return real(keyed, level)

    S.run_edges = seen
    try:
        got = {(r.u, r.v) for r in S.star_edges(nodes).collect()}
    finally:
        S.run_edges = real
    assert len(sizes) > 1 and max(s for s in sizes if s) <= S.MOST
    root = {r.u: r.v for r in S.components(spark.createDataFrame(list(got), "u long, v long")).collect()}
    groups = {}
    for x in fp.view(np.int64).tolist():
        groups.setdefault(root.get(x, x), []).append(x)
    for x in [*near, *rng.choice(fp, 300)]:  # no link is lost: some of the fingerprints against all
        own = fp[np.bitwise_count(fp ^ x) <= 3].view(np.int64).tolist()
        assert len({root.get(y, y) for y in own}) == 1
    for g in groups.values():  # and none is made up
        assert len(g) == 1 or brute(np.array(g, np.int64).view(np.uint64)) == {frozenset(y % 2**64 for y in g)}


def test_components_take_as_many_rounds_as_they_need(spark):
    path = [(i, i + 1) for i in range(3000)]
    random.Random(1).shuffle(path)
    got = {r.u: r.v for r in S.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(1, 3001), 0)


@pytest.mark.parametrize("name", ["__at", "at", "AT", "fp"])
def test_names_of_columns_don_t_clash(spark, name):
    rows = [(1, "a b c d e", 7), (2, "a b c d e", 8), (None, "x y z", 9), (3, None, None), (4, "", None)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{name}` long")
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(tuple(r) for r in kept.collect()) == Counter([rows[0], rows[2], rows[3]])


def test_long_texts_are_read_as_a_whole(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["red", "blue", "green", "stone"]) + str(rng.randrange(999)) for _ in range(200_000))
    assert len(text) > 1_000_000
    rows = spark.createDataFrame([(5, text), (3, text + " tail"), (9, "other words here")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.query(rows).collect()}
    assert got[5].component_id == got[3].component_id == 3 and got[9].component_id == 9
    assert int(got[5].fingerprint, 16) == S.fingerprint(text) == S.fingerprint(text, block=1000)
