"""Every catalogue query against its SQL over the smallest table."""

import os

import pytest

from annotara.plans import annotated, catalogue, more, oracles, text_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalogue.FOUND | text_queries.FOUND | annotated.FOUND | more.FOUND
SQL = oracles.SQL | text_queries.SQL | annotated.SQL | more.SQL


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{path}/*.parquet' )" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return c


def plain(v):
    if v is None or v != v:
        return "~"
    if hasattr(v, "tolist"):
        v = v.tolist()
    return repr(float(v)) if isinstance(v, float) else str(v)


def rows(frame, columns):
    return sorted("|".join(map(plain, r)) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_oracles_name_queries():
    assert set(SQL) <= set(QUERIES)


def test_bootstrap_of_10000_replicates(spark):
    import hashlib

    import numpy as np

    docs = catalogue._doc_counts(spark, SF).toPandas().sort_values("doc_id")
    n, counts = len(docs), docs[["tp", "n_gold", "n_system"]].to_numpy(np.int64)
    f1 = []
    for b in range(10_000):
        tp, gold, system = counts[[int(hashlib.md5(f"{b}|{i}|42".encode()).hexdigest()[:8], 16) % n for i in range(n)]].sum(0).tolist()
        f1.append(round(2.0 * tp / (gold + system), 9))
    got = QUERIES["bootstrap_micro_f1_full"](spark, SF).collect()
    assert len(got) == 1 and (got[0].low, got[0].high) == pytest.approx(tuple(np.quantile(f1, [0.025, 0.975])), abs=1.1e-6)


def test_ceafe_of_all_clusters(spark):
    from functools import lru_cache

    from annotara.plans import fixtures

    gold, system = ({}, {})
    for side, frame in zip((gold, system), fixtures.coref(spark, SF), strict=True):
        for r in frame.collect():
            side.setdefault(r.doc_id, {})[r.mention_id] = r.cluster
    got = {r.doc_id: r for r in QUERIES["coref_ceafe_full"](spark, SF).collect()}
    assert set(got) == set(gold) | set(system)
    most = 0
    for doc, r in got.items():
        sets = []
        for own, other in ((gold[doc], system[doc]), (system[doc], gold[doc])):
            groups = {}
            for m in set(own) | set(other):
                groups.setdefault(own.get(m, ("only", m)), set()).add(m)
            sets.append(list(groups.values()))
        value = [[2 * len(g & s) / (len(g) + len(s)) for s in sets[1]] for g in sets[0]]

        @lru_cache(None)
        def best(i, used, value=value):
            if i == len(value):
                return 0.0
            return max([best(i + 1, used), *(v + best(i + 1, used | 1 << j) for j, v in enumerate(value[i]) if v and not used >> j & 1)])

        num = best(0, 0)
        assert (r.p_num, r.p_den, r.r_num, r.r_den) == pytest.approx((num, len(sets[1]), num, len(sets[0])), abs=2e-6)
        most = max(most, len(sets[0]))
    assert most >= 10
