"""Cluster evaluation: mappings to clusters, alignment of mentions, MUC, B3, CEAFe, LEA and CoNLL.

Clusters are rows (doc_id, mention_id, cluster).  All but CEAFe come from one contingency table; raw
counts are summed over documents before they are divided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stored
from .spans import ratio


def clusters(mapping: DataFrame) -> DataFrame:
    """doc_id, cluster, members (ordered, comma-joined), size of (doc_id, mention_id, docid); mentions
    without docid are clusters of their own."""
    key = F.coalesce(F.concat(F.lit("d:"), F.col("docid")), F.concat(F.lit("m:"), F.col("mention_id").cast("string")))
    grouped = mapping.groupBy("doc_id", key.alias("cluster")).agg(F.array_sort(F.collect_list("mention_id")).alias("m"))
    return grouped.select("doc_id", "cluster", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"), F.size("m").cast("long").alias("size"))


def aligned(gold: DataFrame, system: DataFrame) -> DataFrame:
    """doc_id, mention_id, gold, system; null where a side lacks the mention."""
    g = gold.select("doc_id", "mention_id", F.col("cluster").alias("gold"))
    s = system.select("doc_id", "mention_id", F.col("cluster").alias("system"))
    return g.join(s, ["doc_id", "mention_id"], "full_outer")


def alignment(both: DataFrame, *keys: str) -> DataFrame:
    c = both.groupBy(*keys).agg(F.count("gold").alias("n_gold"), F.count("system").alias("n_system"), F.count_if(F.col("gold").isNotNull() & F.col("system").isNotNull()).alias("matched"))
    p, r = ratio(F.col("matched"), F.col("n_system")), ratio(F.col("matched"), F.col("n_gold"))
    return c.select(*keys, "n_gold", "n_system", "matched", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def span_mode(both: DataFrame, unmatched: str = "singleton") -> DataFrame:
    """Mentions that a side lacks are singletons there, or dropped from both sides."""
    if unmatched == "drop":
        return both.where(F.col("gold").isNotNull() & F.col("system").isNotNull())
    own = F.concat(F.lit("only:"), F.col("mention_id").cast("string"))
    return both.withColumn("gold", F.coalesce(F.col("gold").cast("string"), own)).withColumn("system", F.coalesce(F.col("system").cast("string"), own))


def contingency(both: DataFrame) -> DataFrame:
    return both.groupBy("doc_id", "gold", "system").agg(F.count(F.lit(1)).alias("n"))


def _side(table: DataFrame, this: str, other: str) -> DataFrame:
    """Per document MUC, B3 and LEA numerators and denominators of one side's clusters.  A null on the
    other side is a mention it lacks: on its own for MUC, without overlap for the others."""
    own = table.where(F.col(this).isNotNull())
    sizes = table.where(F.col(other).isNotNull()).groupBy("doc_id", other).agg(F.sum("n").alias("other_size"))
    cells = own.join(sizes, ["doc_id", other], "left")
    met = F.col(other).isNotNull()
    c = cells.groupBy("doc_id", this).agg(
        F.sum("n").alias("size"), F.count_if(met).alias("parts"), F.coalesce(F.sum(F.when(~met, F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(met, F.col("n") * F.col("n"))), F.lit(0)).alias("squares"),
        F.coalesce(F.sum(F.when(met, F.col("n") * (F.col("n") - 1) / 2)), F.lit(0.0)).alias("links"),
        F.max(F.when(met & (F.col("other_size") == 1), 1).otherwise(0)).alias("alone"),
    )
    size = F.col("size")
    resolved = F.when(size == 1, F.col("alone").cast("double")).otherwise(F.col("links") / (size * (size - 1) / 2))
    return c.groupBy("doc_id").agg(
        F.sum(size - F.col("parts") - F.col("missing")).cast("double").alias("muc_num"), F.sum(size - 1).cast("double").alias("muc_den"),
        F.sum(F.col("squares") / size).alias("b3_num"), F.sum(size).cast("double").alias("b3_den"),
        F.sum(size * resolved).alias("lea_num"), F.sum(size).cast("double").alias("lea_den"),
    )


def link_counts(both: DataFrame) -> DataFrame:
    """doc_id and p_/r_ numerators and denominators of MUC, B3 and LEA (precision: the system's clusters)."""
    table = stored(contingency(both), "contingency")
    names = ["muc_num", "muc_den", "b3_num", "b3_den", "lea_num", "lea_den"]
    r = _side(table, "gold", "system").select("doc_id", *[F.col(n).alias(f"r_{n}") for n in names])
    p = _side(table, "system", "gold").select("doc_id", *[F.col(n).alias(f"p_{n}") for n in names])
    return r.join(p, "doc_id", "full_outer").na.fill(0.0)


def finalised(counts: DataFrame, metric: str, *keys: str) -> DataFrame:
    sums = counts.groupBy(*keys).agg(*[F.sum(f"{s}_{metric}_{x}").alias(f"{s}_{x}") for s in "pr" for x in ("num", "den")])
    p, r = ratio(F.col("p_num"), F.col("p_den")), ratio(F.col("r_num"), F.col("r_den"))
    return sums.select(*keys, *[F.round(f"{s}_{x}", 6).alias(f"{s}_{x}") for s in "pr" for x in ("num", "den")], F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"))


def best_assignment(value: np.ndarray) -> float:
    """Largest sum of a one-to-one assignment of rows to columns: shortest augmenting paths with
    potentials, cubic in the smaller side."""
    if not value.size:
        return 0.0
    cost = -(value if value.shape[0] <= value.shape[1] else value.T)
    n, m = cost.shape
    row_price, col_price = np.zeros(n + 1), np.zeros(m + 1)
    row_of = np.zeros(m + 1, np.int64)
    for i in range(1, n + 1):
        row_of[0], col = i, 0
        slack, came, seen = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while True:
            seen[col] = True
            reduced = cost[row_of[col] - 1] - row_price[row_of[col]] - col_price[1:]
            better = np.flatnonzero(~seen[1:] & (reduced < slack[1:])) + 1
            slack[better], came[better] = reduced[better - 1], col
            open_slack = np.where(seen, np.inf, slack)
            open_slack[0] = np.inf
            nxt = int(open_slack.argmin())
            step = open_slack[nxt]
            row_price[row_of[seen]] += step
            col_price[seen] -= step
            slack[~seen] -= step
            col = nxt
            if row_of[col] == 0:
                break
        while col:
            row_of[col], col = row_of[came[col]], came[col]
    used = np.flatnonzero(row_of[1:])
    return float(-cost[row_of[1:][used] - 1, used].sum())


def ceafe_counts(both: DataFrame) -> DataFrame:
    """doc_id, p_ceafe_num, p_ceafe_den, r_ceafe_num, r_ceafe_den, with similarity 2|g and s| / (|g| + |s|)."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf[pdf.gold.notna()].groupby("gold").n.sum()
        s = pdf[pdf.system.notna()].groupby("system").n.sum()
        value = np.zeros((len(g), len(s)))
        at_g, at_s = {k: i for i, k in enumerate(g.index)}, {k: i for i, k in enumerate(s.index)}
        for gold, system, n in pdf.dropna()[["gold", "system", "n"]].itertuples(index=False):
            i, j = at_g[gold], at_s[system]
            value[i, j] = 2.0 * n / (g.iloc[i] + s.iloc[j])
        num = best_assignment(value)
        return pd.DataFrame({"doc_id": [pdf.doc_id.iloc[0]], "p_ceafe_num": [num], "p_ceafe_den": [float(len(s))], "r_ceafe_num": [num], "r_ceafe_den": [float(len(g))]})

    kind = both.schema["doc_id"].dataType.simpleString()
    return contingency(both).groupBy("doc_id").applyInPandas(of, f"doc_id {kind}, p_ceafe_num double, p_ceafe_den double, r_ceafe_num double, r_ceafe_den double")


def conll(both: DataFrame) -> DataFrame:
    """One row: F1 of MUC, B3, CEAFe and LEA over all documents, and the mean of the first three."""
    counts, best = link_counts(both), ceafe_counts(both)
    parts = [finalised(counts, m).select(F.col("f1").alias(f"{m}_f1")) for m in ("muc", "b3", "lea")] + [finalised(best, "ceafe").select(F.col("f1").alias("ceafe_f1"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out.withColumn("conll_f1", F.round((F.col("muc_f1") + F.col("b3_f1") + F.col("ceafe_f1")) / 3, 6))
