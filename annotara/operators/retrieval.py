"""Candidate search: BM25 over postings, vectors by blocks, thresholds and mappings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import spread, stored

K1, B, FLOOR = 1.5, 0.75, 0.25


def bm25_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def postings(pool: DataFrame, key: str = "row_idx", text: str = "text", *keep: str) -> DataFrame:
    """term, key, tf, dl (the document's length) and the columns to keep: the pool is tokenised once,
    everything else derives from this table."""
    words = spread(pool.select(key, *keep, text)).select(key, *keep, bm25_tokens(F.col(text)).alias("w")).select(key, *keep, F.size("w").cast("long").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("term", key, *keep, "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(tf: DataFrame, pool: DataFrame, key: str = "row_idx") -> DataFrame:
    """One row: documents n, mean length avgdl.  Documents without terms count with length 0."""
    docs = pool.agg(F.count(F.lit(1)).alias("n"))
    return docs.crossJoin(tf.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))).select("n", (F.col("terms") / F.col("n")).alias("avgdl"))


def share(avgdl: Column) -> Column:
    """What one occurrence count of a term adds to a score, before its idf."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))


def idf(tf: DataFrame, stats: DataFrame) -> DataFrame:
    """term, df, idf and the largest share of any document; negative values of idf are replaced by FLOOR times
    the mean over the vocabulary."""
    one = F.broadcast(stats)  # a row
    raw = tf.crossJoin(one).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max(share(F.col("avgdl"))).alias("top"), F.first("n").alias("n"))
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg((F.avg("raw") * FLOOR).alias("low"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", "top", F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, key: str, text: str, most: int | None = None) -> DataFrame:
    """key, term, qtf of the first `most` tokens of each query."""
    tokens = bm25_tokens(F.col(text))
    return queries.select(key, F.explode(tokens if most is None else F.slice(tokens, 1, most)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("qtf"))


def top_k(scores: DataFrame, qkey: str, key: str, k: int) -> DataFrame:
    """The k best of each query with rank from 1, equal scores by key; Spark limits groups before sorting."""
    best = Window.partitionBy(qkey).orderBy(F.col("score").desc(), F.col(key))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: A term that more than this share of the documents hold is common; so many times k documents set the goal.
COMMON, DEEP, SLACK = 0.2, 8, 1e-5


def bm25_scores(tf: DataFrame, stats: DataFrame, vocabulary: DataFrame, terms: DataFrame, k: int, qkey: str, key: str, kind: str | None = None) -> DataFrame:
    """qkey, key, score of at least the k best pairs that share a term; terms: qkey, term, qtf and, where
    kind names a column of the postings, has (the value it must have, null for any).

    Postings of common terms are long and add little.  A first pass scores by the other terms alone, and the
    documents best by it are scored in full; the k-th of them is a goal that the k best reach at least.  Where
    it is above all that a query's common terms could give, a document without one of the other terms can't
    be among the k best, nor one whose partial score and that sum stay below: only the rest is met with the
    postings of common terms.  Queries for which this doesn't hold are scored in full.
    """
    match = [F.col("has").isNull() | (F.col("has") == F.col(kind))] if kind else []
    common = F.col("df") > F.col("n") * COMMON
    gain = terms.join(vocabulary, "term").select(*terms.columns, (F.col("qtf") * F.col("idf")).alias("gain"), "top", common.alias("common"))
    gain = stored(gain, "bm25-terms")
    one = F.broadcast(stats.select("avgdl"))

    def met(rows: DataFrame, on: list[str]) -> DataFrame:
        hits = tf.join(rows, on).crossJoin(one)
        for m in match:
            hits = hits.where(m)
        return hits.select(qkey, key, (F.col("gain") * share(F.col("avgdl"))).alias("part"))

    def completed(part: DataFrame) -> DataFrame:
        """qkey, key, part: the partial scores and, a row per term, what common terms add to them."""
        wanted = part.select(qkey, key).join(gain.where("common"), qkey)
        return part.unionByName(tf.join(wanted, ["term", key]).crossJoin(one).select(qkey, key, (F.col("gain") * share(F.col("avgdl"))).alias("part")))

    bounds = gain.groupBy(qkey).agg(F.coalesce(F.sum(F.when(F.col("common"), F.greatest(F.lit(0.0), F.col("gain") * F.col("top")))), F.lit(0.0)).alias("most"))
    rare = stored(met(gain.where("not common"), ["term"]).groupBy(qkey, key).agg(F.sum("part").alias("part")), "bm25-rare")
    best = top_k(rare.withColumnRenamed("part", "score"), qkey, key, DEEP * k).select(qkey, key, F.col("score").alias("part"))
    full = completed(best).groupBy(qkey, key).agg(F.sum("part").alias("score"))
    goal = top_k(full, qkey, key, k).where(F.col("rank") == k).select(qkey, F.col("score").alias("goal"))
    told = stored(bounds.join(goal, qkey).where(F.col("goal") > F.col("most") + SLACK), "bm25-told")
    near = rare.join(told, qkey).where(F.col("part") + F.col("most") + SLACK >= F.col("goal")).select(qkey, key, "part")
    whole = met(gain.join(told, qkey, "left_anti"), ["term"])
    return completed(near).unionByName(whole).groupBy(qkey, key).agg(F.round(F.sum("part"), 6).alias("score"))


def with_zeros(scores: DataFrame, queries: DataFrame, pool: DataFrame, qkey: str, key: str, k: int, deep: bool = False, kind: str | None = None) -> DataFrame:
    """Adds documents that share no term, with score 0, where a query has fewer than k positive hits: an
    exhaustive ranking would return them.  Only the first documents by key can be among them: 2 k of them,
    or where scores may be negative (deep) as many more as the query has hits.  queries: qkey and, with kind, has."""
    per = queries.join(scores.groupBy(qkey).agg(F.count(F.lit(1)).alias("hits"), F.count_if(F.col("score") > 0).alias("good")), qkey, "left").na.fill(0, ["hits", "good"])
    short = per.where(F.col("good") < k).withColumn("room", (F.lit(k) + (F.col("hits") if deep else F.lit(k))).cast("int"))
    room = (short.agg(F.max("room")).first()[0] or 0) if deep else 2 * k
    first = pool.select(key).orderBy(key).limit(room).withColumn("nth", F.row_number().over(Window.orderBy(key)))  # `room` rows
    free = short.where("has is null") if kind else short
    zeros = free.select(qkey, F.explode(F.sequence(F.lit(1), F.col("room"))).alias("nth")).join(first, "nth").select(qkey, key)
    if kind:
        own = pool.select(key, F.col(kind).alias("has"), F.row_number().over(Window.partitionBy(kind).orderBy(key)).alias("nth")).where(F.col("nth") <= room)
        zeros = zeros.unionByName(short.where("has is not null").join(own, "has").where("nth <= room").select(qkey, key))
    zeros = zeros.join(scores.select(qkey, key), [qkey, key], "left_anti")
    return scores.unionByName(zeros.select(qkey, key, F.lit(0.0).alias("score")))


def _bm25(pool: DataFrame, queries: DataFrame, k: int, qkey: str, key: str, text: str, qtext: str, most: int | None, kind: str | None) -> DataFrame:
    """queries: qkey, qtext and, with kind, has."""
    tf = stored(postings(pool, key, text, *([kind] if kind else [])), "postings")
    stats = stored(corpus_stats(tf, pool, key), "bm25-stats")
    vocabulary = stored(idf(tf, stats).crossJoin(F.broadcast(stats.select("n"))), "bm25-vocabulary")
    whose = [qkey, "has"] if kind else [qkey]
    terms = query_terms(queries, qkey, qtext, most)
    if kind:
        terms = terms.join(queries.select(*whose), qkey)
    scores = bm25_scores(tf, stats, vocabulary, terms, k, qkey, key, kind)
    deep = (vocabulary.agg(F.min("idf")).first()[0] or 0.0) < 0
    # Without negative scores a query of fewer than k hits has all of them among its k best.
    scores = stored(scores if deep else top_k(scores, qkey, key, k).drop("rank"), "bm25-scores")
    return top_k(with_zeros(scores, queries.select(*whose), pool, qkey, key, k, deep, kind), qkey, key, k)


def bm25_topk(pool: DataFrame, queries: DataFrame, k: int, qkey: str, key: str = "row_idx", text: str = "text", qtext: str = "qtext", most: int | None = None) -> DataFrame:
    """qkey, key, score, rank of the k best of the pool for each query (a row per qkey)."""
    return _bm25(pool, queries.select(qkey, qtext), k, qkey, key, text, qtext, most, None)


def bm25_topk_by_type(pool: DataFrame, queries: DataFrame, k: int, qkey: str, qtype: str = "qtype", doctype: str = "doctype", key: str = "row_idx", most: int | None = None) -> DataFrame:
    """Candidates of the query's type, of any type where the pool has none of it; statistics of the whole pool.
    Documents of the type that share no term follow with score 0."""
    types = pool.select(F.col(doctype).alias("has")).distinct().where("has is not null")
    typed = queries.join(types, F.col(qtype) == F.col("has"), "left").select(qkey, "qtext", "has")
    return _bm25(pool, typed, k, qkey, key, "text", "qtext", most, doctype)


#: Queries that are broadcast at once; more than these are dealt in blocks against blocks of the pool.
QUERIES, ROWS = 1024, 65_536


def _nearest(q: np.ndarray, ids: np.ndarray, group: list | None, own: np.ndarray, x: np.ndarray, have: list | None, k: int, cosine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, row and score of the k best rows of a block for each query of a block."""
    if cosine:
        q = q / (np.linalg.norm(q, axis=1, keepdims=True) + 1e-12)
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-12)
    score = np.round(q @ x.T, 6) + 0.0
    if group is not None:
        number = {v: i for i, v in enumerate(dict.fromkeys([*group, *have]))}
        score[np.array([number[g] for g in group])[:, None] != np.array([number[h] for h in have])[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(own, score.shape), -score))[:, :k]
    s = np.take_along_axis(score, order, 1).ravel()
    real = s > -np.inf
    return np.repeat(ids, order.shape[1])[real], own[order.ravel()][real], s[real]


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, straight from the list's buffer."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def vector_topk(pool: DataFrame, queries: DataFrame, k: int, cosine: bool = True, within: str | None = None, most: int = QUERIES) -> DataFrame:
    """query_id, vec_id, score, rank.  pool and queries: vec_id, embedding (and the column `within`, whose
    values must agree).  Up to `most` queries are broadcast to where the pool is read; more are dealt in
    blocks of so many against blocks of the pool.  A block keeps its own k best per query before the last ranking."""
    cols, found = ["vec_id", "embedding", *([within] if within else [])], "query_id long, vec_id long, score double"
    names = ["query_id", "vec_id", "score"]
    queries, pool = queries.select(*cols).where("embedding is not null"), pool.select(*cols).where("embedding is not null")

    def table(parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[pa.Array]:
        return [pa.array(p, t) for p, t in zip(parts, (pa.int64(), pa.int64(), pa.float64()), strict=True)]

    rows = queries.limit(most + 1).collect()  # at most so many
    if len(rows) <= most:
        q = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
        shared = pool.sparkSession.sparkContext.broadcast((q, np.array([r["vec_id"] for r in rows], np.int64), [r[within] for r in rows] if within else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, ids, group = shared.value
            for b in batches:
                if b.num_rows and len(ids):
                    have = b.column(2).to_pylist() if within else None
                    yield pa.RecordBatch.from_arrays(table(_nearest(q, ids, group, b.column(0).to_numpy().astype(np.int64), _matrix(b.column(1)), have, k, cosine)), names)

        return top_k(pool.mapInArrow(run, found), "query_id", "vec_id", k)

    deals, blocks = -(-queries.count() // most), max(1, -(-pool.count() // ROWS))
    left = queries.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(deals)).alias("deal"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = pool.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(deals - 1).cast("long"))).alias("deal"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_arrays(table((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))), names=names)
        group, have = (a.column(within).to_pylist(), b.column(within).to_pylist()) if within else (None, None)
        ids, own = (t.column("vec_id").to_numpy().astype(np.int64) for t in (a, b))
        return pa.Table.from_arrays(table(_nearest(_matrix(a.column("embedding")), ids, group, own, _matrix(b.column("embedding")), have, k, cosine)), names=names)

    met = left.groupBy("deal", "block").cogroup(right.groupBy("deal", "block")).applyInArrow(meet, found)
    return top_k(met, "query_id", "vec_id", k)


def resolved(best: DataFrame, threshold: float) -> DataFrame:
    """One row: resolved, unresolved queries of a rank-1 table."""
    return best.agg(F.count_if(F.col("score") >= threshold).alias("resolved"), F.count_if(~(F.col("score") >= threshold)).alias("unresolved"))


def mapping(top: DataFrame, pool: DataFrame, qkey: str, key: str = "row_idx", title: str = "title") -> DataFrame:
    """Per query the best candidate and the ranked list as text."""
    named = top.join(pool.select(key, title), key)
    ranked = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", key, "score"))), lambda x: F.concat(x[key].cast("string"), F.lit(":"), F.format_string("%.6f", x["score"]))), "|")
    return named.groupBy(qkey).agg(F.min_by(key, "rank").alias("candidate_id"), F.min_by("score", "rank").alias("score"), F.min_by(title, "rank").alias("candidate_title"), ranked.alias("topk"))


def resolutions(top: DataFrame, pool: DataFrame, queries: DataFrame, qkey: str, key: str = "row_idx", title: str = "title", uri: str = "uri", qtext: str = "qtext") -> DataFrame:
    """Per query its text, the best candidate with its link, and the ranked candidates as structs."""
    named = top.join(pool.select(key, title, uri), key)
    ranked = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.col(uri).alias("uri"), "score", F.col(title).alias("candidate_title")))), lambda x: F.struct(x["uri"].alias("uri"), x["score"].alias("score"), x["candidate_title"].alias("candidate_title")))
    best = named.groupBy(qkey).agg(F.min_by(uri, "rank").alias("uri"), F.min_by("score", "rank").alias("score"), F.min_by(key, "rank").alias("candidate_id"), F.min_by(title, "rank").alias("candidate_title"), ranked.alias("topk"))
    return best.join(queries.select(qkey, F.col(qtext).alias("query_text")), qkey)


def candidate_text(metadata: Column) -> Column:
    """docType | docTitle | completions of one candidate's JSON; completions are JSON within JSON."""
    c = F.from_json(metadata, "struct<docType:string,docTitle:string,autoCompletions:string>")
    texts = F.transform(F.coalesce(F.from_json(c["autoCompletions"], "array<struct<text:string>>"), F.array()), lambda x: x["text"])
    parts = F.concat(F.array(c["docType"], c["docTitle"]), texts)
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (F.trim(x) != "")), " | ")
