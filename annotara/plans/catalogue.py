"""Queries: each operator applied to a whole table or fixture."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import chunking, coref, metadata, patterns, registry, retrieval, spans, stats
from ..sources.staging import spread
from . import fixtures as X

K = 3
FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    FOUND[f.__name__] = f
    return f


# -- retrieval


@query
def bm25_topk(spark, d):
    top = retrieval.bm25_topk(X.pool(spark, d), X.pool_queries(spark, d), K, "item_id")
    return top.select("item_id", "row_idx", "score", F.col("rank").cast("long").alias("rank"))


@query
def bm25_topk_doctype(spark, d):
    top = retrieval.bm25_topk_by_type(X.pool(spark, d), X.pool_queries(spark, d), K, "item_id")
    return top.select("item_id", "row_idx", "score", F.col("rank").cast("long").alias("rank"))


def _sparse_queries(spark, d):
    """Queries of a word that no document has, alone or with the text's first words."""
    own = F.concat(F.lit("qqzz"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" "), F.col("qtext"))).otherwise(F.lit("")))
    return X.pool_queries(spark, d).withColumn("qtext", own)


@query
def bm25_topk_unshared(spark, d):
    top = retrieval.bm25_topk(X.pool(spark, d), _sparse_queries(spark, d), K, "item_id", most=3)
    return top.select("item_id", "row_idx", "score", F.col("rank").cast("long").alias("rank"))


@query
def bm25_topk_doctype_unshared(spark, d):
    top = retrieval.bm25_topk_by_type(X.pool(spark, d), _sparse_queries(spark, d), K, "item_id", most=3)
    return top.select("item_id", "row_idx", "score", F.col("rank").cast("long").alias("rank"))


@query
def vector_topk_blocks(spark, d):
    """More queries than are broadcast: blocks of queries against blocks of the pool."""
    pool = X.table(spark, d, "embeddings")
    top = retrieval.vector_topk(pool, pool.where("vec_id % 50 = 0"), K, most=4)
    return top.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query
def bm25_corpus_stats(spark, d):
    pool = X.pool(spark, d)
    tf = retrieval.postings(pool)
    terms = retrieval.idf(tf, retrieval.corpus_stats(tf, pool))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def resolution_mapping(spark, d):
    pool = X.pool(spark, d)
    return retrieval.mapping(retrieval.bm25_topk(pool, X.pool_queries(spark, d), K, "item_id"), pool, "item_id")


def _vectors(spark, d, **options):
    pool = X.table(spark, d, "embeddings")
    top = retrieval.vector_topk(pool, pool.where("vec_id % 50 = 0"), K, **options)
    return top.select("query_id", "vec_id", "score", F.col("rank").cast("long").alias("rank"))


@query
def vector_topk_cosine(spark, d):
    return _vectors(spark, d)


@query
def vector_topk_dot(spark, d):
    return _vectors(spark, d, cosine=False)


@query
def vector_topk_label_filter(spark, d):
    return _vectors(spark, d, within="label")


@query
def score_threshold_resolution(spark, d):
    pool = X.table(spark, d, "embeddings")
    top = retrieval.vector_topk(pool, pool.where("vec_id % 50 = 0"), 2)
    return retrieval.resolved(top.where("rank = 2"), 0.9)


# -- tokens


@query
def token_kind_counts(spark, d):
    tokens = spread(X.table(spark, d, "documents").select("lang", "text")).select("lang", F.explode(T.tokenize(F.col("text"))).alias("t"))
    return tokens.groupBy("lang", T.token_kind(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("chars"))


@query
def token_freq_topk(spark, d):
    tokens = spread(X.table(spark, d, "documents").select("lang", "text")).select("lang", F.explode(T.tokenize(F.col("text"))).alias("token"))
    n = tokens.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("lang").orderBy(F.col("n").desc(), "token")
    return n.withColumn("rank", F.row_number().over(best)).where("rank <= 20").select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


@query
def clean_token_counts(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.size(T.clean_tokens(F.col("html"))).cast("long").alias("n_tokens"))


@query
def strip_tags_text_len(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.length(T.squeezed(T.without_tags(T.body_of(F.col("html"))))).cast("long").alias("n_chars"))


@query
def tag_name_counts(spark, d):
    tags = X.table(spark, d, "pages").select(F.explode(F.filter(T.tokenize(F.col("html")), T.is_tag)).alias("t"))
    return tags.groupBy(F.lower(T.tag_name(F.col("t"))).alias("tag"), T.is_closing(F.col("t")).alias("closing")).agg(F.count(F.lit(1)).alias("n"))


@query
def whitespace_normalise(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.md5(T.decode(T.normalized_spaces(T.clean_tokens(F.col("html"))))).alias("digest"))


@query
def upper_context_window(spark, d):
    t = T.tokenize(F.col("text"))
    at = (F.col("doc_id") * 7919 % F.greatest(F.size(t), F.lit(1)) + 1).cast("int")  # anywhere in the text
    return X.table(spark, d, "documents").select("doc_id", T.decode(T.preceding(t, at, 20)).alias("context"))


@query
def word_counts_by_split(spark, d):
    return X.table(spark, d, "documents").groupBy(F.col("source").alias("split")).agg(F.count(F.lit(1)).alias("documents"), F.sum(T.word_count(F.col("text"))).alias("words"))


# -- spans


def _counts(spark, d):
    return spans.match_counts(X.gold_spans(spark, d), X.system_spans(spark, d))


@query
def span_match_counts(spark, d):
    return _counts(spark, d)


@query
def span_prf_per_label(spark, d):
    return spans.scores_by(_counts(spark, d), "labelname")


@query
def span_prf_per_doc(spark, d):
    return spans.scores_by(_counts(spark, d), "doc_id")


@query
def span_prf_rollup(spark, d):
    return spans.rollup(_counts(spark, d))


@query
def span_macro_f1(spark, d):
    return spans.macro_f1(_counts(spark, d))


@query
def span_fn(spark, d):
    return spans.unmatched(X.gold_spans(spark, d), X.system_spans(spark, d)).select("doc_id", "seq", "labelname", "text")


@query
def span_fp(spark, d):
    return spans.unmatched(X.system_spans(spark, d), X.gold_spans(spark, d)).select("doc_id", "seq", "labelname", "text")


@query
def anchoring_rate(spark, d):
    return spans.anchoring(X.gold_spans(spark, d), X.system_spans(spark, d), X.system_spans(spark, d, "l"))


FIELDS = ["docid", "uri", "titletype"]


def _attributes(spark, d):
    return spans.attribute_rows(spans.pairs(X.gold_spans(spark, d), X.system_spans(spark, d), FIELDS), FIELDS)


@query
def attr_agreement_by_label_attr(spark, d):
    return spans.agreement(_attributes(spark, d), "labelname", "attr")


@query
def attr_agreement_by_category(spark, d):
    return spans.agreement(_attributes(spark, d).withColumn("category", spans.category(F.col("labelname"))), "category", "attr")


@query
def attr_macro(spark, d):
    return spans.macro_agreement(_attributes(spark, d))


def _outcomes(spark, d):
    return spans.uri_outcomes(X.gold_spans(spark, d), X.system_spans(spark, d))


@query
def uri_outcomes(spark, d):
    return _outcomes(spark, d).groupBy("labelname", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query
def uri_prf_overall(spark, d):
    return spans.uri_scores(_outcomes(spark, d))


@query
def uri_prf_by_category(spark, d):
    return spans.uri_scores(_outcomes(spark, d).withColumn("category", spans.category(F.col("labelname"))), "category")


# -- links and metadata


@query
def uri_audit_missing(spark, d):
    pages = X.table(spark, d, "pages")
    labels = pages.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.upper("url"), F.lit("/"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/missing"))).otherwise(F.lit("None")).alias("uri"))
    return metadata.missing_uris(labels, pages).select("page_id", "uri")


@query
def uri_unique_counts(spark, d):
    return metadata.uri_counts(X.gold_spans(spark, d))


@query
def uri_path_normalise(spark, d):
    return metadata.deduplicated_paths(X.table(spark, d, "pages"), "url")


@query
def pool_combine_shuffle(spark, d):
    rows = [X.table(spark, d, t).select(F.concat(F.lit(f"{t}/"), F.col(i).cast("string")).alias("url"), F.lit(t).alias("pool")) for t, i in (("benchmark", "item_id"), ("documents", "doc_id"))]
    return metadata.combined(rows, "url", 42).select("url", "pool", F.col("rank").cast("long").alias("rank"))


@query
def metadata_json_explode(spark, d):
    parsed = F.from_json("props", "struct<k:long>")
    return X.table(spark, d, "events").groupBy("event_type", parsed["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query
def range_slice(spark, d):
    from ..sources.readers import sliced

    return sliced(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 11, 60)


# -- registry


@query
def registry_values_first_seen(spark, d):
    v = registry.values(X.mentions(spark, d), X.FIELDS)
    return v.select("doc_id", "profile", "field", "value", "first_seen_id", F.col("ord").cast("long").alias("ord"))


@query
def registry_profiles(spark, d):
    p = registry.profiles(X.mentions(spark, d), X.FIELDS)
    return p.select("doc_id", "docid", "doc_type", "first_seen_id", "n_mentions", "main_title", *[registry.written(F.col(c)).alias(c) for c in ("titles", "citations", "fragments")])


@query
def registry_snapshot_before(spark, d):
    m = X.mentions(spark, d)
    first = registry.keyed(m).groupBy("doc_id", "profile").agg(F.min("mention_id").alias("first_seen_id"))
    a = registry.snapshot_before(m, first, "profiles_before")
    b = registry.snapshot_before(m, registry.values(m, X.FIELDS), "values_before")
    return a.join(b, ["doc_id", "mention_id"])


@query
def registry_query_text(spark, d):
    p = registry.profiles(X.mentions(spark, d), X.FIELDS)
    return p.select("doc_id", "docid", registry.query_text(p).alias("query_text"))


@query
def registry_last_fragments(spark, d):
    p = registry.profiles(X.mentions(spark, d), X.FIELDS)
    return p.select("doc_id", "docid", registry.written(registry.last_values(F.col("fragments"), 2)).alias("fragments"))


# -- clusters


@query
def clusters_from_mapping(spark, d):
    rows = X.mentions(spark, d).withColumn("docid", F.when(F.col("mention_id") % 5 != 4, F.col("docid")))
    return coref.clusters(rows)


def _both(spark, d, **options):
    return coref.aligned(*X.coref(spark, d, **options))


@query
def mention_alignment_stats(spark, d):
    return coref.alignment(_both(spark, d), "doc_id")


def _links(spark, d):
    return coref.link_counts(coref.span_mode(_both(spark, d)))


@query
def coref_muc(spark, d):
    return coref.finalised(_links(spark, d), "muc", "doc_id")


@query
def coref_b3(spark, d):
    return coref.finalised(_links(spark, d), "b3", "doc_id")


@query
def coref_lea(spark, d):
    return coref.finalised(_links(spark, d), "lea", "doc_id")


@query
def coref_micro_conll_parts(spark, d):
    counts = _links(spark, d)
    out = None
    for m in ("muc", "b3", "lea"):
        own = coref.finalised(counts, m).select(F.lit(m).alias("metric"), "precision", "recall", "f1")
        out = own if out is None else out.unionByName(own)
    return out


@query
def coref_ceafe(spark, d):
    return coref.finalised(coref.ceafe_counts(_both(spark, d, of=6, drop=False)), "ceafe", "doc_id")


@query
def coref_ceafe_full(spark, d):
    """All ten labels, with mentions that a side lacks."""
    return coref.finalised(coref.ceafe_counts(coref.span_mode(_both(spark, d))), "ceafe", "doc_id")


@query
def coref_conll(spark, d):
    return coref.conll(coref.span_mode(_both(spark, d)))


# -- chunks


def _by_doc(spark, d):
    rows = X.lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "norm"))).alias("s"))
    return rows.select("doc_id", F.transform("s", lambda x: x["norm"]).alias("lines"))


@query
def chunk_paragraph_merge(spark, d):
    sized = _by_doc(spark, d).select("doc_id", F.transform("lines", lambda x: F.size(F.split(x, " "))).alias("sizes"))
    return chunking.paragraph_chunks(sized, 100, "sizes", "doc_id")


@query
def citation_sections(spark, d):
    sections = _by_doc(spark, d).select("doc_id", chunking.citation_section(F.col("lines"), 4.0, 3).alias("s"))
    return sections.select("doc_id", "s.first", "s.last").where("first is not null")


# -- patterns


def _frequencies(rows):
    n = patterns.frequencies(rows)
    return n.select("key", "pattern", "n", "score", F.col("rank").cast("long").alias("rank"))


@query
def pattern_fragment_freq(spark, d):
    text = F.concat(F.element_at(F.array(*map(F.lit, ("s. ", "ss. ", "Section ", "para. ", "Article ", "pp. ", "rule ", "Schedule ii, "))), (F.col("p_partkey") % 8 + 1).cast("int")), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit("(1)")).when(F.col("p_partkey") % 3 == 1, F.lit(".5")).otherwise(F.lit(" to 9")))
    rows = X.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.array_join(patterns.pattern(text, "fragment"), " ").alias("pattern"), F.col("p_partkey").alias("seq"))
    return _frequencies(rows)


@query
def pattern_citation_freq(spark, d):
    text = F.concat(F.lit("["), (F.col("p_size") + 1950).cast("string"), F.lit("] "), F.element_at(F.array(*map(F.lit, ("2 S.C.R. ", "SCC ", "O.R. (2d) ", "CanLII "))), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.lit(" (C.A.)")).otherwise(F.lit("")))
    rows = X.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.array_join(patterns.pattern(text, "decision_citation"), " ").alias("pattern"), F.col("p_partkey").alias("seq"))
    return _frequencies(rows)


@query
def pattern_title_freq(spark, d):
    text = F.concat("p_name", F.element_at(F.array(*map(F.lit, (" v. Crown", " c. Ville de Hull", "; Ex parte", " (2001)"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    rows = X.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.array_join(patterns.pattern(text, "decision_title"), " ").alias("pattern"), F.col("p_partkey").alias("seq"))
    return _frequencies(rows)


@query
def structural_pattern_freq(spark, d):
    roles = X.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    rows = roles.select(F.lit("conversation").alias("key"), F.array_join(patterns.without_runs(F.transform("t", lambda x: x["role"])), " > ").alias("pattern"), F.col("conv_id").alias("seq"))
    return _frequencies(rows)


def _items(spark, d):
    docs = X.table(spark, d, "documents")
    each = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("source="), "source"), F.concat(F.lit("size="), F.floor(F.col("n_chars") / 1000).cast("string")))
    items = docs.select(F.col("doc_id").alias("example"), F.explode(each).alias("item"))
    n = items.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    return items, n.select("item", F.round(F.col("n") * 100.0 / docs.count(), 2).alias("weight"))


@query
def greedy_coverage_3(spark, d):
    return patterns.greedy(*_items(spark, d), 3)


@query
def coverage_curve(spark, d):
    items, weights = _items(spark, d)
    return patterns.coverage_curve(items.withColumnRenamed("example", "step"), weights)


# -- statistics


def _doc_counts(spark, d):
    return _counts(spark, d).groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_system")])


@query
def bootstrap_micro_f1(spark, d):
    return stats.bootstrap_f1(_doc_counts(spark, d), 200)


@query
def bootstrap_micro_f1_full(spark, d):
    """The reference's number of replicates."""
    return stats.bootstrap_f1(_doc_counts(spark, d), 10_000)


@query
def productivity_rates(spark, d):
    events = X.table(spark, d, "events")
    docs = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("event_type") == "purchase").alias("spans"), F.round(F.sum("value") / 3600, 9).alias("hours"))
    return stats.productivity(docs.withColumn("team", F.col("user_id") % 4), "team")


@query
def component_coverage(spark, d):
    rows = X.table(spark, d, "conversations").select(F.col("conv_id").alias("parent"), F.col("role").alias("kind"))
    return stats.coverage(rows, rows)


@query
def label_distribution_pivot(spark, d):
    rows = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").pivot("quality", [0, 1]).agg(F.count(F.lit(1))).select("lang", F.coalesce("0", F.lit(0)).alias("low"), F.coalesce("1", F.lit(0)).alias("high"))


@query
def label_totals_rollup(spark, d):
    rows = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.rollup("lang", "toxic").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce(F.col("toxic").cast("string"), F.lit("all")).alias("toxic"), "n")


@query
def history_summary(spark, d):
    kinds = F.when(F.col("event_type") == "purchase", F.lit(None)).otherwise(F.col("event_type"))
    rows = X.table(spark, d, "events").select(kinds.alias("error_type"), (F.col("event_id") % 3 == 0).alias("fallback_used"), (F.col("value") > 50).alias("fallback_passed"))
    return stats.history_summary(rows)
