"""Further queries: registries as JSON, files written and read again, streams, clusters, patterns, texts of models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import chunking, coref, metadata, patterns, registry, retrieval, spans, stats
from ..sources import readers, sinks
from ..sources.staging import qualified, shared_dir
from ..streaming import rates
from . import drivers
from . import fixtures as X
from .oracles import COS, LINES, MENTIONS, NUMBERED, POOL, PROFILES, TOP, frequencies, ratio, side, system, vectors
from .oracles import SQL as SQL_OF
from .oracles import coref as coref_sql
from .oracles import counts as counts_sql
from .oracles import finalised as finalised_sql

FOUND: dict = {}
SQL: dict[str, str] = {"bootstrap_micro_f1_full": SQL_OF["bootstrap_micro_f1"].replace("range(200)", "range(10000)")}


def query(f):
    FOUND[f.__name__] = f
    return f


# -- registries


def _profiles(spark, d):
    m = X.mentions(spark, d)
    return registry.profiles(m, X.FIELDS), registry.values(m, X.FIELDS)


@query
def registry_json_round_trip(spark, d):
    """Written as JSON and read again: every value with its first mention and place."""
    p, v = registry.from_json(registry.as_json(*_profiles(spark, d)))
    both = v.join(p.select("doc_id", "nth", "docid", "doc_type"), ["doc_id", "nth"])
    return both.select("doc_id", "docid", "doc_type", "field", "value", "first_seen_id", F.col("ord").cast("long").alias("ord"))


SQL["registry_json_round_trip"] = f"WITH {PROFILES} SELECT doc_id, docid, profiles.doc_type, field, value, vals.first_seen_id, ord FROM vals JOIN profiles USING (doc_id, docid)"


@query
def registry_json_older_form(spark, d):
    """Lists instead of maps: values without first mentions, in order; the main title is the first."""
    rows = X.mentions(spark, d).where("title is not null").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit('"'), "title", F.lit('"')))), ",").alias("t"))
    old = rows.select("doc_id", F.concat(F.lit('{"profiles":[{"doc_type":"decision","docid":"D","alternative_titles":['), "t", F.lit('],"citations":null}]}')).alias("registry"))
    p, v = registry.from_json(old)
    return v.join(p, ["doc_id", "nth"]).select("doc_id", "docid", "main_title", "field", "value", F.coalesce(v["first_seen_id"], F.lit(-1)).alias("first_seen_id"), F.col("ord").cast("long").alias("ord"))


SQL["registry_json_older_form"] = f"""WITH {MENTIONS}, t AS (SELECT DISTINCT doc_id, title FROM mentions WHERE title IS NOT NULL)
SELECT doc_id, 'D' AS docid, first_value(title) OVER w AS main_title, 'title' AS field, title AS value, -1::BIGINT AS first_seen_id, row_number() OVER w AS ord FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY title)"""


@query
def registry_main_titles(spark, d):
    return registry.named_by_title(_profiles(spark, d)[0]).select("doc_id", "docid", "doc_type", "first_seen_id", "n_mentions")


SQL["registry_main_titles"] = f"WITH {PROFILES} SELECT doc_id, coalesce(main_title, docid) AS docid, doc_type, first_seen_id, n_mentions FROM profiles"


@query
def registry_snapshots_by_type(spark, d):
    """What every mention finds of its own type: profiles and their values until then."""
    m = X.mentions(spark, d)
    first = registry.keyed(m).groupBy("doc_id", "profile").agg(F.min("mention_id").alias("first_seen_id"), F.min("docid").alias("docid"), F.min_by("doc_type", "mention_id").alias("doc_type"))
    rows = registry.snapshots(m, first, registry.values(m, X.FIELDS), same_type=True)
    return rows.select("doc_id", "mention_id", "docid", "doc_type", "first_seen_id", F.array_join(F.transform("values", lambda x: F.concat(x["field"], F.lit("="), x["value"], F.lit("@"), x["first_seen_id"].cast("string"))), "|").alias("found"))


SQL["registry_snapshots_by_type"] = f"""WITH {PROFILES}
SELECT m.doc_id, m.mention_id, p.docid, p.doc_type, p.first_seen_id, coalesce(string_agg(v.field || '=' || v.value || '@' || v.first_seen_id, '|' ORDER BY v.field, v.ord) FILTER (v.value IS NOT NULL), '') AS found
FROM mentions m JOIN profiles p ON p.doc_id = m.doc_id AND p.doc_type = m.doc_type AND p.first_seen_id < m.mention_id
LEFT JOIN vals v ON v.doc_id = p.doc_id AND v.docid = p.docid AND v.first_seen_id < m.mention_id GROUP BY ALL"""


@query
def registry_null_docids(spark, d):
    """Every third mention lacks a docid, others have it with entities and blanks around: nulls never merge."""
    docid = F.when(F.col("mention_id") % 3 != 0, F.concat(F.lit(" A &amp; "), "docid", F.lit(" ")))
    p = registry.profiles(X.mentions(spark, d).withColumn("docid", docid), X.FIELDS)
    return p.select("doc_id", "docid", "first_seen_id", "n_mentions", "main_title")


SQL["registry_null_docids"] = f"""WITH {MENTIONS}, m AS (SELECT * REPLACE (CASE WHEN mention_id % 3 <> 0 THEN 'A & ' || docid END AS docid) FROM mentions), k AS (SELECT *, coalesce('d' || docid, 'm' || mention_id) AS k FROM m)
SELECT doc_id, any_value(docid) AS docid, min(mention_id) AS first_seen_id, count(*) AS n_mentions, arg_min(title, (mention_id, title)) FILTER (title IS NOT NULL) AS main_title FROM k GROUP BY doc_id, k"""


@query
def prompt_profiles(spark, d):
    p, _ = _profiles(spark, d)
    return p.select("doc_id", "docid", F.get_json_object(drivers.prompt_profiles(p, 2), "$.fragments").alias("fragments"), F.get_json_object(drivers.prompt_profiles(p, 2), "$.main_title").alias("main_title"))


SQL["prompt_profiles"] = f"""WITH {PROFILES} SELECT doc_id, docid, CASE WHEN fragment_list IS NOT NULL THEN '["' || array_to_string(fragment_list[greatest(len(fragment_list) - 1, 1):], '","') || '"]' END AS fragments, main_title FROM profiles"""

# -- scans and sinks


@query
def csv_round_trip(spark, d):
    """Pages as CSV with JSON in a column, read with the required columns checked, one row per candidate."""
    path = shared_dir(spark, "csv")
    inner = F.to_json(F.array(F.struct(F.concat(F.lit('say "'), F.col("url"), F.lit('", ok')).alias("text"))))
    docs = F.to_json(F.array(F.struct(F.col("page_id").cast("string").alias("id"), F.lit("DECISION").alias("docType"), F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("docTitle"), inner.alias("autoCompletions"))))
    rows = X.table(spark, d, "pages").select(F.col("url").alias("original_url"), F.when(F.col("page_id") % 7 == 0, F.lit("{broken")).otherwise(docs).alias("metadata"))
    rows.write.option("header", "true").option("escape", '"').csv(path)
    found = metadata.candidates(readers.csv_pool(spark, path))
    return found.select("original_url", "id", "docTitle", "metadata_text")


SQL["csv_round_trip"] = """SELECT url AS original_url, page_id::VARCHAR AS id, 'Page ' || page_id AS docTitle, 'DECISION | Page ' || page_id || ' | say "' || url || '", ok' AS metadata_text FROM pages WHERE page_id % 7 <> 0"""


@query
def solr_documents(spark, d):
    """Search responses: their documents, and how many rows were dropped."""
    one = F.struct(F.col("page_id").cast("string").alias("id"), F.lit("CASE").alias("docType"), F.col("url").alias("docTitle"))
    good = F.to_json(F.struct(F.struct(F.array(one, one).alias("docs")).alias("response")))
    rows = X.table(spark, d, "pages").select(F.col("url").alias("original_url"), F.when(F.col("page_id") % 5 == 0, F.lit("oops")).when(F.col("page_id") % 5 == 1, F.lit("{}")).otherwise(good).alias("metadata"))
    kept, report = metadata.solr_rows(rows)
    n = metadata.candidates(kept).groupBy("original_url").agg(F.count(F.lit(1)).alias("documents"), F.min("metadata_text").alias("text"))
    return n.crossJoin(report)


SQL["solr_documents"] = """SELECT url AS original_url, count(*) * 2 AS documents, 'CASE | ' || url AS text, (SELECT count(*) FROM pages) AS read, (SELECT count(*) FROM pages WHERE page_id % 5 < 2) AS dropped FROM pages WHERE page_id % 5 >= 2 GROUP BY url"""


@query
def alternative_urls(spark, d):
    final = F.when(F.col("page_id") % 3 == 0, F.lit(" ")).when(F.col("page_id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "url"))
    rows = X.table(spark, d, "pages").select("page_id", final.alias("final_url"), F.when(F.col("page_id") % 2 == 0, F.upper("url")).alias("normalized_final_url"))
    return metadata.final_urls(rows).select("page_id", "original_url")


SQL["alternative_urls"] = "SELECT page_id, CASE WHEN page_id % 3 = 2 THEN url ELSE upper(url) END AS original_url FROM pages WHERE page_id % 3 = 2 OR page_id % 2 = 0"


@query
def cluster_files(spark, d):
    """Clusters written as one JSON file per document and read again."""
    path = qualified(spark, shared_dir(spark, "clusters"))
    sinks.write_links(X.mentions(spark, d).select("doc_id", "mention_id", F.when(F.col("mention_id") % 5 != 4, F.col("docid")).alias("docid")), path)
    rows = readers.cluster_files(spark, path + "/*_coref_clusters.json")
    return rows.groupBy(F.col("stem").cast("long").alias("doc_id"), "cluster").agg(F.array_join(F.array_sort(F.collect_list("mention_id")), ",").alias("members")).drop("cluster")


SQL["cluster_files"] = f"""WITH {MENTIONS}, k AS (SELECT doc_id, mention_id, CASE WHEN mention_id % 5 <> 4 THEN 'd:' || docid ELSE 'm:' || mention_id END AS c FROM mentions)
SELECT doc_id, string_agg(mention_id::VARCHAR, ',' ORDER BY mention_id::VARCHAR) AS members FROM k GROUP BY doc_id, c"""


@query
def resolution_files(spark, d):
    """Best and ranked candidates with their links, written as one JSON file per group of queries and read again."""
    path = qualified(spark, shared_dir(spark, "resolutions"))
    pool, q = X.pool(spark, d).withColumn("uri", F.concat(F.lit("https://ex.org/"), "row_idx")), X.pool_queries(spark, d)
    found = retrieval.resolutions(retrieval.bm25_topk(pool, q, 3, "item_id"), pool, q, "item_id")
    sinks.write_resolutions(found.select((F.col("item_id") % 7).alias("doc_id"), F.concat(F.lit("D "), F.col("item_id")).alias("docid"), "uri", "score", "candidate_id", "candidate_title", "query_text", "topk"), path)
    rows = sinks.read_resolutions(spark, path + "/*_resolution.json")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "docid", "uri", "score", "candidate_id", "candidate_title", F.md5("query_text").alias("query_text"), F.array_join(F.transform("topk", lambda x: x["uri"]), " ").alias("topk"))


SQL["resolution_files"] = f"""WITH {POOL}, {TOP}, t AS (SELECT *, 'https://ex.org/' || row_idx AS uri FROM top JOIN pool USING (row_idx))
SELECT item_id % 7 AS doc_id, 'D ' || item_id AS docid, arg_min(uri, rank) AS uri, arg_min(score, rank) AS score, arg_min(row_idx, rank) AS candidate_id, arg_min(title, rank) AS candidate_title, md5(any_value(benchmark.text)) AS query_text, string_agg(uri, ' ' ORDER BY rank) AS topk
FROM t JOIN benchmark USING (item_id) GROUP BY item_id"""


@query
def pairs_in_folders(spark, d):
    """System files each in a folder of its stem's name, of one task."""
    pages = X.table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("stem"))
    gold = pages.select("stem", F.concat(F.lit("g"), "stem").alias("html"))
    name = F.concat("stem", F.when(F.col("page_id") % 3 == 0, "_coref").otherwise("_resolution"))
    system = pages.select(name.alias("stem"), F.concat(F.lit("out/"), "stem", F.lit("/"), name, F.lit(".html")).alias("path"), F.concat(F.lit("s"), "stem").alias("html"))
    pairs, alone = readers.paired(gold, system, "coref", folders=True)
    return pairs.select("stem", "gold", "system").unionByName(alone.select("stem", F.lit("").alias("gold"), F.lit("").alias("system")))


SQL["pairs_in_folders"] = "SELECT 'p' || page_id AS stem, CASE WHEN page_id % 3 = 0 THEN 'gp' || page_id ELSE '' END AS gold, CASE WHEN page_id % 3 = 0 THEN 'sp' || page_id ELSE '' END AS system FROM pages"


@query
def unlisted_stems(spark, d):
    pages = X.table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("stem"), "page_id")
    return readers.unlisted(pages, pages.where("page_id % 2 = 0"), pages.where("page_id % 3 = 0"))


SQL["unlisted_stems"] = "SELECT 'p' || page_id AS stem FROM pages WHERE page_id % 2 <> 0 AND page_id % 3 <> 0"


@query
def html_files(spark, d):
    """Pages written as files, some in Latin-1, and found again by split and stem."""
    path = qualified(spark, shared_dir(spark, "html"))
    ascii_ = F.regexp_replace("html", r"[^\x00-\x7F]", "é")
    data = F.when(F.col("page_id") % 2 == 0, F.encode(ascii_, "ISO-8859-1")).otherwise(F.encode(ascii_, "UTF-8"))
    split = F.element_at(F.array(*map(F.lit, ("test", "train", "skip"))), (F.col("page_id") % 3 + 1).cast("int"))
    rows = X.table(spark, d, "pages").select(F.concat(split, F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html")).alias("file"), data.alias("data"))
    sinks.write_files(rows, path, "file", "data")
    docs = readers.first_split(readers.html_documents(spark, path, ("skip",)))
    listed = readers.listing(docs, "test").select("stem", F.col("n").alias("nth"))
    return docs.join(listed, "stem", "left").select("split", "stem", F.md5("html").alias("digest"), F.coalesce("nth", F.lit(0)).alias("nth"))


SQL["html_files"] = """WITH p AS (SELECT ['test', 'train', 'skip'][(page_id % 3 + 1)::INT] AS split, 'p' || page_id AS stem, md5(regexp_replace(html, '[^\\x00-\\x7F]', 'é', 'g')) AS digest FROM pages)
SELECT split, stem, digest, CASE WHEN split = 'test' THEN row_number() OVER (PARTITION BY split ORDER BY stem) ELSE 0 END AS nth FROM p WHERE split <> 'skip'"""


@query
def detected_charsets(spark, d):
    """Bytes in five charsets, each found and decoded to the same text."""
    words = F.concat(F.lit("<meta charset=iso-8859-15> café naïve “x” "), F.col("page_id").cast("string"))
    latin = F.concat(F.lit("café naïve "), F.col("page_id").cast("string"))
    kind = F.col("page_id") % 4
    data = F.when(kind == 0, F.encode(words, "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(words, "UTF-8"))).when(kind == 2, F.encode(latin, "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode(words, "UTF-16LE")))
    rows = readers.with_charset(X.table(spark, d, "pages").select("page_id", data.alias("content")))
    return rows.select("page_id", "charset", "html")


SQL["detected_charsets"] = """SELECT page_id, ['utf-8', 'utf-8-sig', 'iso-8859-1', 'utf-16'][(page_id % 4 + 1)::INT] AS charset, CASE WHEN page_id % 4 = 2 THEN 'café naïve ' ELSE '<meta charset=iso-8859-15> café naïve “x” ' END || page_id AS html FROM pages"""


@query
def resumed_stage(spark, d):
    """A stage over a part of the documents, then over all: rows that are there stay as they were."""
    path, docs = shared_dir(spark, "stage"), X.table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    sinks.resumed(docs.where("doc_id % 3 = 0"), path, "doc_id", lambda x: x.withColumn("run", F.lit(1)))
    return sinks.resumed(docs, path, "doc_id", lambda x: x.withColumn("run", F.lit(2))).select("doc_id", F.col("n").cast("long").alias("n"), F.col("run").cast("long").alias("run"))


SQL["resumed_stage"] = "SELECT doc_id, length(text) AS n, CASE WHEN doc_id % 3 = 0 THEN 1::BIGINT ELSE 2::BIGINT END AS run FROM documents"


@query
def history_files(spark, d):
    """Records as JSON lines with long outputs cut to a note, read again."""
    path = shared_dir(spark, "history")
    rows = X.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("chunk"), F.col("text").alias("raw_output"))
    sinks.write_history(rows, path, 200)
    return spark.read.schema("chunk long, raw_output string, doc_id long").json(path).select("doc_id", "chunk", "raw_output")


SQL["history_files"] = "SELECT item_id AS doc_id, 0::BIGINT AS chunk, CASE WHEN length(text) > 200 THEN '[Output truncated - ' || length(text) || ' chars]' ELSE text END AS raw_output FROM benchmark"


@query
def report_files(spark, d):
    """A small result as one CSV file with header, read again."""
    path = shared_dir(spark, "report")
    sinks.write_report(X.table(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.option("header", "true").schema("lang string, source string, n long").csv(path)


SQL["report_files"] = "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL"


@query
def gold_system_pairs(spark, d):
    """Stems without their stage's suffix; of several files the last, and gold files without any."""
    pages = X.table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("stem"))
    gold = pages.select("stem", F.concat(F.lit("g"), "stem").alias("html"))
    suffix = F.array(F.lit("_final"), F.lit("_0"), F.lit("_coref"), F.lit(""))
    first = pages.where("page_id % 5 <> 0").select(F.concat("stem", F.element_at(suffix, (F.col("page_id") % 4 + 1).cast("int"))).alias("stem"), F.lit("a").alias("path"), F.lit("old").alias("html"))
    second = pages.where("page_id % 5 = 1").select(F.concat("stem", F.lit("_resolution")).alias("stem"), F.lit("b").alias("path"), F.lit("new").alias("html"))
    pairs, alone = readers.paired(gold, first.unionByName(second))
    return pairs.select("stem", "gold", "system").unionByName(alone.select("stem", F.lit("").alias("gold"), F.lit("").alias("system")))


SQL["gold_system_pairs"] = """SELECT 'p' || page_id AS stem, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'gp' || page_id END AS gold, CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'new' ELSE 'old' END AS system FROM pages"""


@query
def splits_of_folders(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("train_gemma", "no-gold_x", "extended_test", "other_run", "dev"))), (F.col("page_id") % 5 + 1).cast("int"))
    return X.table(spark, d, "pages").select("page_id", readers.split_of(name).alias("split"))


SQL["splits_of_folders"] = "SELECT page_id, ['train', 'no-gold', NULL, NULL, 'dev'][(page_id % 5 + 1)::INT] AS split FROM pages"


@query
def range_to_the_end(spark, d):
    return readers.sliced(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 31)


SQL["range_to_the_end"] = "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE n >= 31"


@query
def uncached_chunks(spark, d):
    docs = X.table(spark, d, "documents").select("doc_id", "lang")
    return chunking.missing_from(docs, docs.where("doc_id % 4 = 1"), "doc_id")


SQL["uncached_chunks"] = "SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 1"

# -- chunks


@query
def sentence_chunk_texts(spark, d):
    """Sentence chunks put together are the text, and each but the last has its tokens and ends a sentence."""
    docs = X.table(spark, d, "documents").select("doc_id", "text")
    rows = drivers.sentences(docs, "text", 50).withColumn("n", F.size(T.tokenize(F.col("text")))).withColumn("stop", F.rtrim(F.regexp_replace("text", r"\s+$", "")).endswith("."))
    joined = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "text", "n", "stop"))).alias("c"))
    early = F.slice("c", 1, F.size("c") - 1)
    return joined.select("doc_id", F.md5(F.array_join(F.transform("c", lambda x: x["text"]), "")).alias("digest"), F.forall(early, lambda x: (x["n"] >= 50)).alias("full"))


SQL["sentence_chunk_texts"] = "SELECT doc_id, md5(text) AS digest, true AS full FROM documents WHERE text <> ''"


@query
def citation_sections_25(spark, d):
    """The threshold that is the default, on lines whose letters a to m are digits."""
    rows = X.lines(spark, d).withColumn("norm", F.regexp_replace("norm", "[a-m]", "1"))
    lines = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "norm"))).alias("s")).select("doc_id", F.transform("s", lambda x: x["norm"]).alias("lines"))
    return lines.select("doc_id", chunking.citation_section(F.col("lines")).alias("s")).select("doc_id", "s.first", "s.last").where("first is not null")


SQL["citation_sections_25"] = rf"""WITH RECURSIVE {LINES},
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS i, length(norm) >= 10 AND 100.0 * length(regexp_replace(norm, '[^.0-9a-m]', '', 'g')) / length(norm) >= 25.0 AS dense FROM lines),
fold AS (SELECT doc_id, -1::BIGINT AS i, NULL::BIGINT AS first, NULL::BIGINT AS last, 0 AS below, false AS closed FROM (SELECT DISTINCT doc_id FROM s)
  UNION ALL SELECT s.doc_id, s.i, CASE WHEN f.first IS NULL AND dense AND NOT closed THEN s.i ELSE f.first END, CASE WHEN dense AND NOT closed THEN s.i ELSE f.last END,
    CASE WHEN dense AND NOT closed THEN 0 WHEN f.first IS NOT NULL AND NOT closed THEN below + 1 ELSE below END,
    closed OR (f.first IS NOT NULL AND NOT dense AND below + 1 >= 3) FROM fold f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i + 1)
SELECT doc_id, max(first) AS first, max(last) AS last FROM fold GROUP BY doc_id HAVING max(first) IS NOT NULL"""

# -- spans


@query
def anchoring_rollup(spark, d):
    return spans.anchoring_rollup(X.gold_spans(spark, d), X.system_spans(spark, d), X.system_spans(spark, d, "l"))


SQL["anchoring_rollup"] = f"""{NUMBERED}, {system('llm', 'l')},
extra AS (SELECT a.* FROM sn a ANTI JOIN gn b USING (doc_id, labelname, text, context, nth)), {counts_sql('llm', 'extra')},
t AS (SELECT coalesce(doc_id::VARCHAR, 'all') AS doc, coalesce(labelname, 'all') AS labelname, sum(tp)::BIGINT AS anchored, sum(n_system)::BIGINT AS extra FROM counts GROUP BY GROUPING SETS ((), (doc_id), (labelname)))
SELECT *, round({ratio('anchored', 'extra')}, 6) AS rate FROM t WHERE extra > 0"""


@query
def anchoring_by_id(spark, d):
    """Spans with their place as id: an assisted span is the machine's own if the machine has one there."""
    def named(rows):
        return rows.withColumn("id", F.col("seq").cast("string"))

    return spans.anchoring_by_id(named(X.gold_spans(spark, d)), named(X.system_spans(spark, d)), named(X.system_spans(spark, d, "l")))


SQL["anchoring_by_id"] = f"""{NUMBERED}, {system('llm', 'l')},
extra AS (SELECT a.* FROM sn a ANTI JOIN gn b USING (doc_id, labelname, text, context, nth)),
t AS (SELECT labelname, count(*) FILTER (seq IN (SELECT seq FROM llm WHERE llm.doc_id = extra.doc_id)) AS anchored, count(*) AS extra FROM extra GROUP BY 1)
SELECT *, round({ratio('anchored', 'extra')}, 6) AS rate FROM t"""


@query
def attr_agreement_by_parent(spark, d):
    """Categories of child spans by the first of their comma-separated parents."""
    parent = F.element_at(F.array(*map(F.lit, ("decision, title", "legislation", "", "title,decision"))), (F.col("doc_id") % 4 + 1).cast("int"))
    fields = ["docid", "uri", "titletype"]
    rows = spans.attribute_rows(spans.pairs(X.gold_spans(spark, d), X.system_spans(spark, d), fields), fields)
    return spans.agreement(rows.withColumn("category", spans.category(F.col("labelname"), parent)), "category")


SQL["attr_agreement_by_parent"] = f"""{NUMBERED},
m AS (SELECT g.doc_id, g.labelname, g.docid AS gd, s.docid AS sd, g.uri AS gu, s.uri AS su, g.titletype AS gt, s.titletype AS ss FROM gn g JOIN sn s USING (doc_id, labelname, text, context, nth)),
a AS (SELECT doc_id, labelname, gd AS g, sd AS s FROM m UNION ALL SELECT doc_id, labelname, gu, su FROM m UNION ALL SELECT doc_id, labelname, gt, ss FROM m),
c AS (SELECT CASE WHEN labelname IN ('decision', 'legislation', 'secondary sources') THEN labelname WHEN doc_id % 4 = 0 THEN 'decision' WHEN doc_id % 4 = 1 THEN 'legislation' ELSE 'other' END AS category,
  coalesce(lower(trim(g)) = lower(trim(s)), false)::INT AS agree FROM a WHERE g IS NOT NULL OR s IS NOT NULL)
SELECT category, sum(agree)::BIGINT AS agree, count(*) AS total, round(sum(agree)::DOUBLE / count(*), 6) AS accuracy FROM c GROUP BY 1"""

# -- clusters


@query
def coref_dropped(spark, d):
    """Mentions that one side lacks are dropped from both."""
    both = coref.span_mode(coref.aligned(*X.coref(spark, d)), "drop")
    return coref.finalised(coref.link_counts(both), "b3", "doc_id")


SQL["coref_dropped"] = finalised_sql("b3").replace("coalesce(gold::VARCHAR, 'only:' || mention_id) AS gold, coalesce(system::VARCHAR, 'only:' || mention_id) AS system FROM pair", "gold::VARCHAR AS gold, system::VARCHAR AS system FROM pair WHERE gold IS NOT NULL AND system IS NOT NULL")


@query
def coref_conll_small(spark, d):
    """CoNLL over six clusters a document."""
    return coref.conll(coref.aligned(*X.coref(spark, d, of=6, drop=False))).select("muc_f1", "b3_f1", "ceafe_f1", "lea_f1", "conll_f1")


def _f1(metric: str, rows: str) -> str:
    return f"{metric}_u AS (SELECT {ratio('sum(p_num)', 'sum(p_den)')} AS p, {ratio('sum(r_num)', 'sum(r_den)')} AS r FROM {rows}), {metric}_f AS (SELECT round({ratio('2 * p * r', 'p + r')}, 6) AS f1 FROM {metric}_u)"


def _assigned(of: str, drop: bool) -> str:
    """The SQL of coref_ceafe over other clusters, up to its totals per document, with the sides of the link metrics;
    mentions that a side lacks are clusters of their own."""
    pairs = "tab AS (SELECT doc_id, coalesce(gold::VARCHAR, 'only:' || mention_id) AS gold, coalesce(system::VARCHAR, 'only:' || mention_id) AS system, count(*) AS n FROM pair GROUP BY ALL)"
    sql = SQL_OF["coref_ceafe"].replace(coref_sql("6", False), coref_sql(of, drop))
    return sql.replace("tab AS (SELECT doc_id, gold, system, count(*) AS n FROM pair GROUP BY ALL)", f"{pairs}, {side('rec', 'gold', 'system')}, {side('pre', 'system', 'gold')}")


def _conll(of: str, drop: bool) -> str:
    head = _assigned(of, drop).split("\nu AS (")[0].rstrip(",")
    links = ", ".join(_f1(m, f"(SELECT pre.{m}_num AS p_num, pre.{m}_den AS p_den, rec.{m}_num AS r_num, rec.{m}_den AS r_den FROM pre JOIN rec USING (doc_id))") for m in ("muc", "b3", "lea"))
    return f"""{head}, {links}, {_f1('ceafe', 't')}
SELECT muc_f.f1 AS muc_f1, b3_f.f1 AS b3_f1, ceafe_f.f1 AS ceafe_f1, lea_f.f1 AS lea_f1, round((muc_f.f1 + b3_f.f1 + ceafe_f.f1) / 3, 6) AS conll_f1 FROM muc_f, b3_f, ceafe_f, lea_f"""


SQL["coref_conll_small"] = _conll("6", False)
SQL["coref_conll"] = _conll("10", True)
SQL["coref_ceafe_full"] = _assigned("10", True)

# -- patterns


@query
def pattern_legislation_freq(spark, d):
    n = F.col("p_size").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("R.S.C. 1985, c. C-"), n), F.concat(F.lit("SOR/86-"), n), F.concat(F.lit("Bill C-"), n), F.concat(F.lit("No. "), n, F.lit(" (2001)"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = X.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.array_join(patterns.pattern(text, "legislation_citation"), " ").alias("pattern"), F.col("p_partkey").alias("seq"))
    n = patterns.frequencies(rows)
    return n.select("key", "pattern", "n", "score", F.col("rank").cast("long").alias("rank"))


SQL["pattern_legislation_freq"] = frequencies("""WITH rows AS (SELECT p_brand AS key, p_partkey AS seq, ['ABBREV. YEAR , CHAPTER', 'SOR_REG', 'BILL', 'NO_NUM YEAR'][(p_partkey % 4 + 1)::INT] AS pattern FROM part)""")


@query
def pattern_secondary_freq(spark, d):
    """The rules as they are: a full stop before white space ends no word, so "McGill L.J." is no journal to them, and
    the word that stands for volume and issue holds "VOL" again."""
    n = F.col("p_size").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("(2001) "), n, F.lit(" McGill L.J. 155")), F.concat(n, F.lit(":3 Osgoode Hall L.J. 12")), F.concat(F.lit("https://x.org/"), n), F.concat(F.lit("vol. "), n, F.lit(", October 1999"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = X.table(spark, d, "part").select(F.col("p_brand").alias("key"), F.array_join(patterns.pattern(text, "secondary_source"), " ").alias("pattern"), F.col("p_partkey").alias("seq"))
    n = patterns.frequencies(rows)
    return n.select("key", "pattern", "n", "score", F.col("rank").cast("long").alias("rank"))


SQL["pattern_secondary_freq"] = frequencies("""WITH rows AS (SELECT p_brand AS key, p_partkey AS seq, ['YEAR NUM McGill ABBREV . NUM', 'VOLUME _ISSUE JOURNAL_ABBREV . NUM', 'URL', 'VOLUME , MONTH YEAR'][(p_partkey % 4 + 1)::INT] AS pattern FROM part)""")


@query
def example_sample(spark, d):
    """Examples in the order of a seeded hash."""
    return patterns.hashed_sample(X.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 25, 42)


SQL["example_sample"] = "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 25"

# -- texts of models


@query
def model_outputs(spark, d):
    """Docids, thoughts, channels and markers of constructed outputs, one per item."""
    i = F.col("item_id").cast("string")
    c = F.col("item_id") % 4
    raw = F.when(c == 0, F.concat(F.lit("<think>a\nb</think> docid=\\\" X "), i, F.lit(" \\\" ok"))).when(c == 1, F.concat(F.lit("to=x<|message|>no<|eot|>to=user<|message|> docid='Y"), i, F.lit("' <|eot|>"))).when(c == 2, F.lit('docid=" "')).otherwise(F.concat(F.lit("a <start>b "), i, F.lit("<end> c")))
    rows = X.table(spark, d, "benchmark").select("item_id", raw.alias("raw"))
    return rows.select("item_id", T.generated_docid(F.col("raw")).alias("docid"), T.without_thoughts(F.col("raw")).alias("answer"), T.final_channel(F.col("raw")).alias("final"), T.decode(T.between_markers(T.tokenize(F.col("raw")))).alias("between"))


SQL["model_outputs"] = r"""WITH r AS (SELECT item_id, item_id % 4 AS c, item_id::VARCHAR AS i FROM benchmark),
t AS (SELECT *, CASE c WHEN 0 THEN '<think>a' || chr(10) || 'b</think> docid=\" X ' || i || ' \" ok' WHEN 1 THEN 'to=x<|message|>no<|eot|>to=user<|message|> docid=''Y' || i || ''' <|eot|>' WHEN 2 THEN 'docid=" "' ELSE 'a <start>b ' || i || '<end> c' END AS raw FROM r)
SELECT item_id, CASE c WHEN 0 THEN 'X ' || i WHEN 1 THEN 'Y' || i END AS docid, CASE c WHEN 0 THEN 'docid=\" X ' || i || ' \" ok' ELSE raw END AS answer,
  CASE c WHEN 1 THEN 'docid=''Y' || i || '''' ELSE raw END AS final, CASE c WHEN 3 THEN 'b ' || i ELSE raw END AS between FROM t"""


@query
def tag_repairs(spark, d):
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit("<b>  x</b><tool_bookmark a=1>gone</tool_bookmark><i>"), i, F.lit("</i>"))
    return X.table(spark, d, "pages").select("page_id", T.fixed_tag_spacing(T.without_bookmarks(html)).alias("html"), T.doctype_key(F.concat(F.lit(" secondary sources "), i)).alias("type"))


SQL["tag_repairs"] = "SELECT page_id, '  <b>x</b><i>' || page_id || '</i>' AS html, 'SECONDARY_SOURCES_' || page_id AS type FROM pages"


@query
def threshold_with_empty_queries(spark, d):
    """Entities without a text to ask by are unresolved, like those below the threshold."""
    pool = X.table(spark, d, "embeddings")
    top = retrieval.vector_topk(pool, pool.where("vec_id % 50 = 0"), 2).where("rank = 2")
    texts = X.pool_queries(spark, d).withColumn("qtext", F.when(F.col("item_id") % 4 == 0, F.lit("")).otherwise(F.col("qtext")))
    return retrieval.resolved(top, 0.9).crossJoin(texts.agg(F.count_if(F.col("qtext") == "").alias("empty"))).select("resolved", (F.col("unresolved") + F.col("empty")).alias("unresolved"))


SQL["threshold_with_empty_queries"] = f"SELECT count(*) FILTER (score >= 0.9) AS resolved, count(*) FILTER (score < 0.9) + (SELECT count(*) FROM benchmark WHERE item_id % 4 = 0) AS unresolved FROM ({vectors(COS, 2)}) WHERE rank = 2"

# -- streams


@query
def stream_sessions(spark, d):
    from .text_queries import _streamed

    out = _streamed(spark, d, rates.sessions, "complete")
    return out.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n")


SQL["stream_sessions"] = """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTES, true)::INT AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTES, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k"""


@query
def stream_growing_profiles(spark, d):
    from .text_queries import _streamed

    def change(rows):
        return rates.growing_profiles(rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("mention_id"), F.col("role").alias("docid")))

    return _streamed(spark, d, change, "complete", "conversations")


SQL["stream_growing_profiles"] = "SELECT conv_id AS doc_id, role AS docid, min(turn) AS first_seen_id, count(*) AS n_mentions FROM conversations GROUP BY ALL"


# -- statistics


@query
def productivity_by_split(spark, d):
    events = X.table(spark, d, "events")
    docs = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("words"), F.count_if(F.col("value") > 50).alias("spans"), F.round(F.sum("value") / 3600, 9).alias("hours"))
    return stats.productivity(docs, "event_type")


SQL["productivity_by_split"] = f"""WITH d AS (SELECT user_id, event_type, count(*) AS words, count(*) FILTER (value > 50) AS spans, round(sum(value) / 3600, 9) AS hours FROM events GROUP BY ALL)
SELECT event_type, count(*) AS documents, round({ratio('sum(words)', 'sum(hours)')}, 4) AS words_per_hour, round({ratio('sum(spans)', 'sum(hours)')}, 4) AS spans_per_hour,
  round(avg(CASE WHEN hours > 0 THEN words / hours END), 4) AS mean_words_per_hour, round(avg(CASE WHEN hours > 0 THEN spans / hours END), 4) AS mean_spans_per_hour FROM d GROUP BY event_type"""
