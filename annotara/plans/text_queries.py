"""Queries whose operators rewrite trees or align sequences in Python workers, over whole tables.

Where a property of the result can be said in SQL the query returns it and has an oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import assistants, extraction, output
from ..sources.staging import shared_dir, small_batches
from ..streaming import rates
from . import fixtures as X
from .oracles import LINES, MENTIONS

FOUND: dict = {}
SQL: dict[str, str] = {}


def query(f):
    FOUND[f.__name__] = f
    return f


def _labelled(spark, d):
    """Pages whose bold parts are labels, and the same with a word changed in every fifth page."""
    html = F.regexp_replace(F.regexp_replace("html", "<b>", '<auto_label labelname="decision">'), "<(br|/p)>", "</auto_label><$1>")
    broken = F.when(F.col("page_id") % 5 == 0, F.regexp_replace(html, r"\bthe\b", "teh")).otherwise(html)
    return X.table(spark, d, "pages").select("page_id", "html", broken.alias("processed"))


@query
def leaf_blocks(spark, d):
    rows = X.table(spark, d, "pages").select("page_id", F.posexplode(output.leaf_block_column(F.col("html"))).alias("nth", "block"))
    return rows.select("page_id", F.col("nth").cast("long").alias("nth"), F.length("block").cast("long").alias("n_chars"), F.md5("block").alias("digest"))


@query
def verify_outputs(spark, d):
    rows = _labelled(spark, d).select("page_id", output.check_column("html", "processed").alias("c"))
    return rows.select("page_id", "c.passed", F.coalesce("c.error_type", F.lit("none")).alias("error_type"))


PROCESSED = r"""x AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<b>', '<auto_label labelname="decision">', 'g'), '<(br|/p)>', '</auto_label><\1>', 'g') AS labelled FROM pages),
p AS (SELECT page_id, html, CASE WHEN page_id % 5 = 0 THEN regexp_replace(labelled, '\bthe\b', 'teh', 'g') ELSE labelled END AS processed FROM x)"""
SQL["verify_outputs"] = rf"""WITH {PROCESSED},
t AS (SELECT page_id, unnest(regexp_extract_all(processed, '</?auto_label[^>]*>')) AS t, generate_subscripts(regexp_extract_all(processed, '</?auto_label[^>]*>'), 1) AS i FROM p),
s AS (SELECT page_id, i, sum(CASE WHEN t LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM t),
b AS (SELECT page_id, min(depth) < 0 OR arg_max(depth, i) <> 0 AS broken FROM s GROUP BY 1),
e AS (SELECT p.page_id, CASE WHEN regexp_replace(processed, '<[^>]*>', '', 'g') <> regexp_replace(html, '<[^>]*>', '', 'g') THEN 'hallucination' WHEN coalesce(broken, false) THEN 'consistency' ELSE 'none' END AS error_type FROM p LEFT JOIN b USING (page_id))
SELECT page_id, error_type = 'none' AS passed, error_type FROM e"""


@query
def align_protected(spark, d):
    """Every line with words lost and labels put in, brought back: labels stay, text is the line's."""
    small_batches(spark)
    token = T.TOKEN.removeprefix("(?U)")  # three are labelled, two more are lost
    processed = F.regexp_replace("norm", f"(?U)^((?:{token}){{0,3}})(?:{token}){{0,2}}", '<auto_label labelname="title">$1</auto_label>')
    rows = X.lines(spark, d).select("doc_id", "seq", F.col("norm").alias("original"), processed.alias("processed"))
    done = rows.select("doc_id", "seq", "original", output.align_column("original", "processed").alias("aligned"))
    return done.select("doc_id", "seq", F.md5(T.without_auto_labels(F.col("aligned"))).alias("text"), (F.col("aligned") != F.col("original")).alias("labelled"))


SQL["align_protected"] = f"WITH {LINES} SELECT doc_id, seq, md5(norm) AS text, true AS labelled FROM lines"


@query
def merge_tokens(spark, d):
    rows = _labelled(spark, d).where("page_id % 5 <> 0")  # the others have another text
    merged = rows.select("page_id", "html", output.merge_column("html", "processed").alias("merged"))
    return merged.select("page_id", F.md5(T.without_auto_labels(F.col("merged"))).alias("rest"), F.regexp_count("merged", F.lit("</?auto_label")).cast("long").alias("tags"))


SQL["merge_tokens"] = rf"WITH {PROCESSED} SELECT page_id, md5(html) AS rest, len(regexp_extract_all(processed, '</?auto_label')) AS tags FROM p WHERE page_id % 5 <> 0"


@query
def bracket_fix(spark, d):
    fixed = output.bracket_column(F.col("processed"))
    return _labelled(spark, d).select("page_id", F.md5(T.without_tags(fixed)).alias("text"), F.regexp_count(fixed, F.lit("</?auto_label")).cast("long").alias("tags"))


SQL["bracket_fix"] = rf"WITH {PROCESSED} SELECT page_id, md5(regexp_replace(processed, '<[^>]*>', '', 'g')) AS text, len(regexp_extract_all(processed, '</?auto_label')) AS tags FROM p"


@query
def fix_labels(spark, d):
    rows = X.table(spark, d, "pages").select("page_id", F.concat(F.lit('<auto_label labelname="title"><i>'), T.squeezed(T.without_tags(F.col("html"))), F.lit("</i></auto_label>")).alias("h"))
    return rows.select("page_id", output.hoist_column(F.col("h")).alias("html"))


PLAIN = r"trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'))"
SQL["fix_labels"] = f"""SELECT page_id, '<i><auto_label labelname="title">' || {PLAIN} || '</auto_label></i>' AS html FROM pages"""


@query
def clean_formatting(spark, d):
    rows = X.table(spark, d, "pages").select("page_id", output.tidy_column(F.concat(F.lit("<i></i><i>a</i> <i>"), F.col("page_id").cast("string"), F.lit("</i><b> </b>"))).alias("html"))
    return rows


SQL["clean_formatting"] = "SELECT page_id, '<i>a ' || page_id || '</i> ' AS html FROM pages"


@query
def labelled_spans(spark, d):
    """Spans read from labels put around each line's first word."""
    from ..operators import spans

    html = F.regexp_replace("text", r"(?m)^([A-Za-z]+)", '<manual_label labelname="Title" id="1" docid="D" parent="">$1</manual_label>')
    rows = extraction.span_rows(X.table(spark, d, "documents").select("doc_id", html.alias("html")))
    located = spans.located_spans(rows, "plain")
    return located.select(F.col("doc_id").cast("long").alias("doc_id"), "seq", "labelname", "text", (F.col("start_pos") >= 0).alias("found"))


SQL["labelled_spans"] = r"""
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
l AS (SELECT doc_id, i, regexp_extract(line, '^[A-Za-z]+') AS word FROM w)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, 'title' AS labelname, word AS text, true AS found FROM l WHERE word <> ''"""


@query
def mention_ids(spark, d):
    html = F.regexp_replace("text", r"(?m)^([A-Za-z]+)", '<manual_label labelname="decision" docid="D" parent="">$1</manual_label>')
    rows = X.table(spark, d, "documents").select("doc_id", output.text_function(extraction.with_ids)(html).alias("html"))
    m = extraction.offset_rows(rows)
    return m.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("mentions"), F.max(F.col("id").cast("long")).alias("last_id"))


SQL["mention_ids"] = r"""
WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS mentions, count(*) - 1 AS last_id FROM w WHERE regexp_extract(line, '^[A-Za-z]+') <> '' GROUP BY doc_id"""


@query
def bounded_registry(spark, d):
    """Mentions resolved in order with at most three open profiles."""
    rows = X.mentions(spark, d).select("doc_id", "mention_id", "docid")
    return assistants.resolved_in_order(rows, lambda m, registry: m["docid"], most=3)


SQL["bounded_registry"] = f"""WITH {MENTIONS}, f AS (SELECT doc_id, docid, min(mention_id) AS first FROM mentions GROUP BY ALL),
r AS (SELECT doc_id, docid, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS n FROM f)
SELECT doc_id, mention_id, docid, (n - 1) // 3 AS pass FROM mentions JOIN r USING (doc_id, docid)"""


@query
def generated_echo(spark, d):
    rows = X.table(spark, d, "benchmark").select("item_id", "text")
    return assistants.generated(rows, lambda: assistants.Echo("<start>{}<end>".format), "Label the text.").select("item_id", "output")


SQL["generated_echo"] = "SELECT item_id, '<start>' || text || '<end>' AS output FROM benchmark"


def _streamed(spark, d, change, mode, table="events"):
    """A bounded stream over a table, a file or a folder of files, run to its end; the last result and the checkpoint
    are in the shared folder."""
    out = shared_dir(spark, "stream")
    reader = spark.readStream.schema(X.table(spark, d, table).schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{table}.parquet")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        stream = reader.parquet(f"{d}/{table}.parquet")
    else:  # a stream's source is a folder
        stream = reader.option("pathGlobFilter", f"{table}.parquet").parquet(d)
    changed = change(stream)
    spark.createDataFrame([], changed.schema).write.parquet(f"{out}/result")  # stays where no rows come

    def keep(rows, _):
        rows.write.mode("overwrite").parquet(f"{out}/result")

    changed.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(changed.schema).parquet(f"{out}/result")


@query
def stream_rolling_rate(spark, d):
    out = _streamed(spark, d, rates.rolling_rate, "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "mean_value")


SQL["stream_rolling_rate"] = """
WITH e AS (SELECT *, time_bucket(INTERVAL 30 MINUTES, ts) AS b FROM events),
w AS (SELECT b AS start, event_type, value FROM e UNION ALL SELECT b - INTERVAL 30 MINUTES, event_type, value FROM e)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM w GROUP BY ALL"""
