"""Queries over annotated HTML that is made of the documents' lines, with the SQL that says what comes of it.

Each line is a paragraph and a mention: its first word is the title, the rest the citation.  Label, docid
and link come from a hash of the line's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions.labels import Transform, to_full, transformed, with_scheme_attributes
from ..functions.tokens import hash8
from ..operators import coref, extraction, output, patterns, registry
from . import drivers
from . import fixtures as X
from .oracles import LINES, TOKEN, frequencies, h

FOUND: dict = {}
SQL: dict[str, str] = {}
NAMES = ("decision", "legislation", "secondary sources")


def query(f):
    FOUND[f.__name__] = f
    return f


# -- the fixture, in both languages


def escaped(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def esc(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def placed(spark, d) -> DataFrame:
    """doc_id, seq, nth, norm, word, rest, h, name, docid, uri of each line that isn't empty."""
    rows = X.lines(spark, d).withColumn("h", hash8(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("seq").cast("string"))))
    uri = F.when(F.col("h") % 5 == 0, F.lit(None)).when(F.col("h") % 11 == 0, F.lit("none")).otherwise(F.concat(F.lit("https://ex.org/"), (F.col("h") % 50).cast("string")))
    word = F.regexp_extract("norm", "^[^ ]+", 0)
    return rows.select(
        "doc_id", "seq", "norm", word.alias("word"), F.substring("norm", F.length(word) + 2, F.length("norm")).alias("rest"), "h",
        F.element_at(F.array(*map(F.lit, NAMES)), (F.col("h") % 3 + 1).cast("int")).alias("name"), F.concat(F.lit("Case A & B "), (F.floor(F.col("h") / 8) % 20).cast("string")).alias("docid"), uri.alias("uri"),
    )


PLACED = f"""{LINES},
placed AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS nth, norm, regexp_extract(norm, '^[^ ]+') AS word, substr(norm, length(regexp_extract(norm, '^[^ ]+')) + 2) AS rest, h,
  ['decision', 'legislation', 'secondary sources'][(h % 3 + 1)::INT] AS name, 'Case A & B ' || (h // 8 % 20) AS docid,
  CASE WHEN h % 5 = 0 THEN NULL WHEN h % 11 = 0 THEN 'none' ELSE 'https://ex.org/' || (h % 50) END AS uri FROM (SELECT *, {h("doc_id || ':' || seq")} AS h FROM lines))"""
INNER = f"""'<manual_label labelname="title" parent="' || name || '">' || {esc('word')} || '</manual_label>' || CASE WHEN rest <> '' THEN ' <manual_label labelname="citation" parent="' || name || '">' || {esc('rest')} || '</manual_label>' ELSE '' END"""
URI = """CASE WHEN uri IS NOT NULL THEN ' uri="' || uri || '"' ELSE '' END"""
OPEN = f"""'<manual_label labelname="' || name || '" docid="' || {esc('docid')} || '" id="' || seq || '" parent=""' || {URI} || '>'"""
HEAD = """'<html><!-- Tool {"meta": {"time": ' || (doc_id * 7 % 5000) || '}} --><body>'"""


def page(paragraph: str, alias: str = "html", head: str = HEAD) -> str:
    """SQL of a document whose paragraphs are the expression."""
    return f"{head} || string_agg({paragraph}, chr(10) ORDER BY seq) || '</body></html>' AS {alias}"


PARAGRAPH = f"'<p>' || {OPEN} || {INNER} || '</manual_label></p>'"


def text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def paragraphs(spark, d) -> DataFrame:
    c = F.col
    inner = text('<manual_label labelname="title" parent="', c("name"), '">', escaped(c("word")), "</manual_label>", F.when(c("rest") != "", text(' <manual_label labelname="citation" parent="', c("name"), '">', escaped(c("rest")), "</manual_label>")).otherwise(F.lit("")))
    uri = F.when(c("uri").isNotNull(), text(' uri="', c("uri"), '"')).otherwise(F.lit(""))
    opening = text('<manual_label labelname="', c("name"), '" docid="', escaped(c("docid")), '" id="', c("seq").cast("string"), '" parent=""', uri, ">")
    return placed(spark, d).withColumn("p", text("<p>", opening, inner, "</manual_label></p>"))


def pages(spark, d) -> DataFrame:
    rows = paragraphs(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "p"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["p"]), "\n")
    return rows.select("doc_id", text('<html><!-- Tool {"meta": {"time": ', (F.col("doc_id") * 7 % 5000).cast("string"), "}} --><body>", body, "</body></html>").alias("html"))


def number(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))


# -- extraction


@query
def html_pages(spark, d):
    return pages(spark, d).select("doc_id", F.md5("html").alias("digest"), F.length("html").cast("long").alias("n_chars"))


SQL["html_pages"] = f"WITH {PLACED}, p AS (SELECT doc_id, {page(PARAGRAPH)} FROM placed GROUP BY doc_id) SELECT doc_id, md5(html) AS digest, length(html) AS n_chars FROM p"


@query
def html_mentions(spark, d):
    m = number(extraction.mention_rows(pages(spark, d)))
    return m.select("doc_id", "mention_id", "name", "docid", "uri", F.md5("text").alias("digest"), F.md5("html").alias("html"), F.array_join(F.transform("sublabels", lambda s: F.concat(s["name"], F.lit("="), F.length(s["text"]).cast("string"))), ",").alias("parts"))


SQL["html_mentions"] = f"""WITH {PLACED} SELECT doc_id, nth AS mention_id, name, docid, uri, md5(norm) AS digest, md5({OPEN} || {INNER} || '</manual_label>') AS html,
  'title=' || length(word) || CASE WHEN rest <> '' THEN ',citation=' || length(rest) ELSE '' END AS parts FROM placed"""


@query
def html_spans(spark, d):
    rows = number(extraction.document_spans(pages(spark, d))).select("doc_id", F.md5("plain").alias("plain"), F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.seq", "s.labelname", F.md5("s.text").alias("digest"), F.col("s.attrs")["docid"].alias("docid"), "plain")


SQL["html_spans"] = f"""WITH {PLACED}, whole AS (SELECT doc_id, md5(string_agg(norm, ' ' ORDER BY seq)) AS plain FROM placed GROUP BY 1),
s AS (SELECT doc_id, nth, 0 AS k, name AS labelname, norm AS text, docid FROM placed UNION ALL SELECT doc_id, nth, 1, 'title', word, NULL FROM placed UNION ALL SELECT doc_id, nth, 2, 'citation', rest, NULL FROM placed WHERE rest <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth, k) - 1 AS seq, labelname, md5(text) AS digest, docid, plain FROM s JOIN whole USING (doc_id)"""


@query
def html_offsets(spark, d):
    rows = number(extraction.offset_rows(pages(spark, d)))
    return rows.select("doc_id", "seq", "key", "id", "docid", "label", "start", "end", F.md5("text").alias("digest"))


SQL["html_offsets"] = f"""WITH {PLACED}, o AS (SELECT *, coalesce(sum(length(norm) + 1) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo FROM placed)
SELECT doc_id, nth AS seq, name || '|' || lo || '|' || (lo + length(norm)) AS key, seq::VARCHAR AS id, docid, name AS label, lo AS start, lo + length(norm) AS "end", md5(norm) AS digest FROM o"""


@query
def docid_mapping_last(spark, d):
    """Ids that repeat: the last mention counts."""
    html = F.regexp_replace("html", ' id="[0-9]*([0-9])"', ' id="$1"')
    return number(extraction.docid_mapping(pages(spark, d).select("doc_id", html.alias("html"))))


SQL["docid_mapping_last"] = f"WITH {PLACED} SELECT doc_id, (seq % 10)::VARCHAR AS id, arg_max(docid, seq) AS docid FROM placed GROUP BY doc_id, seq % 10"


@query
def html_clusters(spark, d):
    m = number(extraction.docid_mapping(pages(spark, d)))
    return coref.clusters(m.select("doc_id", F.col("id").alias("mention_id"), "docid"))


SQL["html_clusters"] = f"WITH {PLACED} SELECT doc_id, 'd:' || docid AS cluster, string_agg(seq::VARCHAR, ',' ORDER BY seq::VARCHAR) AS members, count(*) AS size FROM placed GROUP BY doc_id, docid"


@query
def uri_records(spark, d):
    return number(extraction.uri_rows(pages(spark, d))).select("doc_id", "labelname", "docid", "uri", F.md5("text").alias("digest"))


SQL["uri_records"] = f"WITH {PLACED} SELECT doc_id, name AS labelname, docid, uri, md5(norm) AS digest FROM placed WHERE uri IS NOT NULL"


@query
def label_pattern_freq(spark, d):
    rows = number(extraction.pattern_rows(pages(spark, d)))
    n = patterns.frequencies(rows.select(F.col("name").alias("key"), F.array_join("parts", " > ").alias("pattern"), (F.col("doc_id") * 1_000_000 + F.col("seq")).alias("seq")))
    return n.select("key", "pattern", "n", "score", F.col("rank").cast("long").alias("rank"))


SQL["label_pattern_freq"] = frequencies(f"WITH {PLACED}, rows AS (SELECT name AS key, 'title' || CASE WHEN rest <> '' THEN ' > citation' ELSE '' END AS pattern, doc_id * 1000000 + nth AS seq FROM placed)")


@query
def sublabel_strings(spark, d):
    rows = number(extraction.sublabel_rows(pages(spark, d)))
    return rows.select("doc_id", "seq", "parent", "part", F.md5("text").alias("digest"))


SQL["sublabel_strings"] = f"""WITH {PLACED}, s AS (SELECT doc_id, nth, 0 AS k, name, 'title' AS part, word AS text FROM placed UNION ALL SELECT doc_id, nth, 1, name, 'citation', rest FROM placed WHERE rest <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY nth, k) - 1 AS seq, name AS parent, part, md5(text) AS digest FROM s"""


@query
def label_and_word_counts(spark, d):
    html = pages(spark, d)
    plain = html.select("doc_id", T.label_count(F.col("html")).cast("long").alias("labels"))
    return plain.join(X.table(spark, d, "documents").select("doc_id", T.count_words(F.col("text")).cast("long").alias("words")), "doc_id")


SQL["label_and_word_counts"] = rf"""WITH {PLACED}, n AS (SELECT doc_id, sum(2 + (rest <> '')::INT)::BIGINT AS labels FROM placed GROUP BY 1)
SELECT doc_id, labels, len(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}]+(?:[''’\-][\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}]+)*'))::BIGINT AS words FROM n JOIN documents USING (doc_id)"""


@query
def annotation_time(spark, d):
    from ..operators import metadata

    return pages(spark, d).select("doc_id", metadata.annotation_meta(F.col("html")).alias("ms"))


SQL["annotation_time"] = f"WITH {PLACED} SELECT doc_id, (doc_id * 7 % 5000)::DOUBLE AS ms FROM placed GROUP BY doc_id"


@query
def mention_contexts(spark, d):
    """At every mention at most 20 tokens of the text before it."""
    rows = extraction.context_rows(pages(spark, d).withColumn("html", F.regexp_replace("html", "&(amp|lt|gt);", "x")), 20)
    return number(rows).select("doc_id", "mention_id", "context")


SQL["mention_contexts"] = rf"""WITH {PLACED}, t AS (SELECT doc_id, nth, regexp_extract_all(regexp_replace(norm, '[&<>]', 'x', 'g') || chr(10), '{TOKEN}') AS t FROM placed),
u AS (SELECT doc_id, nth, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM t), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth, i) AS k FROM u),
b AS (SELECT doc_id, nth, min(k) AS k FROM n GROUP BY ALL)
SELECT b.doc_id, b.nth AS mention_id, coalesce(string_agg(n.t, '' ORDER BY n.k), '') AS context FROM b LEFT JOIN n ON n.doc_id = b.doc_id AND n.k >= b.k - 20 AND n.k < b.k GROUP BY ALL"""


@query
def html_segments(spark, d):
    rows = pages(spark, d).select("doc_id", T.tokenize(F.col("html")).alias("tokens"))
    parts = extraction.segments(rows.withColumn("mentions", drivers.outermost(F.col("tokens"), NAMES)))
    return parts.groupBy("doc_id").agg(F.count_if("process").alias("mentions"), F.count_if(~F.col("process")).alias("between"), F.sum(F.length(T.decode(F.col("tokens")))).alias("n_chars"))


SQL["html_segments"] = f"WITH {PLACED}, p AS (SELECT doc_id, count(*) AS n, {page(PARAGRAPH)} FROM placed GROUP BY doc_id) SELECT doc_id, n AS mentions, n + 1 AS between, length(html) AS n_chars FROM p"


@query
def html_profiles(spark, d):
    """Profiles of the mentions read from HTML, every text of each part."""
    p = registry.profiles(drivers.mention_table(pages(spark, d)).drop("html", "nth"), {"title": "title", "citation": "citation"})
    return number(p).select("doc_id", "docid", "doc_type", "first_seen_id", "n_mentions", "main_title", *[registry.written(F.col(c)).alias(c) for c in ("titles", "citations")])


VALUED = f"""{PLACED}, v AS (SELECT doc_id, docid, 'title' AS field, word AS value, nth FROM placed UNION ALL SELECT doc_id, docid, 'citation', rest, nth FROM placed WHERE rest <> ''),
f AS (SELECT doc_id, docid, field, value, min(nth) AS first FROM v GROUP BY ALL), l AS (SELECT doc_id, docid, field, string_agg(value || '@' || first, '|' ORDER BY first, value) AS x, arg_min(value, (first, value)) AS top FROM f GROUP BY ALL),
base AS (SELECT doc_id, docid, arg_min(name, nth) AS doc_type, min(nth) AS first_seen_id, count(*) AS n_mentions FROM placed GROUP BY doc_id, docid)"""
SQL["html_profiles"] = f"""WITH {VALUED} SELECT base.*, t.top AS main_title, t.x AS titles, coalesce(c.x, '') AS citations FROM base
  JOIN l t ON t.doc_id = base.doc_id AND t.docid = base.docid AND t.field = 'title' LEFT JOIN l c ON c.doc_id = base.doc_id AND c.docid = base.docid AND c.field = 'citation'"""

# -- rewriting


@query
def uris_stripped(spark, d):
    html, n = extraction.without_uris(F.col("html"))
    return pages(spark, d).select("doc_id", F.md5(html).alias("digest"), n.cast("long").alias("n"))


PLAIN = f"""'<manual_label labelname="' || name || '" docid="' || {esc('docid')} || '" id="' || seq || '" parent="">'"""
SQL["uris_stripped"] = f"WITH {PLACED}, p AS (SELECT doc_id, count(uri) AS n, {page(f"'<p>' || {PLAIN} || {INNER} || '</manual_label></p>'")} FROM placed GROUP BY doc_id) SELECT doc_id, md5(html) AS digest, n FROM p"


@query
def uris_injected(spark, d):
    """New links for half of the docids, first among the attributes; the old ones go."""
    rows = placed(spark, d).where("floor(h / 8) % 2 = 0").select("doc_id", "docid").distinct().withColumn("uri", F.concat(F.lit("u:"), F.md5("docid")))
    return drivers.inject(pages(spark, d), rows).select("doc_id", F.md5("html").alias("digest"))


LINKED = PLAIN.replace("<manual_label", "<manual_label' || CASE WHEN (h // 8) % 2 = 0 THEN ' uri=\"u:' || md5(docid) || '\"' ELSE '' END || '")
SQL["uris_injected"] = f"WITH {PLACED}, p AS (SELECT doc_id, {page(f"'<p>' || {LINKED} || {INNER} || '</manual_label></p>'")} FROM placed GROUP BY doc_id) SELECT doc_id, md5(html) AS digest FROM p"


@query
def docids_applied(spark, d):
    """New docids for ids that are even, and one for an id that no label has."""
    rows = placed(spark, d).where("seq % 2 = 0").select("doc_id", F.col("seq").cast("string").alias("id"), F.concat(F.lit("new "), F.col("seq").cast("string")).alias("docid"))
    odd = rows.select("doc_id", F.lit("zz").alias("id"), F.lit("lost").alias("docid")).distinct()
    out = extraction.docids_applied(pages(spark, d), rows.unionByName(odd))
    return out.select("doc_id", F.md5("html").alias("digest"), F.array_join("missing", ",").alias("missing"))


APPLIED = """'<manual_label labelname="' || name || '" id="' || seq || '" parent=""' || CASE WHEN seq % 2 = 0 THEN ' docid="new ' || seq || '"' ELSE '' END || '>'"""
SQL["docids_applied"] = f"""WITH {PLACED}, p AS (SELECT doc_id, count(*) FILTER (seq % 2 = 0) AS even, {page(f"'<p>' || {APPLIED} || {INNER} || '</manual_label></p>'")} FROM placed GROUP BY doc_id)
SELECT doc_id, md5(html) AS digest, CASE WHEN even > 0 THEN 'zz' ELSE '' END AS missing FROM p"""


def changed(how: Transform):
    return output.text_function(lambda t: "".join(transformed(output.tokenize(t), how)))


@query
def label_transforms(spark, d):
    """Titles unlabelled, only docids kept, manual to automatic, simple names."""
    how = Transform(remove_labels=["title"], keep_attrs=["docid"], switch=True, simplify=True)
    return pages(spark, d).select("doc_id", F.md5(changed(how)(F.col("html"))).alias("digest"))


SIMPLE = f"""'<p><' || name || ' docid="' || {esc('docid')} || '">' || {esc('word')} || CASE WHEN rest <> '' THEN ' <citation>' || {esc('rest')} || '</citation>' ELSE '' END || '</' || name || '></p>'"""
SQL["label_transforms"] = f"WITH {PLACED}, p AS (SELECT doc_id, {page(SIMPLE)} FROM placed GROUP BY doc_id) SELECT doc_id, md5(html) AS digest FROM p"


@query
def simplified_and_back(spark, d):
    """The simple syntax read back as automatic labels."""
    back = output.text_function(lambda t: "".join(to_full(output.tokenize(t))))
    simple = changed(Transform(simplify=True, keep_attrs=["docid"]))(F.col("html"))
    return pages(spark, d).select("doc_id", F.md5(back(simple)).alias("digest"))


FULL = f"""'<p><auto_label labelname="' || name || '" docid="' || {esc('docid')} || '"><auto_label labelname="title">' || {esc('word')} || '</auto_label>' || CASE WHEN rest <> '' THEN ' <auto_label labelname="citation">' || {esc('rest')} || '</auto_label>' ELSE '' END || '</auto_label></p>'"""
SQL["simplified_and_back"] = f"WITH {PLACED}, p AS (SELECT doc_id, {page(FULL)} FROM placed GROUP BY doc_id) SELECT doc_id, md5(html) AS digest FROM p"

NESTED_SCHEME = {
    "decision": {"color": "#ffee00", "attributes": {"docid": {"type": "string"}, "kind": {"type": "dropdown", "default": "court"}}, "sublabels": {"title": {"color": "#102030", "attributes": {"short": {"type": "checkbox", "default": True}}}}},
    "legislation": {"attributes": {"seen": {"type": "checkbox"}, "other": {"type": "list", "default": "x"}}},
}


@query
def scheme_attributes(spark, d):
    new = output.text_function(lambda t: with_scheme_attributes(t, NESTED_SCHEME))
    html = text('<auto_label labelname="', F.col("name"), '" docid="old" parent="p"><auto_label labelname="title" n="1">', escaped(F.col("word")), "</auto_label></auto_label>")
    return placed(spark, d).select("doc_id", "seq", new(html).alias("html"))


SQL["scheme_attributes"] = f"""WITH {PLACED} SELECT doc_id, seq, '<auto_label labelname="' || name || '"' || CASE name
    WHEN 'decision' THEN ' parent="" style="background-color: rgb(255, 238, 0); color: black;" verified="false" docid="" kind="court"'
    WHEN 'legislation' THEN ' docid="old" parent="" verified="false" seen="false" other=""' ELSE ' docid="old" parent="" verified="false"' END
  || '><auto_label labelname="title" n="1" parent="' || name || '" style="background-color: rgb(16, 32, 48); color: white;" verified="false" short="true">' || {esc('word')} || '</auto_label></auto_label>' AS html FROM placed"""

# -- output control


@query
def verify_cases(spark, d):
    """Six ways an answer can look, one per line, and what the checks say."""
    open_ = lambda x: f'<auto_label labelname="{x}">'
    c, end = F.col("norm"), "</auto_label>"
    variants = [text(open_("decision"), c, end), text(c, " extra"), text(open_("decision"), c), text(open_("made up"), c, end), text('<auto_label labelname="decision" colour="1">', c, end), text(open_("title"), c, end)]
    rows = placed(spark, d).withColumn("case", F.element_at(F.array(*variants), (F.col("h") % 6 + 1).cast("int")))
    done = rows.select("doc_id", "seq", output.check_column("norm", "case").alias("c"))
    return done.select("doc_id", "seq", "c.passed", F.coalesce("c.error_type", F.lit("none")).alias("error_type"))


SQL["verify_cases"] = f"WITH {PLACED} SELECT doc_id, seq, h % 6 = 0 AS passed, ['none', 'hallucination', 'consistency', 'label_scheme', 'label_scheme', 'nesting'][(h % 6 + 1)::INT] AS error_type FROM placed"


@query
def preserved_cases(spark, d):
    """A paragraph with a label, with a letter more, and in italics, against the plain one."""
    c = escaped(F.col("norm"))
    variants = [text('<p><auto_label labelname="title">', c, "</auto_label></p>"), text("<p>", c, "x</p>"), text("<p><i>", c, "</i></p>")]
    rows = placed(spark, d).withColumn("case", F.element_at(F.array(*variants), (F.col("h") % 3 + 1).cast("int")))
    return rows.select("doc_id", "seq", F.coalesce(output.preserved_column(F.col("case"), text("<p>", c, "</p>")), F.lit("same")).alias("found"))


SQL["preserved_cases"] = f"WITH {PLACED} SELECT doc_id, seq, CASE h % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'text differs at ' || length(norm) ELSE 'tags differ' END AS found FROM placed"


@query
def fallback_cases(spark, d):
    """Which attempt is used, by the checks of a first and a second one."""
    def result(n: Column) -> Column:
        error = F.element_at(F.array(*map(F.lit, ("none", "hallucination", "nesting"))), (n % 3 + 1).cast("int"))
        return F.struct((error == "none").alias("passed"), F.nullif(error, F.lit("none")).alias("error_type"))

    return placed(spark, d).select("doc_id", "seq", output.outcome(result(F.col("h")), result(F.floor(F.col("h") / 3))).alias("outcome"))


SQL["fallback_cases"] = f"WITH {PLACED} SELECT doc_id, seq, CASE WHEN h % 3 = 0 THEN 'first' WHEN h // 3 % 3 = 0 THEN 'retry' WHEN h % 3 = 2 THEN 'first' ELSE 'original' END AS outcome FROM placed"


@query
def leaf_paragraphs(spark, d):
    rows = pages(spark, d).select("doc_id", F.posexplode(output.leaf_block_column(F.col("html"))).alias("nth", "block"))
    return rows.select("doc_id", F.col("nth").cast("long").alias("nth"), F.md5("block").alias("digest"))


SQL["leaf_paragraphs"] = f"WITH {PLACED} SELECT doc_id, nth, md5({PARAGRAPH}) AS digest FROM placed"


@query
def hoisted_shapes(spark, d):
    c = escaped(F.col("word"))
    a, end = '<auto_label labelname="a">', "</auto_label>"
    variants = [text(a, "<i>", c, "</i>", end), text(a, "x <i>", c, "</i>", end), text(a, "<b>", '<auto_label labelname="b">', c, end, "</b>", end)]
    return placed(spark, d).select("doc_id", "seq", output.hoist_column(F.element_at(F.array(*variants), (F.col("h") % 3 + 1).cast("int"))).alias("html"))


SQL["hoisted_shapes"] = f"""WITH {PLACED} SELECT doc_id, seq, CASE h % 3 WHEN 0 THEN '<i><auto_label labelname="a">' || {esc('word')} || '</auto_label></i>' WHEN 1 THEN '<auto_label labelname="a">x <i>' || {esc('word')} || '</i></auto_label>'
  ELSE '<b><auto_label labelname="a"><auto_label labelname="b">' || {esc('word')} || '</auto_label></auto_label></b>' END AS html FROM placed"""


@query
def tidied_shapes(spark, d):
    w, r = escaped(F.col("word")), F.col("seq").cast("string")
    variants = [text("<b>", w, "</b><b>", r, "</b>"), text("<i></i><b> </b>", w), text("<b>", w, "</b> <b>", r, "</b>"), text("<b>", w, "</b>x<b>", r, "</b>"), text('<i style="1">', w, "</i><i>", r, "</i>")]
    return placed(spark, d).select("doc_id", "seq", output.tidy_column(F.element_at(F.array(*variants), (F.col("h") % 5 + 1).cast("int"))).alias("html"))


SQL["tidied_shapes"] = f"""WITH {PLACED}, w AS (SELECT *, {esc('word')} AS w FROM placed) SELECT doc_id, seq, CASE h % 5 WHEN 0 THEN '<b>' || w || seq || '</b>' WHEN 1 THEN ' ' || w WHEN 2 THEN '<b>' || w || ' ' || seq || '</b>'
  WHEN 3 THEN '<b>' || w || '</b>x<b>' || seq || '</b>' ELSE '<i style="1">' || w || '</i><i>' || seq || '</i>' END AS html FROM w"""


@query
def merged_lines(spark, d):
    """Labels of a text without formatting, put into the formatted line: nothing else changes, and they nest."""
    c = F.col
    html = text("<p><i>", escaped(c("word")), "</i> <b>", escaped(c("rest")), "</b></p>")
    derived = text('<auto_label labelname="decision"><auto_label labelname="title">', escaped(c("word")), "</auto_label> ", escaped(c("rest")), "</auto_label>")
    rows = placed(spark, d).where("rest <> ''").select("doc_id", "seq", html.alias("html"), output.merge_column(html, derived).alias("merged"))
    fixed = output.bracket_column(F.col("merged"))
    kinds = F.transform(T.tokenize(fixed), lambda t: F.when(t.rlike("^<auto_label"), 1).when(t.rlike("^</auto_label"), -1).otherwise(0))
    return rows.select(
        "doc_id", "seq", (T.without_auto_labels(F.col("merged")) == F.col("html")).alias("same"), F.regexp_count(fixed, F.lit("<auto_label")).cast("long").alias("labels"),
        F.aggregate(kinds, F.lit(0), lambda a, x: a + x).cast("long").alias("open"), (T.without_tags(fixed) == T.without_tags(F.col("html"))).alias("same_text"),
    )


SQL["merged_lines"] = f"WITH {PLACED} SELECT doc_id, seq, true AS same, 2::BIGINT AS labels, 0::BIGINT AS open, true AS same_text FROM placed WHERE rest <> ''"

# -- examples


@query
def extraction_examples(spark, d):
    chunks = paragraphs(spark, d).select("doc_id", F.col("seq"), F.regexp_replace("p", "</?p>", "").alias("text"))
    out = drivers.extraction_examples(chunks, Transform(simplify=True, keep_attrs=["docid"]), 300)
    return out.select(F.col("source_file").alias("doc_id"), F.md5("input").alias("input"), F.md5("output").alias("output"))


SQL["extraction_examples"] = f"""WITH {PLACED} SELECT doc_id, md5({esc('norm')}) AS input, md5({SIMPLE.replace("'<p><'", "'<'").replace("></p>'", ">'").replace(f"|| {esc('word')} ||", f"|| '<title>' || {esc('word')} || '</title>' ||")}) AS output FROM placed WHERE length({esc('norm')}) < 300"""


@query
def linking_examples(spark, d):
    out = drivers.linking_examples(pages(spark, d), 20)
    return number(out).select("doc_id", "mention_id", "docid", F.md5("output").alias("output"), F.json_array_length(F.get_json_object("input", "$.profiles")).cast("long").alias("known"))


SQL["linking_examples"] = f"""WITH {VALUED}, k AS (SELECT p.doc_id, p.nth, count(b.docid) AS known FROM placed p LEFT JOIN base b ON b.doc_id = p.doc_id AND b.first_seen_id < p.nth AND b.doc_type = p.name GROUP BY ALL)
SELECT doc_id, nth AS mention_id, docid, md5('<' || name || ' docid="' || {esc('docid')} || '"><title>' || {esc('word')} || '</title>' || CASE WHEN rest <> '' THEN ' <citation>' || {esc('rest')} || '</citation>' ELSE '' END || '</' || name || '>') AS output, known
FROM placed JOIN k USING (doc_id, nth)"""
