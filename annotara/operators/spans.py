"""Span evaluation: one-to-one matching, scores and their roll-ups, anchoring, attributes and links.

Spans are rows (doc_id, seq, labelname, text, context, ...).  Matching is by equality of (document, label,
text, context), each side used once, so counts are multiset intersections and pairs are equal keys with
equal occurrence numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "labelname", "text", "context"]
#: The same, text and context by a digest: what is grouped, joined and shuffled.
NARROW = ["doc_id", "labelname", "span_key"]
PARENTS = ("decision", "legislation", "secondary sources")


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def prf(tp: str = "tp", gold: str = "n_gold", system: str = "n_system") -> list[Column]:
    p, r = ratio(F.col(tp), F.col(system)), ratio(F.col(tp), F.col(gold))
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1")]


def narrowed(spans: DataFrame) -> DataFrame:
    """Adds span_key, a digest of text and context (a null is a value of its own)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("text", "context")]
    return spans.withColumn("span_key", F.unhex(F.sha2(F.concat_ws("\x01", *parts), 256)))


def match_counts(gold: DataFrame, system: DataFrame) -> DataFrame:
    """doc_id, labelname, tp, n_gold, n_system."""
    both = narrowed(gold).select(*NARROW, F.lit(1).alias("g"), F.lit(0).alias("s")).unionByName(narrowed(system).select(*NARROW, F.lit(0).alias("g"), F.lit(1).alias("s")))
    keys = both.groupBy(*NARROW).agg(F.sum("g").alias("g"), F.sum("s").alias("s"))
    return keys.groupBy("doc_id", "labelname").agg(F.sum(F.least("g", "s")).alias("tp"), F.sum("g").alias("n_gold"), F.sum("s").alias("n_system"))


def numbered(spans: DataFrame) -> DataFrame:
    """Adds span_key and nth, the number of a span among its equals."""
    return narrowed(spans).withColumn("nth", F.row_number().over(Window.partitionBy(*NARROW).orderBy("seq")))


def pairs(gold: DataFrame, system: DataFrame, fields: list[str]) -> DataFrame:
    """Matched pairs: KEY, seq of the gold span, and gold_<f>, system_<f> for each field."""
    g = numbered(gold.select(*KEY, "seq", *[f for f in fields if f not in (*KEY, "seq")])).select(*KEY, "span_key", "nth", "seq", *[F.col(f).alias(f"gold_{f}") for f in fields])
    s = numbered(system).select(*NARROW, "nth", *[F.col(f).alias(f"system_{f}") for f in fields])
    return g.join(s, [*NARROW, "nth"]).drop("nth", "span_key")


def unmatched(spans: DataFrame, others: DataFrame) -> DataFrame:
    """Spans without a partner among the others."""
    return numbered(spans).join(numbered(others).select(*NARROW, "nth"), [*NARROW, "nth"], "left_anti").drop("nth", "span_key")


def scores_by(counts: DataFrame, *keys: str) -> DataFrame:
    total = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_system")])
    return total.select(*keys, "tp", "n_gold", "n_system", *prf())


def rollup(counts: DataFrame) -> DataFrame:
    """One pass for the overall, per-document, per-label and parent/child totals; absent keys are 'all'."""
    c = counts.withColumn("level", F.when(F.col("labelname").isin(*PARENTS), "parent").otherwise("child")).withColumn("doc", F.col("doc_id").cast("string"))
    sets = c.groupingSets([[], ["doc"], ["labelname"], ["level"]], "doc", "labelname", "level").agg(*[F.sum(x).alias(x) for x in ("tp", "n_gold", "n_system")])
    return sets.select(*[F.coalesce(k, F.lit("all")).alias(k) for k in ("doc", "labelname", "level")], "tp", "n_gold", "n_system", *prf())


def macro_f1(counts: DataFrame) -> DataFrame:
    docs = counts.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("tp", "n_gold", "n_system")])
    p, r = ratio(F.col("tp"), F.col("n_system")), ratio(F.col("tp"), F.col("n_gold"))
    return docs.agg(F.round(F.avg(ratio(2 * p * r, p + r)), 6).alias("macro_f1"), F.count(F.lit(1)).alias("documents"))


def anchoring_counts(human: DataFrame, assisted: DataFrame, machine: DataFrame) -> DataFrame:
    """doc_id, labelname, extra (assisted spans that humans alone didn't make), anchored (of these as many as the
    machine has of its own): per key the differences and minima of counts, in one pass over all three."""
    sides = {"human": human, "assisted": assisted, "machine": machine}
    rows = None
    for name, own in sides.items():
        one = narrowed(own).select(*NARROW, *[F.lit(int(s == name)).alias(s) for s in sides])
        rows = one if rows is None else rows.unionByName(one)
    keys = rows.groupBy(*NARROW).agg(*[F.sum(s).alias(s) for s in sides]).withColumn("extra", F.greatest(F.col("assisted") - F.col("human"), F.lit(0)))
    return keys.where("extra > 0").select("doc_id", "labelname", "extra", F.least("extra", "machine").alias("anchored"))


def anchoring(human: DataFrame, assisted: DataFrame, machine: DataFrame) -> DataFrame:
    """Per label: assisted spans that humans alone didn't make, and how many of them are the machine's own."""
    total = anchoring_counts(human, assisted, machine).groupBy("labelname").agg(F.sum("anchored").alias("anchored"), F.sum("extra").alias("extra"))
    return total.select("labelname", "anchored", "extra", F.round(ratio(F.col("anchored"), F.col("extra")), 6).alias("rate"))


def anchoring_rollup(human: DataFrame, assisted: DataFrame, machine: DataFrame) -> DataFrame:
    """anchoring per document, per label and over all; absent keys are 'all'."""
    counts = anchoring_counts(human, assisted, machine).withColumn("doc", F.col("doc_id").cast("string"))
    sets = counts.groupingSets([[], ["doc"], ["labelname"]], "doc", "labelname").agg(F.sum("anchored").alias("anchored"), F.sum("extra").alias("extra"))
    return sets.where("extra > 0").select(F.coalesce("doc", F.lit("all")).alias("doc"), F.coalesce("labelname", F.lit("all")).alias("labelname"), "anchored", "extra", F.round(ratio(F.col("anchored"), F.col("extra")), 6).alias("rate"))


def anchoring_by_id(human: DataFrame, assisted: DataFrame, machine: DataFrame) -> DataFrame:
    """anchoring where spans carry ids: an assisted span is the machine's own if the machine has its id."""
    extra = unmatched(assisted, human)
    own = extra.join(machine.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi").groupBy("labelname").agg(F.count(F.lit(1)).alias("anchored"))
    total = extra.groupBy("labelname").agg(F.count(F.lit(1)).alias("extra")).join(own, "labelname", "left").na.fill(0, ["anchored"])
    return total.select("labelname", "anchored", "extra", F.round(ratio(F.col("anchored"), F.col("extra")), 6).alias("rate"))


def category(label: Column, parent: Column | None = None) -> Column:
    """The label of a parent span, else the first of its comma-separated parents, else other."""
    first = F.trim(F.split(F.coalesce(parent, F.lit("")), ",")[0]) if parent is not None else F.lit("")
    return F.when(label.isin(*PARENTS), label).when(first.isin(*PARENTS), first).otherwise("other")


def attribute_rows(matched: DataFrame, fields: list[str]) -> DataFrame:
    """One row per pair and attribute that either side has: doc_id, labelname, attr, agree (0 or 1)."""
    each = F.array(*[F.struct(F.lit(f).alias("attr"), F.col(f"gold_{f}").alias("g"), F.col(f"system_{f}").alias("s")) for f in fields])
    rows = matched.select("doc_id", "labelname", F.explode(each).alias("a")).where(F.col("a.g").isNotNull() | F.col("a.s").isNotNull())
    same = F.coalesce(F.lower(F.trim("a.g")) == F.lower(F.trim("a.s")), F.lit(False))
    return rows.select("doc_id", "labelname", F.col("a.attr").alias("attr"), same.cast("int").alias("agree"))


def agreement(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("agree").alias("agree"), F.count(F.lit(1)).alias("total")).select(*keys, "agree", "total", F.round(F.col("agree") / F.col("total"), 6).alias("accuracy"))


def macro_agreement(rows: DataFrame) -> DataFrame:
    """Mean over documents that have attributes at all."""
    docs = rows.groupBy("doc_id").agg(F.avg("agree").alias("a"))
    return docs.agg(F.round(F.avg("a"), 6).alias("macro_accuracy"), F.count(F.lit(1)).alias("documents"))


def real_uri(uri: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(uri)).isin("", "none"), F.lit(False))


def uri_outcomes(gold: DataFrame, system: DataFrame) -> DataFrame:
    """doc_id, labelname, outcome of each span that counts.

    A gold span with a real link is tp, fn_wrong (another link, "none" included), fn_missing_sys_uri (no
    link) or fn_missed_extraction (no partner); an unmatched system span with a real link is fp_spurious;
    gold spans without a real link are skipped_gold_none.
    """
    g, s = numbered(gold.select(*KEY, "seq", "uri")).select(*NARROW, "nth", "uri"), numbered(system).select(*NARROW, "nth", F.col("uri").alias("system_uri"), F.lit(True).alias("has"))
    named = F.lower(F.trim("uri")), F.lower(F.trim("system_uri"))
    of_gold = g.join(s, [*NARROW, "nth"], "left").select(
        "doc_id", "labelname",
        F.when(~real_uri(F.col("uri")), "skipped_gold_none").when(F.col("has").isNull(), "fn_missed_extraction").when(F.coalesce(F.trim("system_uri"), F.lit("")) == "", "fn_missing_sys_uri").when(named[0] == named[1], "tp").otherwise("fn_wrong").alias("outcome"),
    )
    spurious = unmatched(system, gold).where(real_uri(F.col("uri"))).select("doc_id", "labelname", F.lit("fp_spurious").alias("outcome"))
    return of_gold.unionByName(spurious)


def uri_scores(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Wrong links count as missed and as spurious."""
    n = {o: F.count_if(F.col("outcome") == o) for o in ("tp", "fn_wrong", "fn_missing_sys_uri", "fn_missed_extraction", "fp_spurious", "skipped_gold_none")}
    c = outcomes.groupBy(*keys).agg(*[v.alias(k) for k, v in n.items()])
    fn = F.col("fn_wrong") + F.col("fn_missing_sys_uri") + F.col("fn_missed_extraction")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fn_wrong") + F.col("fp_spurious")), ratio(F.col("tp"), F.col("tp") + fn)
    linked = F.col("tp") + F.col("fn_wrong")
    return c.select(*keys, *n, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * p * r, p + r), 6).alias("f1"), F.round(ratio(F.col("tp"), linked), 6).alias("accuracy"))


def located_spans(spans: DataFrame, plain: str, chars: int = 200) -> DataFrame:
    """Adds start_pos and context: the nth span of a label and text takes the nth place, without overlaps,
    where its text occurs in the document's plain text; context is squeezed lower text around it.  Spans that have
    their nth already stay where they are; others are brought together, each with its text, to be numbered."""
    if "nth" not in spans.columns:
        spans = spans.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "labelname", "text").orderBy("seq")))
    # Within a quotation \E would end it: it is quoted on its own.
    parts = F.split(F.col(plain), F.concat(F.lit(r"\Q"), F.replace(F.col("text"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")), -1)
    head = F.aggregate(F.slice(parts, 1, F.col("nth")), F.lit(0), lambda a, p: a + F.length(p))
    at = F.when(F.size(parts) > F.col("nth"), head + (F.col("nth") - 1) * F.length("text")).otherwise(-1)
    low = F.greatest(F.col("start_pos") - chars, F.lit(0))
    size = F.when(F.col("start_pos") < 0, chars).otherwise(F.col("start_pos") - low + F.length("text") + chars)
    around = F.col(plain).substr(low + 1, size)
    return spans.withColumn("start_pos", at).withColumn("context", F.trim(F.lower(F.regexp_replace(around, r"(?U)\s+", " ")))).drop("nth")
