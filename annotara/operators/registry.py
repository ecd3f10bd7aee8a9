"""Reference profiles of a document: first-seen folds as relations.

Mentions are rows (doc_id, mention_id, docid, doc_type, and value fields).  Mentions without a docid
never merge: each gets a profile of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import normalized_docid

FIELDS = ("title", "citation", "fragment", "author")


def keyed(mentions: DataFrame) -> DataFrame:
    """Adds profile: the docid, or a key of the mention's own."""
    return mentions.withColumn("profile", F.coalesce(F.concat(F.lit("d:"), normalized_docid(F.col("docid"))), F.concat(F.lit("m:"), F.col("mention_id").cast("string"))))


def values(mentions: DataFrame, fields: dict[str, str]) -> DataFrame:
    """First sighting of each value: doc_id, profile, field, value, first_seen_id, ord (order of sighting)."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in fields.items()])
    rows = keyed(mentions).select("doc_id", "profile", "mention_id", F.explode(each).alias("v")).where(F.coalesce(F.trim("v.value"), F.lit("")) != "")
    first = rows.groupBy("doc_id", "profile", F.col("v.field").alias("field"), F.col("v.value").alias("value")).agg(F.min("mention_id").alias("first_seen_id"))
    order = Window.partitionBy("doc_id", "profile", "field").orderBy("first_seen_id", "value")
    return first.withColumn("ord", F.row_number().over(order))


def profiles(mentions: DataFrame, fields: dict[str, str]) -> DataFrame:
    """doc_id, profile, docid, doc_type (of the first mention that has one), first_seen_id, n_mentions,
    main_title (first title), and one ordered array per field."""
    k = keyed(mentions)
    base = k.groupBy("doc_id", "profile").agg(F.min(normalized_docid(F.col("docid"))).alias("docid"), F.min_by("doc_type", F.when(F.col("doc_type").isNotNull(), F.col("mention_id"))).alias("doc_type"), F.min("mention_id").alias("first_seen_id"), F.count(F.lit(1)).alias("n_mentions"))
    v = values(mentions, fields)

    def listed(field: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("ord", "value", "first_seen_id"))))
        return F.transform(own, lambda x: F.struct(x["value"].alias("value"), x["first_seen_id"].alias("first_seen_id"))).alias(f"{field}s")

    lists = v.groupBy("doc_id", "profile").agg(*[listed(f) for f in fields])
    out = base.join(lists, ["doc_id", "profile"], "left")
    empty = F.array().cast("array<struct<value:string,first_seen_id:bigint>>")
    out = out.select(*base.columns, *[F.coalesce(F.col(f"{f}s").cast("array<struct<value:string,first_seen_id:bigint>>"), empty).alias(f"{f}s") for f in fields])
    return out.withColumn("main_title", F.when(F.size("titles") > 0, F.col("titles")[0]["value"])) if "title" in fields else out


def written(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda x: F.concat(x["value"], F.lit("@"), x["first_seen_id"].cast("string"))), "|")


def snapshot_before(mentions: DataFrame, first_seen: DataFrame, count: str) -> DataFrame:
    """Per mention, the rows of first_seen (doc_id, first_seen_id) strictly before it.

    The inequality becomes a running sum over the document's events: one sort instead of pairs.
    """
    events = mentions.select("doc_id", F.col("mention_id").alias("at"), F.lit(0).alias("n"), F.lit(1).alias("ask")).unionByName(first_seen.select("doc_id", F.col("first_seen_id").alias("at"), F.lit(1).alias("n"), F.lit(0).alias("ask")))
    before = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    return events.withColumn(count, F.coalesce(F.sum("n").over(before), F.lit(0))).where("ask = 1").select("doc_id", F.col("at").alias("mention_id"), count)


def snapshots(mentions: DataFrame, first: DataFrame, values: DataFrame, same_type: bool = False) -> DataFrame:
    """doc_id, mention_id, docid, doc_type, first_seen_id, values of every profile that a mention finds: those
    first seen before it, with the values (field, value, first_seen_id, in order) seen before it; same_type:
    only profiles of the mention's own type.  first: doc_id, profile, docid, doc_type, first_seen_id.

    The result is as large as the prompts that are made of it: a row per mention and earlier profile of its
    document; documents are the keys of all joins.
    """
    seen = mentions.select("doc_id", "mention_id", F.col("doc_type").alias("own_type"))
    known = seen.join(first, "doc_id").where("first_seen_id < mention_id or first_seen_id is null")
    known = known.where(F.col("own_type").eqNullSafe(F.col("doc_type"))) if same_type else known
    known = known.select("doc_id", "mention_id", "profile", "docid", "doc_type", "first_seen_id")
    lists = values.groupBy("doc_id", "profile").agg(F.array_sort(F.collect_list(F.struct("field", "ord", "value", "first_seen_id"))).alias("v"))
    rows = known.join(lists, ["doc_id", "profile"], "left")
    before = F.filter(F.coalesce("v", F.array().cast(lists.schema["v"].dataType)), lambda x: x["first_seen_id"].isNull() | (x["first_seen_id"] < F.col("mention_id")))
    return rows.select("doc_id", "mention_id", "profile", "docid", "doc_type", "first_seen_id", F.transform(before, lambda x: F.struct(x["field"].alias("field"), x["value"].alias("value"), x["first_seen_id"].alias("first_seen_id"))).alias("values"))


#: Names of a profile's parts in the JSON form (fixed values) and here.
JSON_FIELDS = {"alternative_titles": "title", "citations": "citation", "fragments_mentioned": "fragment", "authors": "author"}


def as_json(profile_rows: DataFrame, values: DataFrame) -> DataFrame:
    """doc_id, registry: {"profiles": [...]} of each document, profiles by their first mention."""

    def part(field: str) -> Column:
        own = F.array_sort(F.collect_list(F.when(F.col("field") == field, F.struct("ord", "value", "first_seen_id"))))
        return F.map_from_entries(F.transform(own, lambda x: F.struct(x["value"], x["first_seen_id"])))

    lists = values.groupBy("doc_id", "profile").agg(*[part(f).alias(n) for n, f in JSON_FIELDS.items()])
    rows = profile_rows.select("doc_id", "profile", "doc_type", "docid", "first_seen_id").join(lists, ["doc_id", "profile"], "left")
    empty = F.create_map().cast("map<string,bigint>")
    one = F.struct("first_seen_id", "profile", F.struct("doc_type", F.lit(None).cast("string").alias("jurisdiction"), "docid", *[F.coalesce(F.col(n).cast("map<string,bigint>"), empty).alias(n) for n in JSON_FIELDS], "first_seen_id").alias("p"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["first_seen_id"] < b["first_seen_id"], -1).when(a["first_seen_id"] > b["first_seen_id"], 1).when(a["profile"] < b["profile"], -1).when(a["profile"] > b["profile"], 1).otherwise(0)).alias("x"))
    return listed.select("doc_id", F.to_json(F.struct(F.transform("x", lambda x: x["p"]).alias("profiles")), {"ignoreNullFields": "false"}).alias("registry"))


def from_json(registries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles (doc_id, nth, doc_type, docid, first_seen_id, main_title) and values (doc_id, nth, field, value,
    first_seen_id, ord) of doc_id, registry.  Parts may be maps to first mentions or, as older files have
    them, lists without."""
    parts = ", ".join(f"{n}: string" for n in JSON_FIELDS)
    parsed = F.from_json("registry", f"struct<profiles: array<struct<doc_type: string, jurisdiction: string, docid: string, {parts}, first_seen_id: string>>>")["profiles"]
    rows = registries.select("doc_id", F.posexplode(parsed).alias("nth", "p"))

    def entries(name: str, field: str) -> Column:
        mapped = F.transform(F.map_entries(F.from_json(F.col(f"p.{name}"), "map<string,string>")), lambda e: F.struct(e["key"].alias("value"), e["value"].cast("bigint").alias("first_seen_id")))
        listed = F.transform(F.from_json(F.col(f"p.{name}"), "array<string>"), lambda v: F.struct(v.alias("value"), F.lit(None).cast("bigint").alias("first_seen_id")))
        either = F.when(F.col(f"p.{name}").startswith("["), listed).otherwise(mapped)
        named = F.transform(either, lambda e, i: F.struct(F.lit(field).alias("field"), e["value"].alias("value"), e["first_seen_id"].alias("first_seen_id"), (i + 1).alias("ord")))
        return F.coalesce(named, F.array().cast("array<struct<field:string,value:string,first_seen_id:bigint,ord:int>>"))

    each = F.flatten(F.array(*[entries(n, f) for n, f in JSON_FIELDS.items()]))
    found = rows.select("doc_id", "nth", F.inline(each))
    title = F.get(F.filter(each, lambda v: v["field"] == "title"), F.lit(0))["value"]
    return rows.select("doc_id", "nth", "p.doc_type", "p.docid", F.col("p.first_seen_id").cast("bigint").alias("first_seen_id"), title.alias("main_title")), found


def named_by_title(profile_rows: DataFrame) -> DataFrame:
    """Profiles whose docid is their main title, where they have one."""
    return profile_rows.withColumn("docid", F.coalesce(normalized_docid(F.col("main_title")), F.col("docid")))


def query_text(profile: DataFrame) -> Column:
    """doc_type | main title | other titles | citations | [fragments] | authors, parts that are there."""

    def names(c: str) -> Column:
        return F.transform(F.col(c), lambda x: x["value"]) if c in profile.columns else F.array().cast("array<string>")

    others = F.filter(names("titles"), lambda t: t != F.coalesce(F.col("main_title"), F.lit("")))
    fragments = F.when(F.size(names("fragments")) > 0, F.array(F.concat(F.lit("["), F.array_join(names("fragments"), ", "), F.lit("]")))).otherwise(F.array().cast("array<string>"))
    parts = F.concat(F.array("doc_type", "main_title"), others, names("citations"), fragments, names("authors"))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), " | ")


def last_values(values: Column, most: int) -> Column:
    """The last `most` values; 0 keeps all."""
    return values if most == 0 else F.slice(values, -F.least(F.lit(most), F.greatest(F.size(values), F.lit(1))), F.lit(most))
