"""Candidate pools and link metadata: JSON within CSV, pools put together, audits of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import audit_uri, uri_path

CANDIDATE = "array<struct<id:string,docType:string,docTitle:string,path:string,jurisdictionId:string,citedCount:int,autoCompletions:string>>"


def solr_documents(metadata: Column) -> Column:
    """The documents of a search response, an empty array where the JSON is broken."""
    parsed = F.from_json(metadata, f"struct<response:struct<docs:{CANDIDATE}>>")
    return F.coalesce(parsed["response"]["docs"], F.array().cast(CANDIDATE))


def solr_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with metadata as a JSON array of the response's documents, and one row: rows read, rows dropped because
    their JSON is broken or has no documents."""
    found = rows.withColumn("__docs", F.from_json("metadata", f"struct<response:struct<docs:{CANDIDATE}>>")["response"]["docs"])
    kept = found.where("__docs is not null").withColumn("metadata", F.to_json("__docs")).drop("__docs")
    return kept, found.agg(F.count(F.lit(1)).alias("read"), F.count_if(F.col("__docs").isNull()).alias("dropped"))


def candidates(pool: DataFrame) -> DataFrame:
    """original_url, metadata (JSON array) -> one row per candidate with its text."""
    rows = pool.select("original_url", F.posexplode(F.coalesce(F.from_json("metadata", CANDIDATE), F.array().cast(CANDIDATE))).alias("pos", "c"))
    texts = F.transform(F.coalesce(F.from_json(F.col("c.autoCompletions"), "array<struct<text:string>>"), F.array().cast("array<struct<text:string>>")), lambda x: x["text"])
    text = F.array_join(F.filter(F.concat(F.array("c.docType", "c.docTitle"), texts), lambda t: F.coalesce(F.trim(t), F.lit("")) != ""), " | ")
    return rows.select("original_url", "pos", "c.*", text.alias("metadata_text")).drop("autoCompletions")


def final_urls(rows: DataFrame) -> DataFrame:
    """The alternative CSV layout: final_url, else normalized_final_url; rows with neither go."""
    url = F.coalesce(F.nullif(F.trim("final_url"), F.lit("")), F.nullif(F.trim("normalized_final_url"), F.lit("")))
    return rows.withColumn("original_url", url).where(F.col("original_url").isNotNull())


def combined(pools: list[DataFrame], key: str, seed: int) -> DataFrame:
    """Pools one after the other in the order of a seeded hash, with that order as rank.

    Hashes spread evenly, so rows are ranked within the 4,096 values of their first three digits, and the
    counts of those, which are few, give where each begins: no task sees all rows.
    """
    from pyspark.sql import Window

    out = pools[0]
    for p in pools[1:]:
        out = out.unionByName(p)
    rows = out.withColumn("__order", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))).withColumn("__head", F.substring("__order", 1, 3))
    heads = rows.groupBy("__head").agg(F.count(F.lit(1)).alias("__n"))
    begins = heads.select("__head", (F.sum("__n").over(Window.orderBy("__head")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__head").orderBy("__order", key))
    return rows.withColumn("__inside", inside).join(F.broadcast(begins), "__head").withColumn("rank", F.col("__before") + F.col("__inside")).drop("__order", "__head", "__inside", "__before")


def missing_uris(labels: DataFrame, pool: DataFrame, uri: str = "uri", url: str = "url") -> DataFrame:
    """Labels whose real link isn't in the pool, compared as the audit does."""
    known = pool.select(audit_uri(F.col(url)).alias("__known")).distinct()
    real = labels.where(F.col(uri).isNotNull() & ~F.lower(F.trim(uri)).isin("", "none", "null", "nan"))
    return real.withColumn("__uri", audit_uri(F.col(uri))).join(known, F.col("__uri") == F.col("__known"), "left_anti").drop("__uri")


def uri_counts(labels: DataFrame, uri: str = "uri") -> DataFrame:
    """One row: total, without link, with link, different links."""
    real = F.col(uri).isNotNull() & ~F.lower(F.trim(uri)).isin("", "none")
    return labels.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.coalesce(real, F.lit(False))).alias("without"), F.count_if(real).alias("with_uri"), F.count_distinct(F.when(real, F.col(uri))).alias("unique_uris"))


def deduplicated_paths(rows: DataFrame, url: str) -> DataFrame:
    """One row per normalised path: the first url by order of text, and how many share it."""
    return rows.groupBy(uri_path(F.col(url)).alias("path")).agg(F.min(url).alias("first_url"), F.count(F.lit(1)).alias("urls"))


def annotation_meta(html: Column) -> Column:
    """Milliseconds of work from the annotation tool's comment, null without one."""
    found = F.regexp_extract(html, r"(?s)<!--\s*\w+\s*(\{.*?\})\s*-->", 1)
    return F.get_json_object(F.nullif(found, F.lit("")), "$.meta.time").cast("double")
