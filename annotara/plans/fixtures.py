"""Test relations that stand for annotated documents, derived from the given tables by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import hash8, squeezed
from ..operators.retrieval import bm25_tokens
from ..sources.staging import spread

LABELS = ("decision", "legislation", "secondary sources", "title", "citation", "fragment", "source", "authors")
FIELDS = {"title": "title", "citation": "citation", "fragment": "fragment"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _label(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), (n % 8 + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, norm: the squeezed lines that aren't empty."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), squeezed(F.col("line")).alias("norm")).where("norm <> ''")


def gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("seq").cast("string"))
    rows = lines(spark, sf_dir).withColumn("k", key).withColumn("h", hash8(F.col("k")))
    uri = F.when(F.col("h") % 8 > 2, F.lit(None)).when(F.col("h") % 11 == 0, F.lit("none")).otherwise(F.concat(F.lit("https://ex.org/"), (F.col("h") % 50).cast("string")))
    return rows.select(
        "doc_id", "seq", _label(F.col("h")).alias("labelname"), F.col("norm").alias("text"), F.lower("norm").alias("context"),
        F.concat(F.lit("D"), (F.floor(F.col("h") / 8) % 20).cast("string")).alias("docid"), uri.alias("uri"), F.concat(F.lit("t"), (F.col("h") % 3).cast("string")).alias("titletype"), "h", "k",
    )


def system_spans(spark: SparkSession, sf_dir: str, salt: str = "s") -> DataFrame:
    """The gold spans with errors chosen by a salted hash, and spurious ones."""
    gold = gold_spans(spark, sf_dir).withColumn("e", hash8(F.concat("k", F.lit(salt))) % 10)
    copied = F.struct(
        F.col("seq"), F.when(F.col("e") == 1, _label(F.col("h") + 1)).otherwise(F.col("labelname")).alias("labelname"),
        F.when(F.col("e") == 2, F.substring("text", 1, 20)).otherwise(F.col("text")).alias("text"),
        F.when(F.col("e") == 3, F.concat("uri", F.lit("x"))).when(F.col("e") == 4, F.lit(None)).otherwise(F.col("uri")).alias("uri"),
        F.when(F.col("e") == 5, F.upper("titletype")).when(F.col("e") == 6, F.lit("t9")).otherwise(F.col("titletype")).alias("titletype"),
    )
    extra = F.struct((F.col("seq") + 100_000).alias("seq"), "labelname", F.concat(F.lit("spurious "), F.col("seq").cast("string")).alias("text"), "uri", "titletype")
    both = F.array_compact(F.array(F.when(F.col("e") != 0, copied), F.when(F.col("h") % 17 == 0, extra)))  # in one pass over gold
    return gold.select("doc_id", "context", "docid", F.explode(both).alias("s")).select("doc_id", "s.seq", "s.labelname", "s.text", "context", "docid", "s.uri", "s.titletype")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as mentions: the first letter or digit names the entity, the other words are values: the
    second, the third, and all further ones together."""
    words = bm25_tokens(F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", words.alias("w")).where(F.size("w") > 0)
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("mention_id"), F.substring(F.col("w")[0], 1, 1).alias("docid"), F.col("role").alias("doc_type"), F.get("w", F.lit(1)).alias("title"), F.get("w", F.lit(2)).alias("citation"), F.when(F.size("w") > 3, F.array_join(F.slice("w", 4, F.size("w")), " ")).alias("fragment"))


def coref(spark: SparkSession, sf_dir: str, of: int = 10, drop: bool = True) -> tuple[DataFrame, DataFrame]:
    """Gold and system clusters: blocks of 50 vectors are documents, labels clusters; a fifth of the system's
    mentions move to the next cluster."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 50).cast("long").alias("doc_id"), F.col("vec_id").alias("mention_id"), (F.col("label") % of if of == 10 else F.col("vec_id") % of).cast("int").alias("label"), hash8(F.col("vec_id").cast("string")).alias("h"))
    gold = rows.where("h % 13 <> 1") if drop else rows
    system = rows.where("h % 13 <> 0") if drop else rows
    moved = F.when(F.col("h") % 5 == 0, (F.col("label") + 1) % of).otherwise(F.col("label"))
    return gold.select("doc_id", "mention_id", F.col("label").alias("cluster")), system.select("doc_id", "mention_id", moved.cast("int").alias("cluster"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.upper("lang").alias("doctype"), "text", squeezed(F.split("text", "\n")[0]).alias("title"))


def pool_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.array(*map(F.lit, ("EN", "FR", "DE", "ES", "XX")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("qtext"), F.element_at(types, (F.col("item_id") % 5 + 1).cast("int")).alias("qtype"))
