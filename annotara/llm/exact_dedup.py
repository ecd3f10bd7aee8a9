"""Exact deduplication as a stateful stream (operator 10, DataFrame functions only).

Method.  Every row is reduced to (digest of the normalised text, code points, stable id, locator of
the content) and written as a narrow table.  A Structured Streaming query reads that table in micro-batches
of bounded size and keeps, per digest, the row that stays and the number of rows seen.  The state lives in
RocksDB on the executors' disks, is saved to the shared folder after each micro-batch and never expires: no
watermark bounds it.  After the available input is consumed the state is read back as a DataFrame through
the state data source.  On hits (digests with two rows or more) the full normalised texts are compared:
digests that hold more than one text, which only a collision can produce, are grouped again by text.

Runs.  With a state folder of the caller's, a later run over further documents meets the rows of earlier
ones: its rows are added to the folder's table, the stream goes on from its checkpoint, and on hits the
earlier texts are read again through their locators, so the files of earlier runs must still be there.  A run
that is repeated under its name, after a failure or not, adds nothing twice.  The result has the rows of the
run at hand, judged among all rows seen so far.

Scale.  Texts are shuffled once, and only for the comparison; there a hot digest is dealt over salted
keys, each of which collapses equal texts before the second exchange.  State grows with the number of
different texts, on disk.

Cases.  Null text counts as empty; null ids sort last; rows repeated with the same id and text are told
apart by their locator, so one row of each group stays; an empty table gives an empty result; further
columns are ignored, whatever their names; texts of any length are read as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, complete, free_name, located, partitions, shared_dir, stored, text_of

LAST = (1 << 63) - 1
ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each small store reserves megabytes
}


def normalised(text: Column) -> Column:
    """The text without the characters of [\\x20\\x09-\\x0D]."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


#: The narrow table of all runs, a folder for each run.
ROWS = "id long, digest string, n int, at struct<file:string,row:long>, run string"
#: Bytes of narrow rows in a micro-batch for each partition of the state.
BATCH = 4 << 20


def state_of(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Lets the stream read what it hasn't read of folder/rows, and reads its state:
    (digest, keep_id, keep_at, group_size)."""
    saved = f"{folder}/checkpoint"
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        source = spark.readStream.schema(ROWS)
        bounded = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source.option("maxBytesPerTrigger", BATCH * partitions(spark))
        first = F.struct((-F.col("n")).alias("n"), F.coalesce("id", F.lit(LAST)).alias("id"), F.col("at"))
        (
            bounded.parquet(f"{folder}/rows").groupBy("digest").agg(F.min_by(F.struct("id", "at"), first).alias("keep"), F.count(F.lit(1)).alias("size"))
            .writeStream.outputMode("update").format("noop").option("checkpointLocation", saved)
            .trigger(availableNow=True).start().awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    state = spark.read.format("statestore").load(saved)
    kept, size = (F.col("value")[f.name] for f in state.schema["value"].dataType if f.name != "extremumOrdering")
    return state.select(F.col("key.digest").alias("digest"), kept["id"].alias("keep_id"), kept["at"].alias("keep_at"), size.alias("group_size"))


def texts_of(docs: DataFrame, at: Column, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    """What is compared on hits, per row: digest, norm, salt, id, at, n."""
    text = text_of()
    return docs.select(digest(normalised(text)).alias("digest"), normalised(text).alias("norm"), F.pmod(F.xxhash64("doc_id", at), F.lit(salts)).cast("int").alias("salt"), F.col("doc_id").cast("long").alias("id"), at.alias("at"), F.length(text).alias("n"))


def earlier_texts(rows: DataFrame, hits: DataFrame, digest: Callable[[Column], Column], salts: int) -> DataFrame | None:
    """texts_of the rows of earlier runs whose digest is hit, read through their locators; None without any."""
    spark = rows.sparkSession
    found = rows.join(hits.select("digest").distinct(), "digest", "left_semi").select("at")
    files = [r[0] for r in found.select("at.file").distinct().collect()]  # input files of earlier runs, not rows
    if not files:
        return None
    docs, at = located(spark.read.parquet(*files).select("doc_id", "text"), ["doc_id", "text"], "dedup-earlier")
    return texts_of(docs, at, digest, salts).join(found, "at", "left_semi")


def dedup_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state: str | None = None, run: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest, at (locator).  state: a folder that
    keeps the state between runs; run: the name of this run in it."""
    spark = docs.sparkSession
    docs, at = located(docs, ["doc_id", "text"], "dedup-input")
    text = text_of()
    folder, run = state or shared_dir(spark, "dedup-state"), run or uuid.uuid4().hex
    if not complete(spark, own := f"{folder}/rows/run={run}"):
        docs.select(F.col("doc_id").cast("long").alias("id"), digest(normalised(text)).alias("digest"), F.length(text).alias("n"), at.alias("at")).write.mode("overwrite").option("compression", "zstd").parquet(own)
    seen = spark.read.schema(ROWS).parquet(f"{folder}/rows")
    rows = seen.where(F.col("run") == run).drop("run")
    if rows.isEmpty():
        return rows.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest", "at")
    groups = stored(state_of(spark, folder, files_per_batch), "dedup-groups")

    salts = max(4, min(64, partitions(spark) // 4))
    full, mine = texts_of(docs, at, digest, salts), groups.where("group_size > 1")
    if state:  # only what this run has a part in
        mine = mine.join(rows.select("digest").distinct(), "digest", "left_semi")
        before = earlier_texts(seen.where(F.col("run") != run), mine, digest, salts)
        full = full if before is None else full.unionByName(before.select(full.columns))
    hits = mine.select("digest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    checked = full.join(hits.hint("shuffle_hash"), ["digest", "salt"], "left_semi")
    texts = checked.groupBy("digest", "salt", "norm").agg(F.count(F.lit(1)).alias("rows")).groupBy("digest", "norm").agg(F.sum("rows").alias("rows"))
    collided = stored(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "dedup-collided")
    joined = rows.join(groups, "digest")
    out = [F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "digest", "at"]
    if collided.isEmpty():
        return joined.select(*out)
    again = full.join(collided, "digest", "left_semi")
    first = F.struct((-F.col("n")).alias("n"), F.coalesce("id", F.lit(LAST)).alias("id"), F.col("at"))
    split = again.groupBy("digest", "norm").agg(F.min_by(F.struct("id", "at"), first).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    regrouped = again.join(split, ["digest", "norm"]).select("id", F.col("keep.id").alias("keep_id"), "group_size", F.col("keep.at").alias("keep_at"), "digest", "at")
    regrouped = regrouped.join(rows.select("at"), "at", "left_semi").select("id", "keep_id", "group_size", "keep_at", "digest", "at") if state else regrouped
    return joined.join(collided, "digest", "left_anti").select("id", "keep_id", "group_size", "keep_at", "digest", "at").unionByName(regrouped).select(*out)


def exact_dedup(docs: DataFrame, state: str | None = None, run: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns; with a state folder, among all runs' rows so far."""
    docs, at = located(docs, ["doc_id", "text"], "dedup-input")
    own = free_name(docs, "at")
    kept = dedup_groups(docs, state=state, run=run).where("kept").select(F.col("at").alias(own))
    return docs.select(*[docs[c] for c in docs.columns], at.alias(own)).join(kept.hint("shuffle_hash"), own, "left_semi").drop(own)


def query(docs: DataFrame) -> DataFrame:
    return dedup_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
), g AS (
  SELECT norm, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM d JOIN g USING (norm)
"""
