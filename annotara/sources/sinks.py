"""Sinks: stage tables with resume, processing history, report tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def resumed(docs: DataFrame, path: str, key: str, stage: Callable[[DataFrame], DataFrame], overwrite: bool = False) -> DataFrame:
    """A stage's table: rows that it lacks are computed and appended, the others left as they are."""
    spark = docs.sparkSession
    done = None if overwrite else existing(spark, path)
    if done is None:
        stage(docs).write.mode("overwrite").parquet(path)
    else:
        left = docs.join(done.select(key).distinct(), key, "left_anti")
        if not left.isEmpty():
            stage(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_files(rows: DataFrame, path: str, name: str, value: str) -> int:
    """One file per row below path, named by a column, with the column's text or bytes; repeats of a task write
    the same files again.  Returns their number.  path has a scheme that the workers can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        n = 0
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = f"{root}/{file}"
                system.create_dir(at.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(at) as out:
                    out.write(data.encode() if isinstance(data, str) else data or b"")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select(name, value).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_links(mapping: DataFrame, path: str) -> None:
    """<doc_id>_coref_mapping.json and <doc_id>_coref_clusters.json of mapping (doc_id, mention_id, docid): ids to
    docids, and the ids of each docid; mentions without docid are clusters of their own, and not in the mapping."""
    key = F.coalesce(F.concat(F.lit("d:"), "docid"), F.concat(F.lit("m:"), F.col("mention_id").cast("string")))
    one = mapping.groupBy("doc_id", key.alias("k")).agg(F.array_sort(F.collect_list(F.col("mention_id").cast("string"))).alias("ids"))
    groups = one.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("value"))
    named = mapping.where("docid is not null").groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("mention_id").cast("string"), "docid"))))).alias("value"))
    for rows, suffix in ((groups, "clusters"), (named, "mapping")):
        write_files(rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(f"_coref_{suffix}.json")).alias("file"), "value"), path, "file", "value")


def write_resolutions(found: DataFrame, path: str) -> None:
    """<doc_id>_resolution.json of each document: docid to uri, score, candidate_id, candidate_title, query_text and
    the ranked candidates.  found: doc_id, docid, these, and topk as array<struct<uri,score,candidate_title>>."""
    one = F.struct("uri", "score", "candidate_id", "candidate_title", "query_text", "topk")
    rows = found.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("docid", one.alias("v"))), lambda a, b: F.when(a["docid"] < b["docid"], -1).when(a["docid"] > b["docid"], 1).otherwise(0)))).alias("value"))
    write_files(rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_resolution.json")).alias("file"), "value"), path, "file", "value")


def read_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, docid, uri, score, candidate_id, candidate_title, query_text, topk of files as write_resolutions has them."""
    kind = "struct<uri:string,score:double,candidate_id:bigint,candidate_title:string,query_text:string,topk:array<struct<uri:string,score:double,candidate_title:string>>>"
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"_resolution\.json$", "").alias("doc_id"), F.explode(F.from_json("value", f"map<string,{kind}>")).alias("docid", "v"))
    return text.select("doc_id", "docid", "v.*")


def truncated(output: Column, most: int = 2000) -> Column:
    """A raw output, or a note of its length where it is too long to keep."""
    return F.when(F.length(output) > most, F.concat(F.lit("[Output truncated - "), F.length(output).cast("string"), F.lit(" chars]"))).otherwise(output)


def write_history(records: DataFrame, path: str, most: int = 2000) -> None:
    """Records of processed chunks as JSON lines, one folder per document."""
    records.withColumn("raw_output", truncated(F.col("raw_output"), most)).write.mode("overwrite").partitionBy("doc_id").json(path)


def write_report(table: DataFrame, path: str) -> None:
    """A small result table as one CSV file with header."""
    table.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
