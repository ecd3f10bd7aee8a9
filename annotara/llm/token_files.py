"""Token-id output as Parquet (operator 2).

Format.  One row per document in ascending doc_id order over the files part-00000, part-00001, ...:
doc_id and n_tokens (delta encoded), ids (list of int, dictionary encoded while the dictionary fits,
else delta encoded) and ids_crc32.  Row groups and pages have set sizes and the files carry page
indexes, so a reader fetches one document's ids, or the metadata of all, without the rest.

Scale.  One range exchange on doc_id, and the texts' beginnings where many rows share an id, carries the
texts; tokenising, encoding and writing follow in the same tasks.  Reading back shuffles narrow rows only.

Cases.  Null text counts as empty (only the end id is written); null ids come first; repeated ids stay
next to each other, ordered by text; an empty table gives no rows; further columns are ignored, whatever
their names; texts of any length are encoded as a whole.  Special tokens that a text holds literally are
ordinary text, so that a document can't end itself, unless literal is false: then they are as in the
library's plain encode.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir
from .word_ids import word_ids

VOCABULARY, END_ID = "word_bpe_49k.json", 2
SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, ids array<int>"


def layout(row_group_mb: int = 32, page_rows: int = 500, page_kb: int = 256) -> dict[str, str]:
    """Writer settings of the file format."""
    return {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(row_group_mb << 20), "parquet.page.size": str(page_kb << 10),
        "parquet.page.row.count.limit": str(page_rows), "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#n_tokens": "false", "parquet.enable.dictionary#ids_crc32": "false",
    }


def encode_rows(docs: DataFrame, vocabulary_path: str, end_id: int = END_ID, literal: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, ids_crc32, ids with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_ids(vocabulary_path, literal), end_id.to_bytes(4, "little")
        for b in batches:
            packed = [x + end for x in coder.encode(b.column(1).cast(pa.binary()).to_pylist())]
            sizes = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array([zlib.crc32(x) for x in packed], pa.int64()), ids], ["doc_id", "n_tokens", "ids_crc32", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int = END_ID, literal: bool = True, **sizes: int) -> None:
    """Writes docs' ids to path in ascending doc_id order."""
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    encode_rows(ordered, vocabulary_path, end_id, literal).write.options(**layout(**sizes)).parquet(path)


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The written rows of low <= doc_id <= high; the range reaches the page indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    return rows if high is None else rows.where(F.col("doc_id") <= high)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and n_tokens from the metadata columns alone."""
    rows = _placed(read_tokens(spark, path)).select("doc_id", "n_tokens", "file", "row")
    return _started(rows, rows).select("doc_id", "start", "n_tokens")


def _placed(rows: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return rows.select("*", name.alias("file"), F.col("_metadata.row_index").alias("row"))


def _started(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds start: ids before the row, over files in order and rows in order; sizes has file and n_tokens.
    The window without a key sees one row per file."""
    files = sizes.groupBy("file").agg(F.sum("n_tokens").alias("in_file"))
    before = files.select("file", (F.sum("in_file").over(Window.orderBy("file")) - F.col("in_file")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").withColumn("start", (F.col("before") + F.col("inside")).cast("long"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, all from the ids in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            sizes = np.diff(at).astype(np.int64)
            crc = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    rows = _placed(read_tokens(spark, path)).select("doc_id", "file", "row", "ids").mapInArrow(run, "doc_id long, file long, row long, n_tokens long, ids_crc32 long")
    return _started(rows, _placed(read_tokens(spark, path)).select("file", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")


def query(docs: DataFrame, vocabulary_path: str, literal: bool = True) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark, "token-files")
    write_tokens(docs, path, vocabulary_path, literal=literal)
    return digests(spark, path)
