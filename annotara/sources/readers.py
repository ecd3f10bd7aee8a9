"""Scans: documents as files, CSV and JSON pools, gold/system pairs, slices."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import stored

SPLITS = ("train", "test", "dev", "incoming", "extended_test", "dev_train", "no-gold")


def html_documents(spark: SparkSession, path: str, ignored: tuple[str, ...] = ()) -> DataFrame:
    """path, stem, split, html of all .html files below path; bytes that aren't UTF-8 are read as Latin-1."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(path)
    for name in ignored:
        rows = rows.where(~F.col("path").contains(f"/{name}/"))
    utf8 = F.decode("content", "UTF-8")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1")) if hasattr(F, "is_valid_utf8") else utf8
    parts = F.split("path", "/")
    return rows.select("path", F.regexp_replace(F.element_at(parts, -1), r"\.html$", "").alias("stem"), F.element_at(parts, -2).alias("split"), text.alias("html"))


#: Byte-order marks and what they stand for.
MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def detected(data: bytes) -> tuple[str, str]:
    """(charset, text) of a document: by its byte-order mark, else valid UTF-8, else the charset that it names
    itself, else Windows-1252 where its bytes have letters there, else Latin-1."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, data.decode(name, "replace")
    try:
        return "utf-8", data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    named = re.search(rb"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", data[:4096])
    for name in ([named[1].decode("ascii")] if named else []) + (["windows-1252"] if any(0x80 <= b < 0xA0 for b in data) else []):
        try:
            if name.lower().replace("_", "-") not in ("utf-8", "utf8"):
                return name.lower(), data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return "iso-8859-1", data.decode("iso-8859-1")


def with_charset(files: DataFrame) -> DataFrame:
    """files (content as bytes) with charset and html."""

    @F.arrow_udf("charset string, html string")
    def run(content: pa.Array) -> pa.Array:
        rows = [detected(c or b"") for c in content.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["charset", "html"])

    return files.withColumn("found", run(F.col("content"))).select("*", "found.charset", "found.html").drop("found", "content")


def html_files_detected(spark: SparkSession, path: str) -> DataFrame:
    """path, charset, html of all .html files below path, each in the charset it is found to have."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(path)
    return with_charset(rows.select("path", "content"))


def listing(docs: DataFrame, split: str) -> DataFrame:
    """The stems of a split in order, numbered from 1."""
    own = docs.where(F.col("split") == split).select("stem").distinct()
    return numbered(own, "stem")


def first_split(docs: DataFrame) -> DataFrame:
    """Each stem once, from the first split that has it."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")), F.lit(99))
    order = Window.partitionBy("stem").orderBy(F.when(rank == 0, 99).otherwise(rank), "path")
    return docs.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def numbered(rows: DataFrame, order: str, name: str = "n") -> DataFrame:
    """rows with their number from 1 in the order of a column: sorted over ranges that are stored, numbered
    within each file, and moved by the counts of the files before it, a row each."""
    parts = stored(rows.repartitionByRange(order).sortWithinPartitions(order), "numbered")
    placed = parts.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    placed = placed.withColumn("__file", F.regexp_extract("__file", r"part-(\d+)", 1).cast("long"))
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__size"))
    before = sizes.select("__file", (F.sum("__size").over(Window.orderBy("__file")) - F.col("__size")).alias("__before"))
    return placed.join(F.broadcast(before), "__file").withColumn(name, F.col("__before") + F.col("__row") + 1).drop("__file", "__row", "__before")


def sliced(rows: DataFrame, order: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows start to end (from 1, both included) in the order of a column; the end is clamped."""
    start = 1 if start is None else start
    if start < 1 or (end is not None and end < start):
        raise ValueError("start must be 1 or more, end not before it")
    if end is None:
        out = numbered(rows, order, "__n").where(F.col("__n") >= start).drop("__n")
    else:
        top = rows.orderBy(order).limit(end)  # only so many rows meet in the window
        out = top.withColumn("__n", F.row_number().over(Window.orderBy(order))).where(F.col("__n") >= start).drop("__n")
    if start > 1 and out.isEmpty():
        raise ValueError("start is beyond the last row")
    return out


def csv_pool(spark: SparkSession, path: str, required: tuple[str, ...] = ("original_url", "metadata")) -> DataFrame:
    """A CSV with quoted JSON columns; missing columns are an error before anything is read."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return rows


def cluster_files(spark: SparkSession, path: str) -> DataFrame:
    """stem, cluster, mention_id of JSON files that hold arrays of arrays of ids."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "array<array<string>>").alias("c"))
    rows = text.select(F.regexp_replace("file", r"(_coref_clusters)?\.json$", "").alias("stem"), F.posexplode("c").alias("cluster", "m"))
    return rows.select("stem", "cluster", F.explode("m").alias("mention_id"))


#: What each task adds to a stem, and all of them.
SUFFIXES = {"extraction": r"_(?:[0-3]|final|processed)$", "coref": r"_coref(?:_clusters|_mapping)?$", "resolution": r"_resolution$", None: r"_(?:[0-3]|final|processed|coref|resolution)$"}


def paired(gold: DataFrame, system: DataFrame, task: str | None = None, folders: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pairs by stem (one system file each, the last by path), and the gold stems without partner.  System files
    lie flat, or each in a folder of its stem's name; their names may end in a suffix of the task."""
    stem = F.element_at(F.split("path", "/"), -2) if folders else F.regexp_replace("stem", SUFFIXES[task], "")
    own = system.where(F.col("stem").rlike(SUFFIXES[task])) if folders else system
    own = own.withColumn("stem", stem)
    best = own.withColumn("__n", F.row_number().over(Window.partitionBy("stem").orderBy(F.col("path").desc()))).where("__n = 1")
    pairs = gold.select("stem", F.col("html").alias("gold")).join(best.select("stem", F.col("html").alias("system")), "stem")
    return pairs, gold.select("stem").join(best, "stem", "left_anti")


def unlisted(docs: DataFrame, *others: DataFrame) -> DataFrame:
    """Stems that none of the other listings has."""
    left = docs.select("stem").distinct()
    for o in others:
        left = left.join(o.select("stem").distinct(), "stem", "left_anti")
    return left


def split_of(folder: Column) -> Column:
    """The split that a folder's name begins with, null for others."""
    first = F.split(folder, "_")[0]
    return F.when(first.isin(*SPLITS), first)
