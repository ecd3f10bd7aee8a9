"""What the operators of this folder share: text access, shared storage, row locators."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_dir, spread, stored  # noqa: F401  (the operators take them from here)
from ..sources.staging import small_batches as tune  # noqa: F401

#: The white space that the contracts name: [\x20\x09-\x0D].
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to path to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished stages now, not at its next long pause."""
    gc.collect()
    spark._jvm.System.gc()


def text_of(col: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def located(docs: DataFrame, need: list[str], name: str) -> tuple[DataFrame, Column]:
    """docs and a column that tells its rows apart even if ids and texts repeat.

    The locator is the file and the row's index in it.  Rows that come from no file scan are written
    to the shared folder first.
    """

    def meta(df: DataFrame) -> Column:
        m = df.metadataColumn("_metadata")
        return F.struct(m["file_path"].alias("file"), m["row_index"].alias("row"))

    try:
        docs.select(*need, meta(docs)).schema  # noqa: B018  (analysis is eager on purpose)
    except AnalysisException:
        docs = stored(docs, name)
    return docs, meta(docs)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def hashed_sample(rows: DataFrame, key: str, about: int) -> DataFrame:
    """All rows, or where there are more, those whose hashed key falls below about / rows: close to `about`
    of them, the same ones in every run, without sending more than those anywhere."""
    n = rows.count()
    if n <= about:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(about / n * (1 << 30)))


def with_values(docs: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """The rows of docs whose doc_id known has, with its small number known.value; known: a row per id.  Ids and
    numbers go to the tasks as two plain arrays (9 bytes of each id), so texts aren't moved to find them."""
    got = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(value).cast("byte").alias("v")).toArrow()
    ids, values = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.argsort(ids)
    shared = docs.sparkSession.sparkContext.broadcast((ids[order], values[order]))

    @F.arrow_udf("int")
    def found(doc_id: pa.Array) -> pa.Array:
        ids, values = shared.value
        own = doc_id.fill_null(0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
        if not len(ids):
            return pa.nulls(len(own), pa.int32())
        return pa.array(values[at].astype(np.int32), mask=(ids[at] != own) | doc_id.is_null().to_numpy(zero_copy_only=False))

    return docs.withColumn(value, found(F.col("doc_id").cast("long"))).where(F.col(value).isNotNull())


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
