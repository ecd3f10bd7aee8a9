"""Tables between the steps of an operator, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir.  Where it is unset, a folder of the warehouse
    takes its place; only in local mode, as in tests, a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and spark.sparkContext.master.startswith("local"):
        root = tempfile.mkdtemp(prefix="annotara-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    if not root:
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/annotara-stages"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/annotara/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme, file:///... where it is local."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = str(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get, so that long texts don't pile up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its scan is too small to reach them, for steps that cost far more than
    the exchange; larger scans stay as they are."""
    spark = df.sparkSession
    files, cores = df.inputFiles(), spark.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    size, conf, parts = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))), spark._jsc.hadoopConfiguration(), 0
    for f in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
        parts += -(-path.getFileSystem(conf).getFileStatus(path).getLen() // size)
    return df if parts >= cores else df.repartition(cores)
