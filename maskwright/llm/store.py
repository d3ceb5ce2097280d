"""Intermediate tables in the folder the cluster shares, so that lineage is cut without losing data with an executor."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship, sound_unions


_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; only on one machine (tests), and where it is unset, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"maskwright-{os.getpid()}")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet under the shared folder and reads it back: computed once, short lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/maskwright-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, through Hadoop's file system."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        if "/maskwright-" in path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Shuffle files of frames that are no longer held go when the driver collects its garbage: now."""
    gc.collect()
    spark._jvm.System.gc()


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _mw_file and _mw_row, which tell rows apart whatever they hold: the place in the files that docs reads, stored first if it reads none."""
    if not _reads_files(docs):
        docs = materialize(docs)
    return docs.select("*", F.xxhash64("_metadata.file_path").alias("_mw_file"), F.col("_metadata.row_index").alias("_mw_row"))


def _reads_files(docs: DataFrame) -> bool:
    """Whether each row of docs is one of a Parquet file: read, and at most filtered and projected."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    if node.nodeName() != "LogicalRelation" or "_metadata" in docs.columns:
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def clear(spark: SparkSession) -> None:
    """Deletes all that materialize() has written in this process: once results that may still read it are stored elsewhere."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs on executors: they get the package, and batches of few rows, as texts are long (an own setting stays)."""
    ship(spark)
    sound_unions(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
