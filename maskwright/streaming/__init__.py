"""The engine on streams. Every step is row-local, so no state and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..engine import Config, Engine


def anonymize_stream(spark: SparkSession, path: str, schema: StructType, config: Config | None = None, most_files: int = 100) -> DataFrame:
    """A stream of Parquet documents with entities, anonymized_text and mapping; `most_files` bounds a micro-batch."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)
    return Engine(spark, config).anonymize(docs)


def write_stream(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends anonymised documents exactly once and stops when what is there is done."""
    out = rows.select("doc_id", "anonymized_text")
    return out.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def drop_stale(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """Responses whose request still stands: same id, revision and document hash."""
    return responses.join(requests, ["request_id", "revision", "document_hash"], "left_semi")
