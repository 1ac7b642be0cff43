"""De-identification of a stream: per-document work alone, so the same plan runs on batches and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from umbra.operators import rewriting
from umbra.operators.detection import Detector, detectors


def deidentified(
    docs: DataFrame,
    language: str = "en",
    mode: str = "replace",
    found_by: list[Detector] | None = None,
    provider: rewriting.Provider | None = None,
) -> DataFrame:
    """docs (doc_id, text) with entities, output, events and replacement_map; docs may be a stream."""
    return rewriting.deidentified(docs, found_by or detectors(language), mode, provider)


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "doc_id long, text string", **options: str) -> StreamingQuery:
    """Reads new JSON files in a folder and appends their results as Parquet, each once; ends when all are read."""
    stream = spark.readStream.schema(schema).json(source)
    return deidentified(stream, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
