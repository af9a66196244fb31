"""Score an alert stream with a frozen scoring model.

Fitting (global statistics, forest, threshold) is done on a reference
batch; applying it is row-local (literals + a broadcast forest), so the
very same transform runs on ``readStream`` input: Structured Streaming
plans it as a stateless map, with exactly-once file sinks and restart
from the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from alertsieve.operators.scoring import ScoringModel
from alertsieve.sources.alerts import ALERT_CSV_SCHEMA, _csv_options, clean_tokens, normalize_timestamps

RAW_PARQUET_SCHEMA = T.StructType([
    T.StructField("problemId", T.StringType()),
    T.StructField("displayId", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("severityLevel", T.StringType()),
    T.StructField("impactLevel", T.StringType()),
    T.StructField("startTime", T.LongType()),
    T.StructField("endTime", T.LongType()),
    T.StructField("status", T.StringType()),
])


def read_alert_stream(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Alert files as a stream.  CSV has the batch reader's types, null tokens
    and time parsing; its columns must stand in the order of ``schema``
    (a header in another order fails the batch)."""
    if schema is None:
        schema = ALERT_CSV_SCHEMA if fmt == "csv" else RAW_PARQUET_SCHEMA
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = _csv_options(reader, False).option("enforceSchema", False)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(path)
    return normalize_timestamps(clean_tokens(stream) if fmt == "csv" else stream)


def score_stream(model: ScoringModel, stream: DataFrame) -> DataFrame:
    """Labelled stream: features, method scores, final score, label, confidence."""
    return model.transform(stream)


def start_scoring(model: ScoringModel, stream: DataFrame, out_path: str, checkpoint: str,
                  available_now: bool = True, columns=None):
    """Write the labelled stream as Parquet (exactly once via the checkpoint)."""
    scored = score_stream(model, stream)
    if columns:
        scored = scored.select(*columns)
    writer = (scored.writeStream.format("parquet").option("path", out_path)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
