"""Sinks: the processed table, the false-alarm detail, report tables and
the model package.  All writes are Spark writers (Parquet by default, CSV
with a header on request), partitioned by the engine, so any shared file
system URI works and nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from alertsieve.operators.models import load_model_package, save_model_package  # noqa: F401
from alertsieve.operators.reports import fp_detail, processed_columns


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: tuple = ()) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def export_processed(labelled: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S5: problemId, title, startTime, duration, label, score, confidence."""
    write_table(processed_columns(labelled), path, fmt)


def export_fp_detail(labelled: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S6: false alarms with detail columns, highest confidence first
    (a global sort: files are written in order)."""
    write_table(fp_detail(labelled), path, fmt)


def export_patterns(patterns: DataFrame, path: str, fmt: str = "csv") -> None:
    """S7: the per-title pattern table."""
    write_table(patterns, path, fmt)


def export_attribution(ranking: DataFrame, path: str, fmt: str = "csv") -> None:
    """S8: the feature attribution ranking."""
    write_table(ranking, path, fmt)
