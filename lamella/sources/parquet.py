"""Scans and sinks of one Parquet table per level, through Spark's own file systems."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def scan_levels(spark: SparkSession, source: str, levels: list[str], pattern: str = "{level}", **options: Any) -> dict[str, DataFrame]:
    """For each level ``<stem>.parquet``, a file or folder, else every file below ``<stem>/``."""
    out, lost = {}, []
    for level in levels:
        stem = f"{source}/{pattern.format(level=level)}"
        reader = spark.read.options(**options)
        if exists(spark, f"{stem}.parquet"):
            out[level] = reader.parquet(f"{stem}.parquet")
        elif exists(spark, stem):
            out[level] = reader.option("recursiveFileLookup", "true").parquet(stem)
        else:
            lost.append(level)
    if lost:
        raise FileNotFoundError(f"No Parquet tables for levels {lost} below {source}.")
    return out


def sink_levels(tables: Mapping[str, DataFrame], destination: str, pattern: str = "{level}", mode: str = "overwrite", **options: Any) -> None:
    for level, table in tables.items():
        table.write.mode(mode).options(**options).parquet(f"{destination}/{pattern.format(level=level)}.parquet")
