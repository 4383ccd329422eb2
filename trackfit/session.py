"""Session helpers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it lies in the same place; elsewhere install it or pass it with --py-files."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark
