"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of ``directory``; with ``columns``, only these (pruned in the scan)."""
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df
