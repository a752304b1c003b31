"""Sinks. Spark's commit protocol makes a file visible when it is complete, so no rename is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header in each file; nested columns as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "struct", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def parquet(df: DataFrame, path: str, sort_by: str | None = None, partition_by: str | None = None, mode: str = "error") -> None:
    """zstd Parquet, sorted within files, optionally a folder per value of a column."""
    out = df.sortWithinPartitions(sort_by) if sort_by else df
    writer = out.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def summary(df: DataFrame) -> str:
    """The JSON document of a one-row summary."""
    return df.select(F.to_json(F.struct("*")).alias("j")).first()["j"]


def journal(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)
