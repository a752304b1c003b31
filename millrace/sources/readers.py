"""Readers. Schemas are always given: inference costs a pass and differs between files of only failures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_ARCHIVE = "metadata struct<date: string, time: string, title: string, tags: array<string>>, text string"


def json_lines(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """JSON lines, gzipped or not. A gzipped file is one task to read: deal its rows out with ``partitions``."""
    df = spark.read.schema(schema).json(path)
    return df.repartition(partitions) if partitions else df


def head(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)


def flatten_metadata(raw: DataFrame) -> DataFrame:
    """metadata.* beside text; lists joined by ``|``, plain values as they are."""
    flat = raw.select("metadata.*", "text")
    lists = [f.name for f in flat.schema if f.dataType.typeName() == "array"]
    return flat.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists})


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, comment: str | None = None) -> DataFrame:
    """CSV with a header, quoted line feeds and doubled quotes; optionally some columns, without comment lines."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", comment is None).option("escape", '"')
    df = (reader.option("comment", comment) if comment else reader).csv(path)
    return df.select(*columns) if columns else df


def parquet_shards(spark: SparkSession, folder: str, columns: list[str] | None = None, pattern: str = "*.parquet") -> DataFrame:
    """All Parquet files of a folder whose names match, projected."""
    df = spark.read.option("pathGlobFilter", pattern).parquet(folder)
    return df.select(*columns) if columns else df


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): lines with their place in their file; large files are read in splits.

    Places are ordered by the split's first byte, then by the row in it, and don't count.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), "value").where("value <> ''")


def journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a journal up to the first torn line of each file, as an interrupted writer leaves it."""
    lines = _placed_lines(spark, path)
    torn = lines.where(F.get_json_object("value", "$").isNull()).groupBy("file").agg(F.min("at").alias("torn"))
    kept = lines.join(torn, "file", "left").where("torn IS NULL OR at < torn")
    return kept.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


def cache(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines of a keyed cache: bad lines are skipped, the last line of a key counts."""
    lines = _placed_lines(spark, path).where(F.get_json_object("value", "$").isNotNull()).withColumn("r", F.from_json("value", schema))
    return lines.groupBy(F.col(f"r.{key}").alias("__key")).agg(F.max_by("r", F.struct("file", "at")).alias("r")).select("r.*")


def with_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, absent ones as empty strings and nulls filled likewise."""
    return df.select(*[F.coalesce(F.col(c) if c in df.columns else F.lit(None).cast("string"), F.lit("")).alias(c) for c in columns])


def merged(*sources: DataFrame) -> DataFrame:
    """UNION ALL by name, columns that a source lacks being null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def in_batches(df: DataFrame, model, schema: str):
    """``df`` through a batch function of a model server: pandas in, pandas out, whole batches per call."""

    def run(frames):
        for frame in frames:
            if len(frame):
                yield model(frame)

    return df.mapInPandas(run, schema)
