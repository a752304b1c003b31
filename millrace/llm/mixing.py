"""Mixing sources to target weights.

Tokens are summed per source, the sums become targets and repetition rates, and each
document is emitted floor(rate) times plus one more copy with probability equal to the
fraction, decided by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import WORD, unit_hash, word_count

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Rows of the target table (a source name, four numbers) up to which it is broadcast.
BROADCAST_SOURCES = 50_000


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> the same with weight, target and rate; one row per source.

    With weights w, sizes s and total S the fixed point of "cap, reshare the excess" is
    target = min(cap * s, w * level). Taking sources by growing cap * s / w, each prefix of
    capped ones gives a candidate level (S - capped) / (weights left); the level is their maximum.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    levels = (
        ranked.withColumn("ratio", F.lit(float(cap)) * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("left", F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("weight").over(after).cast("double"))
        .withColumn("level", F.max("level").over(everything))
    )
    target = F.least(F.lit(float(cap)) * F.col("source_size"), F.col("weight").cast("double") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return levels.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "weight", "target", "rate")


def _with_targets(sized: DataFrame, table: DataFrame) -> DataFrame:
    small = table.withColumnRenamed("source", "__source")
    if table.count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    return sized.join(small, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def _copies(seed: str, *key: str):
    whole = F.floor("rate")
    return (whole + (unit_hash(seed, *map(F.col, key)) < F.col("rate") - whole).cast("int")).cast("long")


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies.

    Null texts and texts without words have size 0 and take nothing; a null source is a
    source of its own, last in order; repeated rows are decided alike. An empty table gives
    no rows. Columns other than doc_id, text and source are not looked at.
    """
    sized = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    table = settle(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap))
    return (
        _with_targets(sized, table)
        .withColumn("copies", _copies(seed, "doc_id"))
        .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it; same columns.

    Rows are handled as in mix_counts(); what a source of size 0 holds is dropped, as its rate is 0.
    """
    per_source = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    table = settle(targets(per_source, weights, cap)).select(F.col("source").alias("__source"), F.col("rate").alias("__rate"))
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rated = docs.join(table, F.col("source").eqNullSafe(F.col("__source")), "left")
    whole = F.floor("__rate")
    copies = (whole + (unit_hash(seed, F.col("doc_id")) < F.col("__rate") - whole).cast("int")).cast("int")
    repeated = rated.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ranked
), goals AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight::DOUBLE * (SELECT max(level) FROM levels)) AS target FROM levels
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM goals
), copied AS (
  SELECT doc_id, size, source_size, target,
    (floor(rate) + (CASE WHEN ('0x' || left(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS copies
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM copied
"""
