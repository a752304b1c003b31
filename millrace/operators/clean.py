"""Quality checks of documents, rejects with reasons, boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

CHECKS = ("no_date", "no_title", "short_text", "low_letter_share", "not_ru")


def fails(share: Column) -> Column:
    """A check whose figure is unknown counts as failed."""
    return F.coalesce(share, F.lit(True))


def flagged(
    docs: DataFrame,
    min_title: int = 10,
    min_text: int = 200,
    min_letters: float = 0.6,
    min_native: float = 0.85,
    native: str = "[а-яёА-ЯЁ]",
    latin: str = "[a-zA-Z]",
) -> DataFrame:
    """``docs`` (dt_utc, title, text) with a boolean column for each check.

    Ratios with a zero denominator, and nulls, fail. ``native`` is the alphabet that texts must be in.
    """
    own, other = X.letter_counts(F.col("text"), native, latin)
    letters = own + other
    ratio = lambda a, b: a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))
    return (
        docs.withColumn("no_date", F.col("dt_utc").isNull())
        .withColumn("no_title", fails(F.length(F.trim("title")) < min_title))
        .withColumn("short_text", fails(F.length("text") <= min_text))
        .withColumn("low_letter_share", fails(ratio(letters, F.length("text")) <= min_letters))
        .withColumn("not_ru", fails(ratio(own, letters) < min_native))
    )


def with_reason(checked: DataFrame) -> DataFrame:
    """Adds ``reason``: names of failed checks in order, joined by ``;``, empty if none failed."""
    return checked.withColumn("reason", F.concat_ws(";", *[F.when(F.col(c), F.lit(c)) for c in CHECKS]))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected with reason)."""
    reasoned = with_reason(checked)
    return reasoned.where("reason = ''").drop("reason", *CHECKS), reasoned.where("reason <> ''").drop(*CHECKS)


def reject_stats(checked: DataFrame) -> DataFrame:
    """(check, records, pct of all rows), in one pass."""
    sums = checked.agg(*[F.count_if(c).alias(c) for c in CHECKS], F.count("*").alias("n"))
    stacked = sums.select("n", F.expr(f"stack({len(CHECKS)}, {', '.join(f"'{c}', {c}" for c in CHECKS)}) AS (check, records)"))
    return stacked.select("check", "records", (F.lit(100.0) * F.col("records") / F.nullif(F.col("n"), F.lit(0))).alias("pct"))


def boilerplate(docs: DataFrame, blocks: Column, min_docs: int = 20, longest: int = 400, shortest: int = 20) -> DataFrame:
    """(key, docs): keys of blocks of (shortest, longest] characters that ``min_docs`` documents hold."""
    sized = F.filter(blocks, lambda s: (F.length(s) > shortest) & (F.length(s) <= longest))
    keys = docs.select(F.explode(F.array_distinct(F.transform(sized, X.comparison_key))).alias("key"))
    return keys.where("key <> ''").groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)


def without_boilerplate(docs: DataFrame, doc_id: str, blocks: Column, keys: DataFrame) -> DataFrame:
    """(doc_id, kept blocks joined by line feeds): the first of each key that isn't boilerplate.

    Keys are joined, not broadcast, as their number grows with the corpus.
    """
    each = docs.select(doc_id, F.posexplode(blocks).alias("pos", "block")).withColumn("key", X.comparison_key(F.col("block"))).where("key <> ''")
    kept = each.join(keys.select("key"), "key", "left_anti").groupBy(doc_id, "key").agg(F.min(F.struct("pos", "block")).alias("b"))
    joined = kept.groupBy(doc_id).agg(F.array_join(F.transform(F.sort_array(F.collect_list("b")), lambda x: x["block"]), "\n").alias("text"))
    return docs.select(doc_id).join(joined, doc_id, "left").select(doc_id, F.coalesce("text", F.lit("")).alias("text"))
