"""Two-state burst automaton over daily series, its intervals and their match to known events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def burst_states(series: DataFrame, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """(kind, key, date, stories, day_total, gain, state): cheapest state path of each series.

    A day costs -(r ln p + (d - r) ln(1 - p)) with p = p0 (the overall share) in state 0 and
    s * p0 in state 1; going up costs gamma * ln(days). ``gain`` is the cost of state 0 less that
    of state 1. A series is folded forward as an array of its days, then the path is read back.
    Series without stories, and those whose share is 1 throughout, have no bursts.
    """
    day = F.struct("date", "stories", "day_total")
    per_key = series.groupBy("kind", "key").agg(F.sort_array(F.collect_list(day)).alias("days"), F.sum("stories").alias("r"), F.sum("day_total").alias("d"))
    per_key = per_key.where("r > 0 AND d > r").withColumn("p0", F.col("r").cast("double") / F.col("d").cast("double"))
    per_key = per_key.withColumn("p1", F.least(F.lit(float(s)) * F.col("p0"), F.lit(0.9999))).withColumn("up", F.lit(float(gamma)) * F.ln(F.size("days").cast("double")))

    def cost(x: Column, p: Column) -> Column:
        return -(x["stories"].cast("double") * F.ln(p) + (x["day_total"] - x["stories"]).cast("double") * F.ln(1 - p))

    costs = F.transform("days", lambda x: F.struct(cost(x, F.col("p0")).alias("c0"), cost(x, F.col("p1")).alias("c1")))
    per_key = per_key.withColumn("costs", costs)

    # fold: the two totals so far, and for each day from which state either state was reached
    start = F.struct(
        F.element_at("costs", 1)["c0"].alias("t0"),
        (F.element_at("costs", 1)["c1"] + F.col("up")).alias("t1"),
        F.array(F.struct(F.lit(0).alias("f0"), F.lit(0).alias("f1"))).alias("came"),
    )

    def forward(acc: Column, c: Column) -> Column:
        stay0, stay1 = acc["t0"] <= acc["t1"], acc["t1"] <= acc["t0"] + F.col("up")
        came = F.struct(F.when(stay0, 0).otherwise(1).alias("f0"), F.when(stay1, 1).otherwise(0).alias("f1"))
        return F.struct(
            (F.least(acc["t0"], acc["t1"]) + c["c0"]).alias("t0"),
            (F.least(acc["t1"], acc["t0"] + F.col("up")) + c["c1"]).alias("t1"),
            F.concat(acc["came"], F.array(came)).alias("came"),
        )

    folded = per_key.withColumn("fold", F.aggregate(F.slice("costs", F.lit(2), F.size("costs")), start, forward))
    last = F.when(F.col("fold")["t0"] <= F.col("fold")["t1"], F.lit(0)).otherwise(F.lit(1))
    steps = F.reverse(F.slice(F.col("fold")["came"], F.lit(2), F.size("costs")))
    path = F.aggregate(steps, F.array(last), lambda acc, c: F.concat(F.array(F.when(acc[0] == 0, c["f0"]).otherwise(c["f1"])), acc))
    out = folded.withColumn("path", path).select("kind", "key", F.explode(F.arrays_zip("days", "costs", "path")).alias("z"))
    return out.select("kind", "key", "z.days.date", "z.days.stories", "z.days.day_total", (F.col("z.costs.c0") - F.col("z.costs.c1")).alias("gain"), F.col("z.path").alias("state"))


def bursts(series: DataFrame, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """One row per run of days in the upper state: bounds, weight, stories, first peak, z figures.

    ``series`` has kind, key, date, stories, day_total, z, z_outlier.
    """
    hot = burst_states(series, s, gamma).where("state = 1").select("kind", "key", "date", "gain")
    hot = hot.join(series.select("kind", "key", "date", "stories", "z", "z_outlier"), ["kind", "key", "date"])
    island = F.date_sub("date", F.row_number().over(Window.partitionBy("kind", "key").orderBy("date")))
    return (
        hot.withColumn("island", island)
        .groupBy("kind", "key", "island")
        .agg(
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            F.count("*").alias("days"),
            F.round(F.sum("gain"), 1).alias("weight"),
            F.sum("stories").alias("stories"),
            F.min_by("date", F.struct(-F.col("stories"), "date")).alias("peak_date"),
            F.max("stories").alias("peak_stories"),
            F.max("z").alias("max_z"),
            F.count_if("z_outlier").alias("z_days"),
        )
        .drop("island")
    )


def ranked(found: DataFrame, n: int = 100, kind: str = "entity") -> DataFrame:
    """The n heaviest bursts of a kind with their rank; ties by key and start."""
    top = found.where(F.col("kind") == kind).orderBy(F.desc("weight"), "key", "start").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("weight"), "key", "start")))


def match_events(top: DataFrame, events: DataFrame, margin: int = 3) -> DataFrame:
    """``top`` with what_it_was: the first known event (by position) near the peak that has a word in the key.

    ``events`` has position, start, end, event, keys (``;`` between words). Each event stands for the
    days it covers with ``margin``, so bursts find it by the day of their peak.
    """
    fold = lambda c: F.translate(F.lower(c), "ё", "е")
    days = F.explode(F.sequence(F.date_sub("start", margin), F.date_add("end", margin)))
    covered = events.where(F.col("start") <= F.col("end")).select("position", "event", F.split(fold(F.col("keys")), ";").alias("words"), days.alias("peak_date"))
    named = F.exists("words", lambda w: F.contains(fold(F.col("key")), w))
    hits = top.join(covered, "peak_date").where(named).groupBy("kind", "key", "start").agg(F.min_by("event", "position").alias("what_it_was"))
    return top.join(hits, ["kind", "key", "start"], "left")


def detection_metrics(matched: DataFrame, events: DataFrame, head: int = 20) -> DataFrame:
    """Precision among the first ``head`` bursts, recall of known events, agreement with the z-score; one row."""
    first = F.col("rank") <= head
    known = events.agg(F.count("*").alias("n"))
    out = matched.agg(
        F.avg(F.when(first, F.col("what_it_was").isNotNull().cast("double"))).alias("precision"),
        F.count_distinct("what_it_was").alias("events_found"),
        F.avg(F.when(first, (F.col("z_days") > 0).cast("double"))).alias("zscore_agreement"),
    ).crossJoin(F.broadcast(known))  # one row each
    return out.select("precision", "events_found", (F.col("events_found").cast("double") / F.nullif(F.col("n").cast("double"), F.lit(0.0))).alias("recall"), "zscore_agreement")


def peak_headlines(top: DataFrame, doc_keys: DataFrame, titles: DataFrame, n: int = 3) -> DataFrame:
    """Up to n headlines of each burst's peak day, in article order, joined by `` | ``."""
    named = doc_keys.join(titles.select("article_id", "title"), "article_id").where("title IS NOT NULL")
    on_peak = top.select("kind", "key", "start", F.col("peak_date").alias("date")).join(named, ["kind", "key", "date"])
    rank = F.row_number().over(Window.partitionBy("kind", "key", "start").orderBy("article_id"))
    few = on_peak.withColumn("r", rank).where(F.col("r") <= n).groupBy("kind", "key", "start")
    return few.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), " | ").alias("headlines"))
