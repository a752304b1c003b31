"""Daily and weekly series over stories: volume, shares, sentiment, lifetimes, profiles, z-scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SENTIMENTS = ("pos", "neu", "neg", "unknown")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def local_day(ts: Column, tz: str | None = None) -> Column:
    """Calendar day of an instant, in UTC or in ``tz``."""
    return F.to_date(F.from_utc_timestamp(ts, tz) if tz else ts)


def utc_instant(wall: Column, tz: str) -> Column:
    """Local wall time to UTC; null where the time doesn't exist or is ambiguous in ``tz``."""
    instant = F.to_utc_timestamp(wall, tz)
    gap = F.from_utc_timestamp(instant, tz) != wall
    overlap = F.from_utc_timestamp(instant + F.expr("INTERVAL 1 HOUR"), tz) == wall
    return F.when(~gap & ~overlap, instant)


def parse_time(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Parsed timestamp, null where the text doesn't parse; a missing time of day counts as midnight."""
    return F.try_to_timestamp(F.when(F.length(text) == 10, F.concat(text, F.lit(" 00:00:00"))).otherwise(text), F.lit(fmt))


def offset_instant(text: Column) -> Column:
    """The instant of an ISO 8601 text with an offset or Z; without one it counts as UTC; null where it doesn't parse."""
    return F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z"))))


def calendar(frame: DataFrame, day: str = "date") -> DataFrame:
    """Every day from the first to the last one in ``frame``."""
    ends = frame.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    return ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias(day))


def story_days(articles: DataFrame) -> DataFrame:
    """(story_id, date, articles) of each day on which a story has an article."""
    return articles.groupBy("story_id", "date").agg(F.count("*").alias("articles"))


def daily_volume(articles: DataFrame, labelled: DataFrame, sources: list[str]) -> DataFrame:
    """Articles, active, new and labelled stories of each day, and articles by source; quiet days are 0.

    ``articles`` has story_id, source, date; ``labelled`` has story_id. One pass counts articles,
    one over story-days the rest.
    """
    per_day = articles.groupBy("date").agg(F.count("*").alias("articles"), *[F.count_if(F.col("source") == s).alias(f"articles_{s}") for s in sources])
    days = story_days(articles).select("story_id", "date")
    first = days.groupBy("story_id").agg(F.min("date").alias("first"))
    marked = days.join(first, "story_id").join(labelled.select("story_id", F.lit(True).alias("has_label")).distinct(), "story_id", "left")
    stories = marked.groupBy("date").agg(F.count("*").alias("stories"), F.count_if(F.col("date") == F.col("first")).alias("new_stories"), F.count("has_label").alias("enriched_stories"))
    joined = calendar(articles).join(per_day, "date", "left").join(stories, "date", "left")
    counts = ["articles", "stories", "new_stories", "enriched_stories", *[f"articles_{s}" for s in sources]]
    return joined.select("date", F.weekday("date").alias("weekday"), F.month("date").alias("month"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])


def daily_share(days: DataFrame, labels: DataFrame) -> DataFrame:
    """(date, label, n_stories, share): stories of the day with the label over labelled stories of the day.

    ``days`` has story_id, date; ``labels`` has story_id, label; a pair counts once.
    """
    pairs = labels.select("story_id", "label").where("label IS NOT NULL").distinct()
    active = days.select("story_id", "date").distinct()
    series = active.join(pairs, "story_id").groupBy("date", "label").agg(F.count("*").alias("n_stories"))
    total = active.join(pairs.select("story_id").distinct(), "story_id", "left_semi").groupBy("date").agg(F.count("*").alias("day_total"))
    return series.join(total, "date").select("date", "label", "n_stories", ratio(F.col("n_stories"), F.col("day_total")).alias("share"))


def sentiment_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each sentiment per key group, 0 where absent."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS])


def sentiment_daily(days: DataFrame, mentions: DataFrame) -> DataFrame:
    """Sentiment counts and shares of each day, over distinct (story, entity, sentiment)."""
    pairs = mentions.select("story_id", "entity_id", "sentiment").distinct()
    table = sentiment_table(days.select("story_id", "date").distinct().join(pairs, "story_id"), ["date"])
    total = reduce(lambda a, b: a + b, map(F.col, SENTIMENTS))
    return table.select("date", *SENTIMENTS, *[ratio(F.col(s), total).alias(f"{s}_share") for s in SENTIMENTS])


def entity_sentiment_weekly(days: DataFrame, mentions: DataFrame, top: DataFrame) -> DataFrame:
    """Weekly (from Monday) sentiment of the entities in ``top``; index = (pos - neg) / (pos + neu + neg)."""
    pairs = mentions.join(top.select("entity_id").distinct(), "entity_id", "left_semi").select("story_id", "entity_id", "sentiment").distinct()
    part = days.select("story_id", "date").distinct().join(pairs, "story_id").withColumn("week", F.to_date(F.date_trunc("week", "date")))
    keys = ["entity_id", "week"]
    counts = part.groupBy(*keys).agg(*[F.count_if(F.col("sentiment") == s).alias(s) for s in SENTIMENTS], F.count_distinct("story_id").alias("n_stories"))
    return counts.withColumn("sentiment_index", ratio(F.col("pos") - F.col("neg"), F.col("pos") + F.col("neu") + F.col("neg")))


def story_lifetime(articles: DataFrame) -> DataFrame:
    """Size, sources, first and last time, days (inclusive) and hours of each story; ``articles`` has ts."""
    life = articles.groupBy("story_id").agg(F.count("*").alias("size"), F.count_distinct("source").alias("n_sources"), F.min("ts").alias("first_dt"), F.max("ts").alias("last_dt"))
    seconds = F.unix_micros(F.col("last_dt").cast("timestamp")) - F.unix_micros(F.col("first_dt").cast("timestamp"))
    return life.withColumn("lifetime_days", (F.date_diff("last_dt", "first_dt") + 1).cast("long")).withColumn("lifetime_hours", F.round(seconds / F.lit(3.6e9), 1))


def lifetime_distribution(life: DataFrame) -> DataFrame:
    """Stories of two articles or more by lifetime, with share and running share."""
    counts = life.where("size > 1").groupBy("lifetime_days").agg(F.count("*").alias("stories"))
    total = F.sum("stories").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    running = F.sum("stories").over(Window.orderBy("lifetime_days").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return counts.select("lifetime_days", "stories", ratio(F.col("stories"), total).alias("share"), ratio(running, total).alias("cum_share"))


def lifetime_summary(life: DataFrame) -> DataFrame:
    """One row of counts and linearly interpolated quantiles over stories of two articles or more."""
    multi = F.col("size") > 1
    days, hours = F.when(multi, F.col("lifetime_days")), F.when(multi, F.col("lifetime_hours"))
    return life.agg(
        F.count("*").alias("stories"),
        F.count_if(F.col("size") == 1).alias("single_article_stories"),
        F.count_if(multi).alias("multi_article_stories"),
        F.percentile(days, F.lit(0.5)).alias("multi_days_median"),
        F.percentile(days, F.lit(0.9)).alias("multi_days_p90"),
        F.percentile(days, F.lit(0.99)).alias("multi_days_p99"),
        F.max(days).alias("multi_days_max"),
        F.percentile(hours, F.lit(0.5)).alias("multi_hours_median"),
        ratio(F.count_if(days > 3), F.count_if(multi)).alias("multi_share_longer_3_days"),
        ratio(F.count_if(days > 7), F.count_if(multi)).alias("multi_share_longer_7_days"),
    )


def longest_stories(life: DataFrame, mentions: DataFrame, n: int = 20, names: int = 3) -> DataFrame:
    """The n longest stories with their most frequent entities, ties to smaller keys."""
    top = life.where("size > 1").orderBy(F.desc("lifetime_days"), F.desc("size"), "story_id").limit(n)
    counts = mentions.join(top.select("story_id"), "story_id", "left_semi").groupBy("story_id", "entity_id").agg(F.count("*").alias("c"))
    rank = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("c"), "entity_id"))
    best = counts.withColumn("r", rank).where(F.col("r") <= names).groupBy("story_id")
    best = best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "entity_id"))), lambda x: x["entity_id"]), ", ").alias("top_entities"))
    return top.select("story_id", "size", "lifetime_days").join(best, "story_id", "left")


def volume_profile(volume: DataFrame, by: str) -> DataFrame:
    """Mean daily volume by weekday or month, and articles and stories against their overall means."""
    means = volume.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("articles", "stories", "new_stories", "enriched_stories")])
    overall = volume.agg(F.avg("articles").alias("a"), F.avg("stories").alias("s"))
    both = means.crossJoin(F.broadcast(overall))  # one row
    return both.select(by, "articles", "stories", "new_stories", "enriched_stories", ratio(F.col("articles"), F.col("a")).alias("articles_vs_mean"), ratio(F.col("stories"), F.col("s")).alias("stories_vs_mean"))


def label_lift(series: DataFrame, volume: DataFrame, by: str) -> DataFrame:
    """(label, by, lift, year_share): a label's share in the weekday or month over its overall share."""
    counts = series.join(volume.select("date", by), "date").groupBy("label", by).agg(F.sum("n_stories").alias("n"))
    part = volume.groupBy(by).agg(F.sum("enriched_stories").alias("part_total"))
    whole = volume.agg(F.sum("enriched_stories").alias("whole_total"))
    label_total = F.sum("n").over(Window.partitionBy("label"))
    out = counts.withColumn("label_n", label_total).join(part, by).crossJoin(F.broadcast(whole))  # one row
    year = ratio(F.col("label_n"), F.col("whole_total"))
    return out.select("label", by, (ratio(F.col("n"), F.col("part_total")) / year).alias("lift"), year.alias("year_share"))


def rolling_mean(volume: DataFrame, column: str, days: int = 7) -> DataFrame:
    """Centred mean over ``days``, null until the window is full. The calendar has one row a day."""
    half = days // 2
    w = Window.orderBy("date").rowsBetween(-half, half)
    return volume.select("date", column, F.when(F.count(column).over(w) == days, F.avg(column).over(w)).alias("rolling"))


def weekly_share(series: DataFrame, volume: DataFrame, top: int = 8) -> DataFrame:
    """Shares of the ``top`` labels by week, named by its Sunday."""
    best = series.groupBy("label").agg(F.sum("n_stories").alias("n")).orderBy(F.desc("n"), "label").limit(top).select("label")
    sunday = F.date_add(F.to_date(F.date_trunc("week", "date")), 6)
    counts = series.join(F.broadcast(best), "label", "left_semi").groupBy(sunday.alias("week"), "label").agg(F.sum("n_stories").alias("n"))  # ``top`` rows
    total = volume.groupBy(sunday.alias("week")).agg(F.sum("enriched_stories").alias("total"))
    return counts.join(total, "week").select("week", "label", ratio(F.col("n"), F.col("total")).alias("share"))


def weekend_ratio(volume: DataFrame) -> DataFrame:
    """Mean volume of weekends over that of working days, one row."""
    weekend = F.col("weekday") >= 5
    both = lambda c: ratio(F.avg(F.when(weekend, F.col(c))), F.avg(F.when(~weekend, F.col(c)))).alias(f"{c}_ratio")
    return volume.agg(both("articles"), both("stories"))


def dense_series(docs: DataFrame, doc_keys: DataFrame, top_entities: int = 300) -> DataFrame:
    """(kind, key, date, stories, day_total, share): distinct stories a day of all topics and the
    most frequent entities, 0 on days without. ``docs`` has story_id, date; ``doc_keys`` also kind, key."""
    keys = doc_keys.groupBy("kind", "key").agg(F.count_distinct("story_id").alias("n"))
    best = keys.where("kind = 'entity'").orderBy(F.desc("n"), "key").limit(top_entities).select("key")
    entity = doc_keys.where("kind = 'entity'").join(F.broadcast(best), "key", "left_semi")  # ``top_entities`` rows
    kept = doc_keys.where("kind = 'topic'").select("kind", "key", "story_id", "date").unionByName(entity.select("kind", "key", "story_id", "date"))
    counts = kept.groupBy("kind", "key", "date").agg(F.count_distinct("story_id").alias("stories"))
    totals = docs.groupBy("date").agg(F.count_distinct("story_id").alias("day_total"))
    days = calendar(docs).join(totals, "date", "left").select("date", F.coalesce("day_total", F.lit(0)).alias("day_total"))
    ends = docs.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = counts.select("kind", "key").distinct().crossJoin(F.broadcast(ends))  # one row
    grid = grid.select("kind", "key", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("date"))
    joined = grid.join(counts, ["kind", "key", "date"], "left").join(days, "date")
    stories = F.coalesce("stories", F.lit(0)).cast("long")
    return joined.select("kind", "key", "date", stories.alias("stories"), F.col("day_total").cast("long").alias("day_total"), F.coalesce(ratio(stories, F.col("day_total")), F.lit(0.0)).alias("share"))


def zscore(series: DataFrame, window: int = 28, threshold: float = 3.0, min_stories: int = 5) -> DataFrame:
    """z of the share against the ``window`` days before, null until there are so many.

    The deviation is floored at one story of a mean day; an outlier also has ``min_stories``.
    """
    w = Window.partitionBy("kind", "key").orderBy("date").rowsBetween(-window, -1)
    floor = series.where("day_total > 0").select("date", "day_total").distinct().agg((1 / F.avg("day_total")).alias("floor"))
    full = F.count("share").over(w) == window
    out = series.crossJoin(F.broadcast(floor)).withColumn("m", F.when(full, F.avg("share").over(w))).withColumn("s", F.when(full, F.stddev_samp("share").over(w)))  # one row
    z = F.round((F.col("share") - F.col("m")) / F.greatest("s", "floor"), 2)
    return out.withColumn("z", z).withColumn("z_outlier", F.coalesce((F.col("z") >= threshold) & (F.col("stories") >= min_stories), F.lit(False))).drop("m", "s", "floor")
