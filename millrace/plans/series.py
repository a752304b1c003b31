"""Series and burst queries. Stand-in: ``events``, a story being a user, a source and label an event type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bursts as B
from ..operators import series as S
from ..session import settle, table
from .base import query

SOURCES = ["click", "error", "purchase", "signup", "view"]
SENTIMENT = "CASE event_id % 4 WHEN 0 THEN 'pos' WHEN 1 THEN 'neu' WHEN 2 THEN 'neg' ELSE 'unknown' END"


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("user_id").alias("story_id"),
        F.col("event_type").alias("source"),
        F.col("event_type").alias("label"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.to_date("ts").alias("date"),
        F.from_json("props", "k int")["k"].cast("string").alias("entity_id"),
        F.expr(SENTIMENT).alias("sentiment"),
    )


def _doc_keys(articles: DataFrame) -> DataFrame:
    topics = articles.select("story_id", "date", F.lit("topic").alias("kind"), F.col("label").alias("key"))
    return topics.unionByName(articles.select("story_id", "date", F.lit("entity").alias("kind"), F.concat(F.lit("k"), "entity_id").alias("key")))


def _labelled(articles: DataFrame) -> DataFrame:
    return articles.where("label <> 'error'").select("story_id", "label")


def _volume(articles: DataFrame) -> DataFrame:
    return S.daily_volume(articles, _labelled(articles), SOURCES)


ARTICLES = f"""articles AS (
  SELECT event_id, user_id AS story_id, event_type AS source, event_type AS label, ts, ts::DATE AS date,
    json_extract_string(props, '$.k') AS entity_id, {SENTIMENT} AS sentiment FROM events
)"""
VOLUME = f"""{ARTICLES}, days AS (SELECT DISTINCT story_id, date FROM articles),
cal AS (SELECT unnest(generate_series((SELECT min(date) FROM articles), (SELECT max(date) FROM articles), INTERVAL 1 DAY))::DATE AS date),
firsts AS (SELECT story_id, min(date) AS f FROM days GROUP BY story_id),
labelled AS (SELECT DISTINCT story_id, label FROM articles WHERE label <> 'error'),
volume AS (
  SELECT cal.date, (isodow(cal.date) - 1)::INTEGER AS weekday, month(cal.date)::INTEGER AS month,
    (SELECT count(*) FROM articles a WHERE a.date = cal.date) AS articles,
    (SELECT count(*) FROM days d WHERE d.date = cal.date) AS stories,
    (SELECT count(*) FROM firsts WHERE f = cal.date) AS new_stories,
    (SELECT count(*) FROM days d WHERE d.date = cal.date AND d.story_id IN (SELECT story_id FROM labelled)) AS enriched_stories,
    {", ".join(f"(SELECT count(*) FROM articles a WHERE a.date = cal.date AND source = '{s}') AS articles_{s}" for s in SOURCES)}
  FROM cal
), series AS (
  SELECT d.date, l.label, count(*) AS n_stories, count(*)::DOUBLE / any_value(v.enriched_stories) AS share
  FROM days d JOIN labelled l USING (story_id) JOIN volume v USING (date) GROUP BY d.date, l.label
)"""
DENSE = f"""{ARTICLES}, doc_keys AS (
  SELECT story_id, date, 'topic' AS kind, label AS key FROM articles
  UNION ALL SELECT story_id, date, 'entity', 'k' || entity_id FROM articles
), best AS (
  SELECT key FROM doc_keys WHERE kind = 'entity' GROUP BY key ORDER BY count(DISTINCT story_id) DESC, key LIMIT 300
), kept AS (SELECT * FROM doc_keys WHERE kind = 'topic' OR key IN (SELECT key FROM best)),
cal AS (SELECT unnest(generate_series((SELECT min(date) FROM articles), (SELECT max(date) FROM articles), INTERVAL 1 DAY))::DATE AS date),
totals AS (SELECT date, count(DISTINCT story_id) AS day_total FROM articles GROUP BY date),
counts AS (SELECT kind, key, date, count(DISTINCT story_id) AS stories FROM kept GROUP BY ALL),
dense AS (
  SELECT k.kind, k.key, cal.date, coalesce(stories, 0)::BIGINT AS stories, coalesce(day_total, 0)::BIGINT AS day_total,
    coalesce(coalesce(stories, 0)::DOUBLE / nullif(day_total, 0), 0.0) AS share
  FROM (SELECT DISTINCT kind, key FROM counts) k CROSS JOIN cal
  LEFT JOIN counts c ON c.kind = k.kind AND c.key = k.key AND c.date = cal.date LEFT JOIN totals t ON t.date = cal.date
)"""
ZSCORED = f"""{DENSE}, floor_ AS (SELECT 1 / avg(day_total) AS f FROM (SELECT DISTINCT date, day_total FROM dense WHERE day_total > 0)),
rolled AS (
  SELECT *, CASE WHEN count(*) OVER w = 7 THEN avg(share) OVER w END AS m, CASE WHEN count(*) OVER w = 7 THEN stddev_samp(share) OVER w END AS s
  FROM dense WINDOW w AS (PARTITION BY kind, key ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
), scored AS (
  SELECT kind, key, date, stories, day_total, share, round((share - m) / greatest(s, f), 2) + 0.0::DOUBLE AS z FROM rolled, floor_
), flagged AS (SELECT *, coalesce(z >= 2.0 AND stories >= 5, false) AS z_outlier FROM scored)"""
# forward: the two totals and where each state came from; backward: the state of each day
STATES = f"""{ZSCORED}, base AS (
  SELECT kind, key, sum(stories)::DOUBLE / sum(day_total)::DOUBLE AS p0, count(*) AS n FROM flagged GROUP BY kind, key HAVING sum(stories) > 0 AND sum(day_total) > sum(stories)
), params AS (SELECT *, least(1.5::DOUBLE * p0, 0.9999::DOUBLE) AS p1, 0.5::DOUBLE * ln(n::DOUBLE) AS up FROM base),
costs AS (
  SELECT f.kind, f.key, f.date, f.stories, f.day_total, row_number() OVER (PARTITION BY f.kind, f.key ORDER BY f.date) AS t, n, up,
    -(stories::DOUBLE * ln(p0) + (day_total - stories)::DOUBLE * ln(1 - p0)) AS c0,
    -(stories::DOUBLE * ln(p1) + (day_total - stories)::DOUBLE * ln(1 - p1)) AS c1
  FROM flagged f JOIN params p ON p.kind = f.kind AND p.key = f.key
), fwd AS (
  SELECT kind, key, t, n, up, c0 AS t0, c1 + up AS t1, 0 AS f0, 0 AS f1 FROM costs WHERE t = 1
  UNION ALL
  SELECT c.kind, c.key, c.t, c.n, c.up, least(p.t0, p.t1) + c.c0, least(p.t1, p.t0 + c.up) + c.c1,
    CASE WHEN p.t0 <= p.t1 THEN 0 ELSE 1 END, CASE WHEN p.t1 <= p.t0 + c.up THEN 1 ELSE 0 END
  FROM fwd p JOIN costs c ON c.kind = p.kind AND c.key = p.key AND c.t = p.t + 1
), back AS (
  SELECT kind, key, t, CASE WHEN t0 <= t1 THEN 0 ELSE 1 END AS state FROM fwd WHERE t = n
  UNION ALL
  SELECT b.kind, b.key, b.t - 1, CASE WHEN b.state = 0 THEN f.f0 ELSE f.f1 END FROM back b JOIN fwd f ON f.kind = b.kind AND f.key = b.key AND f.t = b.t WHERE b.t > 1
), states AS (
  SELECT c.kind, c.key, c.date, c.stories, c.day_total, c.c0 - c.c1 AS gain, b.state FROM costs c JOIN back b ON b.kind = c.kind AND b.key = c.key AND b.t = c.t
), islands AS (
  SELECT s.kind, s.key, s.date, s.stories, s.gain, f.z, f.z_outlier,
    s.date - (row_number() OVER (PARTITION BY s.kind, s.key ORDER BY s.date))::INTEGER AS island
  FROM states s JOIN flagged f ON f.kind = s.kind AND f.key = s.key AND f.date = s.date WHERE state = 1
), bursts AS (
  SELECT kind, key, min(date) AS "start", max(date) AS "end", count(*) AS days, round(sum(gain), 1) AS weight, sum(stories)::BIGINT AS stories,
    arg_min(date, {{'a': -stories, 'b': date}}) AS peak_date, max(stories) AS peak_stories, max(z) AS max_z, count(*) FILTER (z_outlier) AS z_days
  FROM islands GROUP BY kind, key, island
)"""


@query(f"WITH {VOLUME} SELECT * FROM volume")
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _volume(_articles(spark, sf_dir))


@query(f"WITH {VOLUME} SELECT * FROM series")
def daily_label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return S.daily_share(a, _labelled(a))


@query(f"""WITH {ARTICLES}, part AS (
  SELECT d.date, p.sentiment FROM (SELECT DISTINCT story_id, date FROM articles) d JOIN (SELECT DISTINCT story_id, entity_id, sentiment FROM articles) p USING (story_id)
), c AS (SELECT date, {", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in S.SENTIMENTS)} FROM part GROUP BY date)
SELECT date, pos, neu, neg, unknown, {", ".join(f"{s}::DOUBLE / nullif(pos + neu + neg + unknown, 0) AS {s}_share" for s in S.SENTIMENTS)} FROM c""")
def sentiment_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return S.sentiment_daily(a, a)


@query(f"""WITH {ARTICLES}, best AS (SELECT entity_id FROM articles GROUP BY 1 ORDER BY count(*) DESC, entity_id LIMIT 20),
part AS (
  SELECT p.entity_id, date_trunc('week', d.date)::DATE AS week, p.sentiment, story_id FROM (SELECT DISTINCT story_id, date FROM articles) d
  JOIN (SELECT DISTINCT story_id, entity_id, sentiment FROM articles WHERE entity_id IN (SELECT entity_id FROM best)) p USING (story_id)
)
SELECT entity_id, week, {", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in S.SENTIMENTS)}, count(DISTINCT story_id) AS n_stories,
  (count(*) FILTER (sentiment = 'pos') - count(*) FILTER (sentiment = 'neg'))::DOUBLE / nullif(count(*) FILTER (sentiment <> 'unknown'), 0) AS sentiment_index
FROM part GROUP BY entity_id, week""")
def entity_sentiment_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    best = a.groupBy("entity_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_id").limit(20)
    return S.entity_sentiment_weekly(a, a, best)


LIFE = f"""{ARTICLES}, life AS (
  SELECT story_id, count(*) AS size, count(DISTINCT source) AS n_sources, min(ts) AS first_dt, max(ts) AS last_dt,
    (max(ts)::DATE - min(ts)::DATE + 1)::BIGINT AS lifetime_days, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9::DOUBLE, 1) AS lifetime_hours
  FROM articles GROUP BY story_id
)"""


@query(f"WITH {LIFE} SELECT story_id, size, n_sources, strftime(first_dt, '%Y-%m-%d %H:%M:%S') AS first_dt, strftime(last_dt, '%Y-%m-%d %H:%M:%S') AS last_dt, lifetime_days, lifetime_hours FROM life")
def story_lifetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    life = S.story_lifetime(_articles(spark, sf_dir))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return life.select("story_id", "size", "n_sources", text("first_dt"), text("last_dt"), "lifetime_days", "lifetime_hours")


@query(f"""WITH {LIFE}, c AS (SELECT lifetime_days, count(*) AS stories FROM life WHERE size > 1 GROUP BY 1)
SELECT lifetime_days, stories, stories::DOUBLE / sum(stories) OVER ()::DOUBLE AS share, (sum(stories) OVER (ORDER BY lifetime_days))::DOUBLE / sum(stories) OVER ()::DOUBLE AS cum_share FROM c""")
def lifetime_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lifetime_distribution(S.story_lifetime(_articles(spark, sf_dir)))


@query(f"""WITH {LIFE} SELECT count(*) AS stories, count(*) FILTER (size = 1) AS single_article_stories, count(*) FILTER (size > 1) AS multi_article_stories,
  quantile_cont(lifetime_days::DOUBLE, 0.5) FILTER (size > 1) AS multi_days_median, quantile_cont(lifetime_days::DOUBLE, 0.9) FILTER (size > 1) AS multi_days_p90,
  quantile_cont(lifetime_days::DOUBLE, 0.99) FILTER (size > 1) AS multi_days_p99, max(lifetime_days) FILTER (size > 1) AS multi_days_max,
  quantile_cont(lifetime_hours, 0.5) FILTER (size > 1) AS multi_hours_median,
  (count(*) FILTER (size > 1 AND lifetime_days > 3))::DOUBLE / count(*) FILTER (size > 1) AS multi_share_longer_3_days,
  (count(*) FILTER (size > 1 AND lifetime_days > 7))::DOUBLE / count(*) FILTER (size > 1) AS multi_share_longer_7_days FROM life""")
def lifetime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lifetime_summary(S.story_lifetime(_articles(spark, sf_dir)))


@query(f"""WITH {LIFE}, best AS (SELECT story_id, size, lifetime_days FROM life WHERE size > 1 ORDER BY lifetime_days DESC, size DESC, story_id LIMIT 20),
c AS (SELECT story_id, entity_id, row_number() OVER (PARTITION BY story_id ORDER BY count(*) DESC, entity_id) AS r FROM articles WHERE story_id IN (SELECT story_id FROM best) GROUP BY 1, 2)
SELECT b.story_id, size, lifetime_days, string_agg(entity_id, ', ' ORDER BY r) AS top_entities FROM best b LEFT JOIN c ON c.story_id = b.story_id AND r <= 3 GROUP BY ALL""")
def longest_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return S.longest_stories(S.story_lifetime(a), a)


def _profile_sql(by: str) -> str:
    return f"""WITH {VOLUME}, m AS (SELECT avg(articles) AS a, avg(stories) AS s FROM volume)
SELECT {by}, avg(articles) AS articles, avg(stories) AS stories, avg(new_stories) AS new_stories, avg(enriched_stories) AS enriched_stories,
  avg(articles) / any_value(a) AS articles_vs_mean, avg(stories) / any_value(s) AS stories_vs_mean FROM volume, m GROUP BY {by}"""


@query(_profile_sql("weekday"))
def volume_by_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.volume_profile(_volume(_articles(spark, sf_dir)), "weekday")


@query(_profile_sql("month"))
def volume_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.volume_profile(_volume(_articles(spark, sf_dir)), "month")


@query(f"""WITH {VOLUME}, c AS (SELECT label, weekday, sum(n_stories) AS n FROM series JOIN volume USING (date) GROUP BY 1, 2),
p AS (SELECT weekday, sum(enriched_stories) AS pt FROM volume GROUP BY 1), w AS (SELECT sum(enriched_stories) AS wt FROM volume),
y AS (SELECT label, sum(n)::DOUBLE / any_value(wt)::DOUBLE AS year_share FROM c, w GROUP BY label)
SELECT c.label, c.weekday, (n::DOUBLE / pt::DOUBLE) / year_share AS lift, year_share FROM c JOIN p USING (weekday) JOIN y USING (label)""")
def label_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return S.label_lift(S.daily_share(a, _labelled(a)), _volume(a), "weekday")


@query(f"""WITH {VOLUME} SELECT date, articles, CASE WHEN count(*) OVER w = 7 THEN avg(articles) OVER w END AS rolling FROM volume
WINDOW w AS (ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def rolling_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rolling_mean(_volume(_articles(spark, sf_dir)), "articles")


@query(f"""WITH {VOLUME}, best AS (SELECT label FROM series GROUP BY label ORDER BY sum(n_stories) DESC, label LIMIT 8),
t AS (SELECT date_trunc('week', date)::DATE + 6 AS week, sum(enriched_stories) AS total FROM volume GROUP BY 1)
SELECT week, label, sum(n_stories)::DOUBLE / any_value(total)::DOUBLE AS share FROM (SELECT *, date_trunc('week', date)::DATE + 6 AS week FROM series WHERE label IN (SELECT label FROM best)) s JOIN t USING (week) GROUP BY week, label""")
def weekly_label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    return S.weekly_share(S.daily_share(a, _labelled(a)), _volume(a), top=8)


@query(f"""WITH {VOLUME} SELECT avg(articles) FILTER (weekday >= 5) / avg(articles) FILTER (weekday < 5) AS articles_ratio,
avg(stories) FILTER (weekday >= 5) / avg(stories) FILTER (weekday < 5) AS stories_ratio FROM volume""")
def weekend_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.weekend_ratio(_volume(_articles(spark, sf_dir)))


def _dense(articles: DataFrame) -> DataFrame:
    return S.dense_series(articles, _doc_keys(articles), top_entities=300)


def _flagged(articles: DataFrame) -> DataFrame:
    return S.zscore(_dense(articles), window=7, threshold=2.0)


def _bursts(articles: DataFrame) -> DataFrame:
    return B.bursts(_flagged(articles), s=1.5, gamma=0.5)


@query(f"WITH {DENSE} SELECT * FROM dense")
def dense_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(_articles(spark, sf_dir))


@query(f"WITH {ZSCORED} SELECT * FROM flagged")
def zscore_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(_articles(spark, sf_dir))


@query(f"WITH RECURSIVE {STATES} SELECT kind, key, date, stories, day_total, round(gain, 6) AS gain, state::INTEGER AS state FROM states")
def burst_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.burst_states(_flagged(_articles(spark, sf_dir)), s=1.5, gamma=0.5).withColumn("gain", F.round("gain", 6))


@query(f"WITH RECURSIVE {STATES} SELECT * FROM bursts")
def burst_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bursts(_articles(spark, sf_dir))


@query(f"""WITH RECURSIVE {STATES} SELECT strftime(peak_date, '%A') AS weekday, count(*) AS bursts, count(*)::DOUBLE / (SELECT count(*) FROM bursts WHERE kind = 'entity') AS share
FROM bursts WHERE kind = 'entity' GROUP BY 1""")
def burst_weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _bursts(_articles(spark, sf_dir)).where("kind = 'entity'")
    counts = found.groupBy(F.date_format("peak_date", "EEEE").alias("weekday")).agg(F.count("*").alias("bursts"))
    total = F.sum("bursts").over(S.Window.rowsBetween(S.Window.unboundedPreceding, S.Window.unboundedFollowing))
    return counts.select("weekday", "bursts", S.ratio(F.col("bursts"), total).alias("share"))


KNOWN = "(1, DATE '2024-01-05', DATE '2024-01-06', 'early', 'k1;k2'), (2, DATE '2024-01-05', DATE '2024-01-20', 'middle', 'K5;k7'), (3, DATE '2024-01-18', DATE '2024-01-29', 'late', 'k')"
MATCHED = f"""{STATES}, known AS (SELECT * FROM (VALUES {KNOWN}) v(position, e_start, e_end, event, keys)),
top AS (
  SELECT *, row_number() OVER (ORDER BY weight DESC, key, "start") AS rank FROM (SELECT * FROM bursts WHERE kind = 'entity' ORDER BY weight DESC, key, "start" LIMIT 100)
), hits AS (
  SELECT t.rank, arg_min(k.event, k.position) AS what_it_was FROM top t JOIN known k
  ON t.peak_date BETWEEN k.e_start - 3 AND k.e_end + 3 AND len(list_filter(string_split(lower(k.keys), ';'), lambda w: contains(lower(t.key), w))) > 0 GROUP BY t.rank
), matched AS (SELECT t.*, h.what_it_was FROM top t LEFT JOIN hits h ON h.rank = t.rank)"""


def _known(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {KNOWN} AS v(position, start, end, event, keys)")


def _matched(spark: SparkSession, articles: DataFrame) -> DataFrame:
    return B.match_events(B.ranked(_bursts(articles), n=100), _known(spark))


@query(f'WITH RECURSIVE {MATCHED} SELECT rank::INTEGER AS rank, key, "start", peak_date, weight, what_it_was FROM matched')
def known_event_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, _articles(spark, sf_dir)).select("rank", "key", "start", "peak_date", "weight", "what_it_was")


@query(f"""WITH RECURSIVE {MATCHED} SELECT avg((what_it_was IS NOT NULL)::INTEGER::DOUBLE) FILTER (rank <= 20) AS precision, count(DISTINCT what_it_was) AS events_found,
count(DISTINCT what_it_was)::DOUBLE / (SELECT count(*) FROM known) AS recall, avg((z_days > 0)::INTEGER::DOUBLE) FILTER (rank <= 20) AS zscore_agreement FROM matched""")
def detection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.detection_metrics(_matched(spark, _articles(spark, sf_dir)), _known(spark))


@query(f"""WITH RECURSIVE {MATCHED}, titled AS (SELECT event_id, date, 'k' || entity_id AS key, 'event ' || event_id AS title FROM articles),
r AS (SELECT t.key, t."start", a.title, row_number() OVER (PARTITION BY t.key, t."start" ORDER BY a.event_id) AS r FROM top t JOIN titled a ON a.key = t.key AND a.date = t.peak_date)
SELECT 'entity' AS kind, key, "start", string_agg(title, ' | ' ORDER BY r) AS headlines FROM r WHERE r <= 3 GROUP BY key, "start" """)
def peak_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    keys = a.select(F.col("event_id").alias("article_id"), "date", F.lit("entity").alias("kind"), F.concat(F.lit("k"), "entity_id").alias("key"))
    titles = a.select(F.col("event_id").alias("article_id"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"))
    return B.peak_headlines(B.ranked(_bursts(a), n=100), keys, titles)


@query(f"""WITH RECURSIVE {MATCHED}, hit AS (SELECT avg((what_it_was IS NOT NULL)::INTEGER::DOUBLE) FILTER (rank <= 20) AS precision, count(DISTINCT what_it_was)::DOUBLE / (SELECT count(*) FROM known) AS recall,
  avg((z_days > 0)::INTEGER::DOUBLE) FILTER (rank <= 20) AS zscore_agreement FROM matched)
SELECT (SELECT count(*) FROM (SELECT DISTINCT kind, key FROM flagged)) AS series, (SELECT count(DISTINCT date) FROM flagged) AS days, (SELECT count(*) FROM flagged WHERE z_outlier) AS zscore_days, (SELECT count(*) FROM bursts) AS bursts,
  (SELECT count(*) FROM bursts WHERE kind = 'entity') AS bursts_entity, (SELECT count(*) FROM bursts WHERE kind = 'topic') AS bursts_topic, (SELECT count(*) FROM known) AS known_events, precision, recall, zscore_agreement FROM hit""")
def events_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, known = _articles(spark, sf_dir), _known(spark)
    flagged = settle(_flagged(articles))
    found = settle(B.bursts(flagged, s=1.5, gamma=0.5))
    metrics = B.detection_metrics(B.match_events(B.ranked(found, n=100), known), known)
    figures = flagged.agg(F.count_distinct("kind", "key").alias("series"), F.count_distinct("date").alias("days"), F.count_if("z_outlier").alias("zscore_days"))
    kinds = [F.count_if(F.col("kind") == k).alias(f"bursts_{k}") for k in ("entity", "topic")]
    for part in (found.agg(F.count("*").alias("bursts"), *kinds), known.agg(F.count("*").alias("known_events")), metrics.select("precision", "recall", "zscore_agreement")):
        figures = figures.crossJoin(F.broadcast(part))  # one row each
    return figures


@query(f"""WITH {VOLUME} SELECT (SELECT count(*) FROM volume) AS days, (SELECT count(*) FROM articles) AS articles, (SELECT count(DISTINCT story_id) FROM labelled) AS enriched_stories, (SELECT count(*) FROM days) AS story_days,
  (SELECT round(avg(articles), 6) FROM volume) AS articles_per_day_mean, (SELECT round(avg(stories), 6) FROM volume) AS stories_per_day_mean, (SELECT count(DISTINCT label) FROM labelled) AS topics, (SELECT count(DISTINCT entity_id) FROM articles) AS entities""")
def trends_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _articles(spark, sf_dir)
    volume = settle(_volume(a))
    labelled = _labelled(a)
    figures = volume.agg(F.count("*").alias("days"), F.round(F.avg("articles"), 6).alias("articles_per_day_mean"), F.round(F.avg("stories"), 6).alias("stories_per_day_mean"))
    more = [
        a.agg(F.count("*").alias("articles"), F.count_distinct("entity_id").alias("entities")),
        labelled.agg(F.count_distinct("story_id").alias("enriched_stories"), F.count_distinct("label").alias("topics")),
        S.story_days(a).agg(F.count("*").alias("story_days")),
    ]
    for part in more:
        figures = figures.crossJoin(F.broadcast(part))  # one row each
    return figures


@query("SELECT o_orderkey, o_orderdate + INTERVAL 9 HOUR - INTERVAL 3 HOUR AS with_offset, o_orderdate + INTERVAL 9 HOUR AS with_z, o_orderdate + INTERVAL 9 HOUR AS without FROM orders")
def offset_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    wall = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T09:00:00"))
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", *[S.offset_instant(F.concat(wall, F.lit(end))).cast("timestamp_ntz").alias(n) for n, end in (("with_offset", "+03:00"), ("with_z", "Z"), ("without", ""))])


@query("SELECT o_orderkey, (o_orderdate + INTERVAL 12 HOUR) AT TIME ZONE 'Europe/Berlin' AT TIME ZONE 'UTC' AS instant FROM orders")
def local_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    noon = (F.col("o_orderdate") + F.expr("INTERVAL 12 HOUR")).cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.utc_instant(noon, "Europe/Berlin").cast("timestamp_ntz").alias("instant"))
