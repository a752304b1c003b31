"""Queries over model output, made up from table columns, and topic queries over ``documents`` by language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import enrichment as E
from ..operators import topics as T
from ..session import settle, table
from ..sources import runs as U
from .base import query
from .corpus import WORDED

def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer to each order, with faults that follow from its columns; the SQL says which."""
    key, n = F.col("o_orderkey"), (F.col("o_orderkey") % 25).cast("int")
    entity = lambda i: F.struct(
        F.concat(F.lit("n"), i.cast("string")).alias("name"),
        F.when(key % 13 == 0, F.lit("ANIMAL")).otherwise(F.element_at(F.array(*map(F.lit, E.ENTITY_TYPES)), i % 6 + 1)).alias("type"),
        F.when(key % 17 != 0, F.element_at(F.array(*map(F.lit, E.ROLES)), i % 3 + 1)).alias("role"),
        F.element_at(F.array(*map(F.lit, E.SENTIMENTS)), i % 4 + 1).alias("sentiment"),
        F.lit("id").alias("normalized_id"),
    )
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    answer = F.struct(
        F.repeat(F.lit("s"), (key % 500).cast("int")).alias("summary"),
        F.transform(numbers, entity).alias("entities"),
        F.when(key % 19 == 0, F.lit("погода")).otherwise(F.element_at(F.array(*map(F.lit, E.TOPICS)), (key % len(E.TOPICS) + 1).cast("int"))).alias("topic"),
        F.element_at(F.array(*map(F.lit, E.EVENT_TYPES)), (key % len(E.EVENT_TYPES) + 1).cast("int")).alias("event_type"),
        F.when(key % 7 != 0, key % 2 == 0).alias("is_opinion"),
        (F.col("o_custkey") % 12 / 10.0).alias("confidence"),
        F.when(key % 23 == 0, F.lit(1)).alias("extra"),
    )
    raw = F.to_json(answer)
    return table(spark, sf_dir, "orders").select(key.alias("article_id"), F.when(key % 11 == 0, F.substring(raw, 1, 30)).otherwise(raw).alias("raw"))


@query("""SELECT o_orderkey AS article_id, o_orderkey % 500 <= 400 AND o_orderkey % 25 <= 20 AND (o_orderkey % 25 = 0 OR (o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0))
AND o_orderkey % 19 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey % 12 <= 10 AND o_orderkey % 23 <> 0 AND o_orderkey % 11 <> 0 AS ok FROM orders""")
def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir).select("article_id", E.is_valid(F.col("raw")).alias("ok"))


#: Documents with labels from table columns, as two runs of a model would give.
RUN = """SELECT o_orderkey AS article_id, o_orderkey % 50 <> 0 AS ok, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderpriority END AS topic, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderstatus END AS event_type,
  CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey % 3 = 0 END AS is_opinion, CASE WHEN o_orderkey % 50 <> 0 THEN (o_orderkey % 101) / CAST(100.0 AS DOUBLE) END AS confidence, o_orderkey % 1030 AS completion_tokens, CASE WHEN o_orderkey % 50 <> 0 THEN 'x' END AS summary,
  o_orderkey % 4 AS n_entities FROM orders"""


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    d = spark.sql(RUN.replace("FROM orders", "FROM __orders"))
    entity = lambda i: F.struct(
        F.concat(F.lit("n"), (i + F.col("article_id") % 5).cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, E.ENTITY_TYPES)), ((i + F.col("article_id")) % 6 + 1).cast("int")).alias("type"),
        F.element_at(F.array(*map(F.lit, E.ROLES)), (i % 3 + 1).cast("int")).alias("role"),
        F.element_at(F.array(*map(F.lit, E.SENTIMENTS)), ((i + F.col("article_id")) % 4 + 1).cast("int")).alias("sentiment"),
        F.lit("id").alias("normalized_id"),
    )
    numbers = F.when(F.col("n_entities") > 0, F.sequence(F.lit(1), F.col("n_entities").cast("int"))).otherwise(F.array().cast("array<int>"))
    return d.withColumn("entities", F.when(F.col("ok"), F.transform(numbers, entity)))


def _shortened(full: DataFrame) -> DataFrame:
    """A second run over the same articles that differs in some topics and loses some first entities."""
    short = full.withColumn("topic", F.when(F.col("article_id") % 9 == 0, F.lit("other")).otherwise(F.col("topic")))
    return short.withColumn("entities", F.when(F.col("article_id") % 11 == 0, F.slice("entities", F.lit(2), F.greatest(F.lit(0), F.size("entities") - 1))).otherwise(F.col("entities")))


ENTS = f"""run AS ({RUN}), ents AS (SELECT article_id, 'n' || (i + article_id % 5) AS name, (['ORG','PER','LOC','GPE','PRODUCT','EVENT'])[(i + article_id) % 6 + 1] AS type, (['actor','object','mentioned'])[i % 3 + 1] AS role,
  (['pos','neu','neg','unknown'])[(i + article_id) % 4 + 1] AS sentiment FROM (SELECT article_id, unnest(generate_series(1, n_entities)) AS i FROM run WHERE ok))"""


@query(f"""WITH {ENTS}, v AS (
  SELECT 'topic' AS field, topic AS value FROM run WHERE ok UNION ALL SELECT 'event_type', event_type FROM run WHERE ok UNION ALL SELECT 'is_opinion', is_opinion::VARCHAR FROM run WHERE ok
  UNION ALL SELECT 'entity_type', type FROM ents UNION ALL SELECT 'entity_role', role FROM ents UNION ALL SELECT 'entity_sentiment', sentiment FROM ents)
SELECT field, value, count(*) AS count, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY field)::DOUBLE AS share FROM v GROUP BY 1, 2""")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.distribution(_run(spark, sf_dir).where("ok"))


@query(f"""WITH run AS ({RUN}), b AS (SELECT greatest(ceil(round(confidence * 10, 6)) - 1, 0)::INTEGER AS bin, count(*) AS c FROM run WHERE ok GROUP BY 1)
SELECT s.bin::INTEGER AS bin, coalesce(c, 0) AS count, coalesce(c, 0)::DOUBLE / (SELECT count(*) FROM run WHERE ok) AS share FROM (SELECT unnest(generate_series(0, 9)) AS bin) s LEFT JOIN b USING (bin)""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confidence_histogram(_run(spark, sf_dir).where("ok"))


@query(f"""WITH run AS ({RUN}) SELECT count(*) AS documents, count(*) FILTER (ok)::DOUBLE / count(*) AS valid_share, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (completion_tokens >= 1024)::DOUBLE / count(*) AS truncated_share,
count(*) FILTER (ok AND n_entities = 0)::DOUBLE / count(*) FILTER (ok) AS empty_entities_share, sum(n_entities) FILTER (ok)::DOUBLE / count(*) FILTER (ok) AS entities_per_doc, round(avg(confidence) FILTER (ok), 9) AS confidence_mean FROM run""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.run_summary(_run(spark, sf_dir)).withColumn("confidence_mean", F.round("confidence_mean", 9))


@query(f"""WITH run AS ({RUN}), c AS (SELECT topic, count(*) AS n FROM run WHERE topic IS NOT NULL GROUP BY 1) SELECT arg_min(topic, {{'a': -n, 'b': topic}}) AS value, max(n)::DOUBLE / sum(n)::DOUBLE AS share FROM c""")
def most_frequent_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.top_share(_run(spark, sf_dir), "topic")


@query(f"""WITH {ENTS}, j AS (SELECT article_id, topic <> CASE WHEN article_id % 9 = 0 THEN 'other' ELSE topic END AS t, n_entities, article_id % 11 = 0 AS cut FROM run WHERE ok),
k AS (SELECT *, CASE WHEN NOT cut OR n_entities = 0 THEN 1.0 ELSE (n_entities - 1)::DOUBLE / n_entities END AS jac FROM j)
SELECT count(*) AS documents, avg(t::INTEGER::DOUBLE) AS topic_changed, 0.0::DOUBLE AS event_type_changed, 0.0::DOUBLE AS is_opinion_changed, round(avg(jac), 9) AS entities_jaccard_mean, avg((jac < 1)::INTEGER::DOUBLE) AS entities_changed,
1.0::DOUBLE AS summary_len_short, 1.0::DOUBLE AS summary_len_full, avg((t OR jac < 1)::INTEGER::DOUBLE) AS any_changed FROM k""")
def run_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _run(spark, sf_dir)
    return E.run_difference(_shortened(full), full).withColumn("entities_jaccard_mean", F.round("entities_jaccard_mean", 9))


#: Text in which entity names are looked for.
SEEN = "n1 n2 n3 n4 n5 n6"


@query(f"""WITH {ENTS}, f AS (SELECT
  (SELECT count(*) FILTER (ok)::DOUBLE / count(*) < 1 FROM run) AS invalid_json,
  (SELECT max(n)::DOUBLE / sum(n)::DOUBLE > 0.6 FROM (SELECT count(*) AS n FROM run WHERE topic IS NOT NULL GROUP BY topic)) AS topic_degenerate,
  (SELECT max(n)::DOUBLE / sum(n)::DOUBLE > 0.6 FROM (SELECT count(*) AS n FROM run WHERE event_type IS NOT NULL GROUP BY event_type)) AS event_type_degenerate,
  (SELECT arg_min(sentiment, {{'a': -n, 'b': sentiment}}) = 'neu' AND max(n)::DOUBLE / sum(n)::DOUBLE > 0.8 FROM (SELECT sentiment, count(*) AS n FROM ents GROUP BY 1)) AS neutral_degenerate,
  (SELECT count(*) FILTER (n_entities = 0)::DOUBLE / count(*) > 0.1 FROM run WHERE ok) AS empty_entities,
  (SELECT count(*) FILTER (NOT contains('{SEEN}', name))::DOUBLE / count(*) > 0.05 FROM ents) AS unseen_entities,
  (SELECT count(*) FILTER (completion_tokens >= 1024)::DOUBLE / count(*) > 0.01 FROM run) AS truncated,
  (SELECT count(DISTINCT topic) < {len(E.TOPICS)} / 3.0 FROM run) AS few_topics,
  (SELECT avg((topic <> CASE WHEN article_id % 9 = 0 THEN 'other' ELSE topic END OR (article_id % 11 = 0 AND n_entities > 0))::INTEGER::DOUBLE) > 0.25 FROM run WHERE ok) AS truncation_matters)
SELECT flag FROM (UNPIVOT f ON COLUMNS(*) INTO NAME flag VALUE raised) WHERE raised""")
def run_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = _run(spark, sf_dir)
    names = full.where("ok").select(F.explode("entities").alias("e"))
    unseen = names.agg(F.avg((~X.seen_in_text(F.col("e.name"), F.lit(SEEN))).cast("double")).alias("unseen_share"))
    parts = [
        E.run_summary(full).select("valid_share", "truncated_share", F.col("empty_entities_share").alias("empty_share")),
        E.top_share(full, "topic").select(F.col("share").alias("topic_share")),
        E.top_share(full, "event_type").select(F.col("share").alias("event_share")),
        E.top_share(names.select("e.sentiment"), "sentiment").select(F.col("value").alias("sentiment_top"), F.col("share").alias("sentiment_share")),
        full.agg(F.count_distinct("topic").alias("topics_used"), F.lit(len(E.TOPICS)).alias("topics_known")),
        unseen,
        E.run_difference(_shortened(full), full).select("any_changed"),
    ]
    figures = parts[0]
    for part in parts[1:]:
        figures = figures.crossJoin(F.broadcast(part))  # one row each
    return E.flags(figures)


@query(r"""WITH n AS (SELECT doc_id, trim(replace(lower(substr(text, 150, 30)), 'ё', 'е')) AS n, replace(lower(substr(text, 1, 170)), 'ё', 'е') AS hay FROM documents),
s AS (SELECT *, list_transform(regexp_extract_all(n, '[\p{L}\p{M}\p{Nd}\p{Pc}]{4,}'), lambda w: substr(w, 1, 5)) AS stems FROM n)
SELECT doc_id, coalesce(n <> '' AND (contains(hay, n) OR (len(stems) > 0 AND len(list_filter(stems, lambda w: NOT contains(hay, w))) = 0)), false) AS seen FROM s""")
def names_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.seen_in_text(F.substring("text", 150, 30), X.fold_yo(F.substring("text", 1, 170))).alias("seen"))


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 5000)::BIGINT AS shard_id FROM orders")
def shard_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shard_ids(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey AS article_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("article_id"))
    return E.todo(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id")), done)


@query("SELECT shard_id, count(*) AS rows FROM (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 AS shard_id, o_orderkey FROM orders) WHERE o_orderkey % 1000 <> 7 GROUP BY 1 HAVING count(*) = 700 OR (shard_id = (SELECT (count(*) - 1) // 700 FROM orders) AND count(*) = (SELECT (count(*) - 1) % 700 + 1 FROM orders))")
def closed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    done = E.shard_ids(orders, ["o_orderkey"], 700).where("o_orderkey % 1000 <> 7")
    return U.closed_shards(done, orders.count(), 700)


@query(f"WITH run AS ({RUN}) SELECT count(*) AS total, count(*) FILTER (ok) AS done, count(*) FILTER (NOT ok) AS \"left\", count(*) FILTER (NOT ok) AS failed, round(100.0::DOUBLE * count(*) FILTER (ok) / count(*), 2) AS percent, count(*) FILTER (ok) - 10 AS done_this_run, round((count(*) FILTER (ok) - 10) / 60.0::DOUBLE, 2) AS docs_per_sec, round(count(*) FILTER (NOT ok) / ((count(*) FILTER (ok) - 10) / 60.0::DOUBLE) / 60, 1) AS eta_minutes FROM run")
def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _run(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("failed"))
    return U.progress(counts, 10, 60.0)


@query(f"WITH run AS ({RUN}) SELECT count(*) AS documents, 1.5::DOUBLE AS gpu_hours, round(3.0::DOUBLE / count(*), 6) AS cost_per_document FROM run")
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.cost(E.run_summary(_run(spark, sf_dir)), 90.0, 2.0).select("documents", "gpu_hours", "cost_per_document")


CTF = f"""{WORDED}, tok AS (SELECT lang AS topic, unnest(ws) AS word FROM worded JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)), c AS (SELECT topic, word, count(*) AS n FROM tok GROUP BY 1, 2),
tt AS (SELECT topic, sum(n) AS topic_n FROM c GROUP BY 1), wt AS (SELECT word, sum(n) AS word_n FROM c GROUP BY 1),
w AS (SELECT topic, word, n, sqrt(n::DOUBLE / topic_n::DOUBLE) * ln(1 + (SELECT avg(topic_n) FROM tt) / word_n::DOUBLE) AS weight FROM c JOIN tt USING (topic) JOIN wt USING (word)),
top AS (SELECT topic, rank, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, word) AS rank FROM w) WHERE rank <= 10)"""


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # explode() would have the words made again for a filter on their number
    return T.term_weights(d.select(F.col("lang").alias("topic"), F.explode_outer(X.words(F.col("text"))).alias("word")).where("word IS NOT NULL"))


@query(f"WITH {CTF} SELECT topic, word, n, round(weight, 9) AS weight FROM w")
def term_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(f"WITH {CTF} SELECT topic, rank::INTEGER AS rank, word, round(weight, 9) AS weight FROM top")
def topic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.top_words(_weights(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


@query(f"""WITH {CTF}, heavy AS (SELECT topic, word, weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS r FROM w) WHERE r <= 200),
norms AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM heavy GROUP BY 1),
dots AS (SELECT a.topic AS ta, b.topic AS tb, sum(a.weight * b.weight) AS d FROM heavy a JOIN heavy b ON a.word = b.word AND a.topic < b.topic GROUP BY 1, 2),
best AS (SELECT ta, tb FROM norms x JOIN norms y ON x.topic < y.topic LEFT JOIN dots ON ta = x.topic AND tb = y.topic, LATERAL (SELECT coalesce(d, 0) / (x.norm * y.norm) AS c) ORDER BY c DESC LIMIT 1)
SELECT n.topic, CASE WHEN n.topic = tb THEN ta ELSE n.topic END AS merged FROM norms n, best""")
def topic_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One merge: the two closest languages become one topic."""
    weights = settle(_weights(spark, sf_dir).where("topic IS NOT NULL"))
    return T.merged_topics(weights, weights.select("topic").distinct().count() - 1)


@query(f"WITH {CTF} SELECT count(DISTINCT word)::DOUBLE / count(*) AS diversity FROM top")
def topic_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.diversity(T.top_words(_weights(spark, sf_dir)))


@query("SELECT date_trunc('week', TIMESTAMP '2016-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR)::DATE AS week, lang AS topic, count(*) AS docs FROM documents GROUP BY 1, 2")
def topics_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.expr("CAST(timestampadd(HOUR, CAST(doc_id AS INT), TIMESTAMP '2016-01-01 00:00:00') AS DATE)")
    return T.topics_over_time(table(spark, sf_dir, "documents").select(date.alias("date"), F.col("lang").alias("topic")))


@query()
def topic_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(X.words(F.col("text")).alias("words"))
    return T.coherence(T.top_words(_weights(spark, sf_dir)), docs)


@query()
def vector_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cluster(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), k=10)
