"""Model output per document: parsing, validation, distributions, run summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import numbered

# The enumerations and limits of the output contract.
TOPICS = (
    "политика",
    "экономика и бизнес",
    "общество",
    "происшествия",
    "армия и конфликты",
    "право и криминал",
    "наука и технологии",
    "медицина и здоровье",
    "культура",
    "спорт",
    "транспорт и инфраструктура",
)
EVENT_TYPES = (
    "заявление",
    "встреча и переговоры",
    "решение властей",
    "назначение или отставка",
    "сделка или инвестиция",
    "отчёт или статистика",
    "происшествие или авария",
    "преступление",
    "суд и расследование",
    "протест или акция",
    "боевые действия",
    "спортивное событие",
    "культурное событие",
    "анонс или план",
    "прочее",
)
ENTITY_TYPES = ("ORG", "PER", "LOC", "GPE", "PRODUCT", "EVENT")
ROLES = ("actor", "object", "mentioned")
SENTIMENTS = ("pos", "neu", "neg", "unknown")
MAX_NAME, MAX_SUMMARY, MAX_ENTITIES = 120, 400, 20
ENTITY = "struct<name: string, type: string, role: string, sentiment: string, normalized_id: string>"
ANSWER = f"struct<summary: string, entities: array<{ENTITY}>, topic: string, event_type: string, is_opinion: boolean, confidence: double>"
FIELDS = ("summary", "entities", "topic", "event_type", "is_opinion", "confidence")
ENTITY_FIELDS = ("name", "type", "role", "sentiment", "normalized_id")


def parsed(raw: Column) -> Column:
    return F.from_json(raw, ANSWER)


def is_valid(raw: Column, topics: tuple[str, ...] = TOPICS, event_types: tuple[str, ...] = EVENT_TYPES) -> Column:
    """Whether a raw answer meets the contract: all fields, no others, types, enumerations, lengths, ranges."""
    a = parsed(raw)
    keys = F.json_object_keys(raw)
    texts = F.from_json(raw, "struct<entities: array<string>>")["entities"]
    exact = lambda got, want: F.coalesce(F.array_sort(got) == F.array(*map(F.lit, sorted(want))), F.lit(False))
    entity = lambda e: (F.length(e["name"]) <= MAX_NAME) & e["type"].isin(*ENTITY_TYPES) & e["role"].isin(*ROLES) & e["sentiment"].isin(*SENTIMENTS) & (F.length(e["normalized_id"]) <= MAX_NAME)
    fine = (
        exact(keys, FIELDS)
        & F.coalesce(F.forall(texts, lambda t: exact(F.json_object_keys(t), ENTITY_FIELDS)), F.lit(False))
        & (F.length(a["summary"]) <= MAX_SUMMARY)
        & (F.size(a["entities"]) <= MAX_ENTITIES)
        & F.forall(a["entities"], lambda e: F.coalesce(entity(e), F.lit(False)))
        & a["topic"].isin(*topics)
        & a["event_type"].isin(*event_types)
        & a["is_opinion"].isNotNull()
        & a["confidence"].between(0.0, 1.0)
    )
    return F.coalesce(fine, F.lit(False))


def distribution(docs: DataFrame) -> DataFrame:
    """(field, value, count, share) of topic, event_type, is_opinion and the entities' type, role, sentiment."""
    plain = docs.select(F.expr("stack(3, 'topic', topic, 'event_type', event_type, 'is_opinion', CAST(is_opinion AS STRING)) AS (field, value)"))
    each = docs.select(F.explode("entities").alias("e")).select(F.expr("stack(3, 'entity_type', e.type, 'entity_role', e.role, 'entity_sentiment', e.sentiment) AS (field, value)"))
    counts = plain.unionByName(each).groupBy("field", "value").agg(F.count("*").alias("count"))
    share = F.col("count").cast("double") / F.sum("count").over(Window.partitionBy("field")).cast("double")
    return counts.select("field", "value", "count", share.alias("share"))


def confidence_histogram(docs: DataFrame, column: str = "confidence") -> DataFrame:
    """(bin, count, share) over ten right-closed bins of 0.1, the first closed on both sides, empty ones kept."""
    c = F.col(column).cast("double")
    edges = [round(0.1 * i, 1) for i in range(1, 11)]
    index = sum(((c > e).cast("int") for e in edges), F.lit(0))
    placed = docs.where(c.between(0.0, 1.0)).groupBy(index.alias("bin")).agg(F.count("*").alias("count"))
    total = docs.agg(F.count("*").alias("n"))
    spine = docs.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    out = spine.join(placed, "bin", "left").crossJoin(F.broadcast(total))  # one row
    count = F.coalesce("count", F.lit(0))
    return out.select("bin", count.alias("count"), F.coalesce(count.cast("double") / F.nullif(F.col("n").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("share"))


def run_summary(rows: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """One row: documents, share valid, failed, truncated, empty; entities per document, mean confidence."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    share = lambda a, b: (a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)))
    ok = F.col("ok")
    entities = F.when(F.col("entities").isNull(), 0).otherwise(n("entities"))
    return rows.agg(
        F.count("*").alias("documents"),
        share(F.count_if(ok), F.count("*")).alias("valid_share"),
        F.count_if(~ok).alias("failed"),
        share(F.count_if(F.col("completion_tokens") >= max_tokens), F.count("*")).alias("truncated_share"),
        share(F.count_if(ok & (entities == 0)), F.count_if(ok)).alias("empty_entities_share"),
        share(F.sum(F.when(ok, entities)), F.count_if(ok)).alias("entities_per_doc"),
        F.avg(F.when(ok, F.col("confidence"))).alias("confidence_mean"),
    )


def top_share(rows: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, ties to the smaller, and its share."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"), (F.max("n").cast("double") / F.sum("n").cast("double")).alias("share"))


def run_difference(short: DataFrame, full: DataFrame) -> DataFrame:
    """One row: how often labels and entity names differ between two runs over the same article_ids."""
    names = lambda c: F.array_distinct(F.transform(c, lambda e: F.translate(F.lower(e["name"]), "ё", "е")))
    pick = lambda d, p: d.where("ok").select("article_id", *[F.col(c).alias(f"{p}_{c}") for c in ("topic", "event_type", "is_opinion")], names("entities").alias(f"{p}_n"), F.length(F.coalesce("summary", F.lit(""))).alias(f"{p}_l"))
    both = pick(short, "s").join(pick(full, "f"), "article_id")
    union = F.size(F.array_union("s_n", "f_n"))
    j = F.coalesce(F.size(F.array_intersect("s_n", "f_n")).cast("double") / F.nullif(union.cast("double"), F.lit(0.0)), F.lit(1.0))
    both = both.withColumn("j", j)
    differs = lambda c: ~F.col(f"s_{c}").eqNullSafe(F.col(f"f_{c}"))
    mean = lambda c: F.avg(c.cast("double"))
    return both.agg(
        F.count("*").alias("documents"),
        mean(differs("topic")).alias("topic_changed"),
        mean(differs("event_type")).alias("event_type_changed"),
        mean(differs("is_opinion")).alias("is_opinion_changed"),
        mean(F.col("j")).alias("entities_jaccard_mean"),
        mean(F.col("j") < 1).alias("entities_changed"),
        mean(F.col("s_l")).alias("summary_len_short"),
        mean(F.col("f_l")).alias("summary_len_full"),
        mean(differs("topic") | differs("event_type") | (F.col("j") < 1)).alias("any_changed"),
    )


def flags(figures: DataFrame) -> DataFrame:
    """(flag) of each warning that the one-row ``figures`` raise."""
    rules = {
        "invalid_json": F.col("valid_share") < 1.0,
        "topic_degenerate": F.col("topic_share") > 0.6,
        "event_type_degenerate": F.col("event_share") > 0.6,
        "neutral_degenerate": (F.col("sentiment_top") == "neu") & (F.col("sentiment_share") > 0.8),
        "empty_entities": F.col("empty_share") > 0.1,
        "unseen_entities": F.col("unseen_share") > 0.05,
        "truncated": F.col("truncated_share") > 0.01,
        "few_topics": F.col("topics_used") < F.col("topics_known") / 3,
        "truncation_matters": F.col("any_changed") > 0.25,
    }
    raised = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return figures.select(F.explode(raised).alias("flag"))


def shard_ids(docs: DataFrame, order: list[str], size: int = 5000) -> DataFrame:
    """Adds shard_id: blocks of ``size`` rows in a total order."""
    placed = numbered(docs, [F.col(c) for c in order], "shard_id")
    return placed.withColumn("shard_id", F.floor(F.col("shard_id") / size).cast("long"))


def todo(docs: DataFrame, done: DataFrame, key: str = "article_id") -> DataFrame:
    """Rows that no earlier run has finished."""
    return docs.join(done.select(key), key, "left_anti")
