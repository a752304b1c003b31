"""Stories: components of duplicate pairs, split where they grow too large, with a canonical document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import settle
from .graph import connected_components
from .order import numbered
from .skew import join_counted

#: Which level's attributes a pair has in the graph if it was found by several.
PRECEDENCE = {"exact": 0, "minhash": 1, "semantic": 2}


def graph_edges(pairs: DataFrame) -> DataFrame:
    """One edge (a, b, level, score) with a < b per pair; the highest level in PRECEDENCE wins."""
    order = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])[F.col("level")]
    ends = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "level", "score", order.alias("o"))
    return ends.groupBy("a", "b").agg(F.max_by("level", "o").alias("level"), F.max_by("score", "o").alias("score"))


def split_components(edges: DataFrame, cuttable, max_size: int, start: float, step: float, cap: float) -> DataFrame:
    """(node, component) after splitting what is larger than ``max_size``.

    Round by round the threshold grows by ``step`` and, inside components that are still too
    large, edges for which ``cuttable`` holds and whose score is below it go. ``edges`` has a,
    b, score. The rounds are (cap - start) / step at most; each checkpoints its edges, but one below
    whose threshold no edge is left that may go changes nothing and finds no components.
    """
    current = settle(edges)
    nodes = settle(current.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    labels = settle(connected_components(current, "a", "b"))
    threshold = start
    while threshold < cap:
        threshold = round(threshold + step, 4)
        goes = cuttable & (F.col("score") < threshold)
        if current.where(goes).isEmpty():
            continue
        large = labels.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") > max_size)
        if large.isEmpty():
            break
        in_large = labels.join(large, "component", "left_semi").select(F.col("node").alias("a"))
        marked = current.join(in_large.withColumn("big", F.lit(True)), "a", "left")
        current = settle(marked.where(~(F.coalesce("big", F.lit(False)) & F.coalesce(goes, F.lit(False)))).drop("big"))
        found = connected_components(current, "a", "b")
        labels = settle(nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    return labels


def split_stories(pairs: DataFrame, max_size: int = 60, start: float = 0.90, step: float = 0.01, cap: float = 0.98) -> DataFrame:
    """(node, component) of the pairs' graph; only semantic edges are ever cut."""
    return split_components(graph_edges(pairs), F.col("level") == "semantic", max_size, start, step, cap)


def story_map(articles: DataFrame, components: DataFrame, canonical: str = "earliest") -> DataFrame:
    """(row, source, dt, story_id, story_size, is_canonical): each article in one story.

    ``articles`` has row, source, dt, text_len; ``components`` node, component. Stories are
    numbered by their earliest (dt, row); a story may hold any share of the articles. The canonical article is the earliest (longer text,
    then smaller row on a tie) or the longest (earlier, then smaller row).
    """
    joined = settle(articles.join(components.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row")))
    longer = F.coalesce(-F.col("text_len"), F.lit(1)).alias("longer")  # unknown lengths come last
    order = {"earliest": F.struct("dt", longer, "row"), "longest": F.struct(longer, "dt", "row")}[canonical]
    firsts = joined.groupBy("component").agg(F.min(F.struct("dt", "row")).alias("f"), F.min(order)["row"].alias("best"), F.count("*").alias("story_size"))
    placed = numbered(firsts, [F.col("f")], "number")
    named = settle(placed.select("component", "story_size", "best", X.numbered("s", F.col("number"), 6).alias("story_id")))
    out = join_counted(joined, named, "component", "story_size")
    return out.select("row", "source", "dt", "story_id", "story_size", (F.col("row") == F.col("best")).alias("is_canonical"))


def size_distribution(stories: DataFrame) -> DataFrame:
    """(size, stories, articles, share): stories by size, the articles in them and their share of all."""
    sizes = stories.groupBy("story_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("stories"))
    articles = F.col("size") * F.col("stories")
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.select("size", "stories", articles.alias("articles"), (articles.cast("double") / F.sum(articles).over(everything).cast("double")).alias("share"))


def size_histogram(stories: DataFrame, top: int = 10) -> DataFrame:
    """(size, stories) for 1 to ``top``, larger ones counted with ``top``, empty ones as 0."""
    sizes = stories.groupBy("story_id").agg(F.least(F.count("*"), F.lit(top)).alias("size")).groupBy("size").agg(F.count("*").alias("stories"))
    spine = stories.sparkSession.range(1, top + 1).withColumnRenamed("id", "size")
    return spine.join(sizes, "size", "left").select("size", F.coalesce("stories", F.lit(0)).alias("stories"))


def compression(stories: DataFrame) -> DataFrame:
    """One row: articles, stories, singles, mean size, articles per story."""
    sizes = stories.groupBy("story_id").agg(F.count("*").alias("size"))
    return sizes.agg(
        F.sum("size").alias("articles"),
        F.count("*").alias("stories"),
        F.count_if(F.col("size") == 1).alias("singles"),
        F.max("size").alias("largest"),
        (F.sum("size").cast("double") / F.nullif(F.count("*").cast("double"), F.lit(0.0))).alias("articles_per_story"),
    )


def widest_stories(stories: DataFrame, n: int = 3) -> DataFrame:
    """The n stories of two articles or more with most sources; ties by size and id."""
    per = stories.groupBy("story_id").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("size")).where("size > 1")
    return per.orderBy(F.desc("sources"), F.desc("size"), "story_id").limit(n)
