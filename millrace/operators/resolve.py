"""Entity resolution: batches of candidate groups, prompts, checked answers with reasons for vetoes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .order import numbered
from .stories import split_components


def candidate_groups(edges: DataFrame, max_size: int = 20, start: float = 0.85, step: float = 0.02, cap: float = 0.99) -> DataFrame:
    """(form_id, group): components of candidate edges, split while too large; votes are never cut.

    What stays too large is cut into blocks of ``max_size`` in form order. A group is named by its
    least form; groups of one are left out.
    """
    pure = ~F.array_contains("channels", "llm_vote")
    parts = split_components(edges, pure, max_size, start, step, cap)
    placed = settle(numbered(parts, [F.asc("component"), F.asc("node")], "__place"))
    firsts = placed.groupBy("component").agg(F.min("__place").alias("__first"))
    blocks = placed.join(firsts, "component").withColumn("block", F.floor((F.col("__place") - F.col("__first")) / max_size))
    w = Window.partitionBy("component", "block")
    named = blocks.select(F.col("node").alias("form_id"), F.min("node").over(w).alias("group"), F.count("*").over(w).alias("size"))
    return named.where("size > 1").select("form_id", "group")


def make_batches(groups: DataFrame, size: int = 100) -> DataFrame:
    """(type, batch, group, first): groups in order, packed next-fit into batches of ``size`` forms per type.

    ``groups`` has type, group, n. Next-fit is sequential within a type: its rows stream in order
    through one task that holds a batch number and a fill, whatever their number.
    """

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, batch, fill = None, 0, 0
        for frame in frames:
            out = []
            for t, n in zip(frame["type"], frame["n"]):
                if t != kind:
                    kind, batch, fill = t, 0, 0
                if fill and fill + n > size:
                    batch, fill = batch + 1, 0
                out.append((batch, fill))
                fill += n
            numbers = pd.DataFrame(out, columns=["batch", "first"], index=frame.index)
            yield pd.DataFrame({"type": frame["type"], "batch": numbers["batch"], "group": frame["group"], "first": numbers["first"]})

    ordered = groups.select("type", F.col("group").cast("long").alias("group"), F.col("n").cast("long").alias("n")).repartition("type").sortWithinPartitions("type", "group")
    return ordered.mapInPandas(place, "type string, batch int, group long, first long")


def prompts(forms: DataFrame) -> DataFrame:
    """(batch_id, prompt): numbered lines of a batch's forms. ``forms`` has batch_id, index, alias_key, sample_title."""
    line = F.concat(F.col("index").cast("string"), F.lit(". "), "alias_key", F.when(F.col("sample_title").isNotNull(), F.concat(F.lit(" | "), "sample_title")).otherwise(F.lit("")))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("index", line.alias("l")))), lambda x: x["l"])
    return forms.groupBy("batch_id").agg(F.array_join(lines, "\n").alias("prompt"))


def _occurrences(answers: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    parsed = answers.withColumn("p", F.from_json("raw", "groups array<array<bigint>>, confidence array<double>"))
    bad = parsed.where("p IS NULL OR p.groups IS NULL").select("batch_id")
    flat = parsed.where("p.groups IS NOT NULL").select("batch_id", F.posexplode("p.groups").alias("number", "items"), F.col("p.confidence").alias("conf"))
    each = flat.select("batch_id", "number", F.get("conf", F.col("number")).alias("confidence"), F.posexplode("items").alias("pos", "index"))
    known = forms.select("batch_id", "index", "form_id", "group_of")
    return each.join(known, ["batch_id", "index"], "left"), bad


def check_answers(answers: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, vetoes) of model answers {"groups": [[index]], "confidence": [number]}.

    ``answers`` has batch_id, raw; ``forms`` batch_id, index (from 1), form_id, group_of.
    accepted: batch_id, form_id, part (which forms go together), confidence. vetoes: batch_id,
    index, form_id, reason:
    invented: no form has the index; duplicate: it stands in several groups and stays in the one of
    fewest distinct forms, the first on a tie; cross_group: a group mixes candidate groups and is
    divided by them; lost: no group has the form; invalid_json: the answer can't be read.
    """
    each, bad = _occurrences(answers, forms)
    invented = each.where("form_id IS NULL").select("batch_id", "index", F.lit(None).cast("long").alias("form_id"), F.lit("invented").alias("reason"))
    real = each.where("form_id IS NOT NULL")
    width = real.groupBy("batch_id", "number").agg(F.count_distinct("index").alias("width"))
    sized = real.join(width, ["batch_id", "number"])
    per = Window.partitionBy("batch_id", "index")
    counted = sized.withColumn("times", F.count("*").over(per)).withColumn("r", F.row_number().over(per.orderBy("width", "number", "pos")))
    owned = counted.where("r = 1")
    duplicate = owned.where("times > 1").select("batch_id", "index", "form_id", F.lit("duplicate").alias("reason"))
    mixed = owned.groupBy("batch_id", "number").agg(F.count_distinct("group_of").alias("kinds")).where("kinds > 1")
    crossed = owned.join(mixed.select("batch_id", "number"), ["batch_id", "number"], "left_semi").select("batch_id", "index", "form_id", F.lit("cross_group").alias("reason"))
    answered = answers.select("batch_id").distinct()
    rest = forms.join(answered, "batch_id", "left_semi").join(bad, "batch_id", "left_anti").join(owned.select("batch_id", "index"), ["batch_id", "index"], "left_anti")
    lost = rest.select("batch_id", "index", "form_id", F.lit("lost").alias("reason"))
    unread = bad.select("batch_id", F.lit(None).cast("long").alias("index"), F.lit(None).cast("long").alias("form_id"), F.lit("invalid_json").alias("reason"))
    vetoes = invented.unionByName(duplicate).unionByName(crossed).unionByName(lost).unionByName(unread)
    part = F.min("form_id").over(Window.partitionBy("batch_id", "number", "group_of"))
    merged = owned.select("batch_id", "form_id", part.alias("part"), "confidence")
    alone = lambda d: d.select("batch_id", "form_id", F.col("form_id").alias("part"), F.lit(None).cast("double").alias("confidence"))
    silent = forms.join(answered, "batch_id", "left_anti").unionByName(forms.join(bad, "batch_id", "left_semi"))
    return merged.unionByName(alone(rest)).unionByName(alone(silent)), vetoes


def merge_pairs(accepted: DataFrame) -> DataFrame:
    """(a, b) of all forms that were accepted together; groups are small, as answers are."""
    a = accepted.select("batch_id", "part", F.col("form_id").alias("a"))
    b = accepted.select("batch_id", "part", F.col("form_id").alias("b"))
    return a.join(b, ["batch_id", "part"]).where("a < b").select("a", "b").distinct()
