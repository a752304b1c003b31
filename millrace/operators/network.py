"""Co-occurrence network of entities: PMI edges, centralities, communities, monthly evolution."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .graph import connected_components
from .skew import spread


def cooccurrence(story_entities: DataFrame, min_stories: int, min_pair: int, min_pmi: float, by: list[str] | None = None) -> DataFrame:
    """(..by, a, b, n_stories, pmi) with a < b: pairs of entities in the same stories.

    pmi = log2(n_ab N / (n_a n_b)), n_a and n_b over all stories, N over stories with an entity
    that ``min_stories`` stories have. Rare entities go before pairs are formed. ``by`` (a month,
    say) computes a graph per value in the same job. Tasks get a bounded number of rows, not of
    compressed bytes, so their memory doesn't follow the input.
    """
    by = by or []
    pairs = settle(story_entities.select(*by, "story_id", "entity_id").where("entity_id IS NOT NULL").distinct())
    counts = settle(pairs.groupBy(*by, "entity_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_stories))
    few = counts.count() <= 500_000
    frequent = spread(pairs.join(F.broadcast(counts) if few else counts, [*by, "entity_id"]), pairs.count(), *by, "story_id")
    totals = frequent.select(*by, "story_id").where("story_id IS NOT NULL").distinct().groupBy(*by).agg(F.count("*").alias("total"))
    a = frequent.select(*by, "story_id", F.col("entity_id").alias("a"), F.col("n").alias("na"))
    b = frequent.select(*by, "story_id", F.col("entity_id").alias("b"), F.col("n").alias("nb"))
    both = a.join(b, [*by, "story_id"]).where("a < b").groupBy(*by, "a", "b", "na", "nb").agg(F.count("*").alias("n_stories")).where(F.col("n_stories") >= min_pair)
    both = both.join(totals, by) if by else both.crossJoin(F.broadcast(totals))  # one row without ``by``
    pmi = F.log2(F.col("n_stories").cast("double") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))
    return both.withColumn("pmi", F.round(pmi, 3)).where(F.col("pmi") >= min_pmi).select(*by, "a", "b", "n_stories", "pmi")


def both_ways(edges: DataFrame, weight: str = "pmi") -> DataFrame:
    """(node, other, w) of each edge in both directions."""
    there = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), F.col(weight).alias("w"))
    return there.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), F.col(weight).alias("w")))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, degree_centrality, strength)."""
    per = both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
    others = per.agg((F.count("*") - 1).cast("double").alias("others"))
    centrality = F.col("degree").cast("double") / F.nullif(F.col("others"), F.lit(0.0))
    return per.crossJoin(F.broadcast(others)).select("node", "degree", centrality.alias("degree_centrality"), "strength")  # one row


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 50, checkpoint_every: int = 5) -> DataFrame:
    """(node, pagerank): weighted, by power iteration; every node of an edge table has neighbours, so none dangles."""
    links = settle(both_ways(edges).withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("node"))).select("node", "other", "p"))
    nodes = settle(links.select("node").distinct())
    n = nodes.count()
    ranks = nodes.withColumn("pr", F.lit(1.0 / max(1, n)))
    for k in range(rounds):
        got = links.join(ranks, "node").groupBy("other").agg(F.sum(F.col("pr") * F.col("p")).alias("s"))
        ranks = got.select(F.col("other").alias("node"), (F.lit((1 - alpha) / max(1, n)) + F.lit(alpha) * F.col("s")).alias("pr"))
        if (k + 1) % checkpoint_every == 0:
            ranks = settle(ranks)
    return ranks.select("node", F.col("pr").alias("pagerank"))


def betweenness(edges: DataFrame, exact_up_to: int = 3000, sources: int = 1000, seed: int = 42) -> DataFrame:
    """(node, betweenness) for paths of length 1 / pmi, normalised for an undirected graph.

    Each task runs single-source passes for its share of the sources over the whole edge list,
    which is broadcast: the operator is for filtered graphs, so the list is bounded by
    ``max_edges`` (checked). Above ``exact_up_to`` nodes, ``sources`` of them, by hash, are used.
    """
    max_edges = 2_000_000
    nodes = settle(both_ways(edges).select("node").distinct())
    n, m = nodes.count(), edges.count()
    if m > max_edges:
        raise ValueError(f"betweenness takes at most {max_edges} edges, not {m}: filter the graph first")
    graph: dict = defaultdict(list)
    for r in edges.select("a", "b", "pmi").collect():
        graph[r["a"]].append((r["b"], 1.0 / r["pmi"]))
        graph[r["b"]].append((r["a"], 1.0 / r["pmi"]))
    shared = edges.sparkSession.sparkContext.broadcast(dict(graph))
    picked = nodes if n <= exact_up_to else nodes.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(sources)
    used = n if n <= exact_up_to else sources

    def passes(batches):
        adjacency = shared.value
        total: dict = defaultdict(float)
        for pdf in batches:
            for source in pdf["node"]:
                dist, done, paths, preds, order = {source: 0.0}, set(), defaultdict(float, {source: 1.0}), defaultdict(list), []
                heap = [(0.0, 0, source)]
                tick = 0
                while heap:
                    d, _, u = heapq.heappop(heap)
                    if u in done:
                        continue
                    done.add(u)
                    order.append(u)
                    for v, w in adjacency[u]:
                        nd = d + w
                        if v in done:
                            continue
                        if v not in dist or nd < dist[v] - 1e-12:
                            dist[v], preds[v], paths[v] = nd, [u], paths[u]
                            tick += 1
                            heapq.heappush(heap, (nd, tick, v))
                        elif abs(nd - dist[v]) <= 1e-12:
                            preds[v].append(u)
                            paths[v] += paths[u]
                share: dict = defaultdict(float)
                for v in reversed(order):
                    for u in preds[v]:
                        share[u] += paths[u] / paths[v] * (1 + share[v])
                    if v != source:
                        total[v] += share[v]
        yield pd.DataFrame({"node": list(total), "part": list(total.values())})

    kind = dict(edges.dtypes)["a"]
    parts = picked.repartition(max(1, min(used // 16, 512))).mapInPandas(passes, f"node {kind}, part double")
    scale = n / max(1, used) / max(1.0, (n - 1) * (n - 2))
    summed = parts.groupBy("node").agg((F.sum("part") * F.lit(scale)).alias("betweenness"))
    return nodes.join(summed, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _louvain(adjacency: dict, seed: int) -> dict:
    """Local moves and contraction until modularity stops growing; ties to the smaller community."""
    rng = random.Random(seed)
    weight = {u: dict(vs) for u, vs in adjacency.items()}
    member = {u: u for u in weight}
    m2 = sum(sum(vs.values()) for vs in weight.values())
    while m2 > 0:
        degree = {u: sum(vs.values()) for u, vs in weight.items()}
        own, volume = {u: u for u in weight}, dict(degree)
        order = sorted(weight)
        rng.shuffle(order)
        moved = improved = True
        any_move = False
        while improved:
            improved = False
            for u in order:
                gain: dict = defaultdict(float)
                for v, w in weight[u].items():
                    if v != u:
                        gain[own[v]] += w
                volume[own[u]] -= degree[u]
                best, best_gain = own[u], gain.get(own[u], 0.0) - degree[u] * volume[own[u]] / m2
                for c in sorted(gain):
                    g = gain[c] - degree[u] * volume[c] / m2
                    if g > best_gain + 1e-12:
                        best, best_gain = c, g
                if best != own[u]:
                    own[u], improved, any_move = best, True, True
                volume[own[u]] += degree[u]
        if not any_move:
            break
        member = {u: own[c] for u, c in member.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for u, vs in weight.items():
            for v, w in vs.items():
                merged[own[u]][own[v]] += w
        weight = {u: dict(vs) for u, vs in merged.items()}
    return member


def louvain(edges: DataFrame, seed: int = 42, max_edges: int = 2_000_000) -> DataFrame:
    """(node, community): Louvain communities by pmi, numbered by size, the largest 0.

    Connected components are independent under Louvain's moves only up to the resolution
    term, so the whole filtered graph goes to one task; its size is checked against ``max_edges``.
    """
    m = edges.count()
    if m > max_edges:
        raise ValueError(f"louvain takes at most {max_edges} edges, not {m}: filter the graph first")
    kind = dict(edges.dtypes)["a"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict = defaultdict(dict)
        for a, b, w in pdf.sort_values(["a", "b"])[["a", "b", "pmi"]].itertuples(index=False):
            adjacency[a][b] = adjacency[b][a] = w
        member = _louvain(adjacency, seed)
        groups = defaultdict(list)
        for u, c in member.items():
            groups[c].append(u)
        ordered = sorted(groups.values(), key=lambda g: (-len(g), min(g)))
        return pd.DataFrame([(u, k) for k, g in enumerate(ordered) for u in sorted(g)], columns=["node", "community"])

    return edges.select(F.lit("all").alias("graph"), "a", "b", "pmi").groupBy("graph").applyInPandas(run, f"node {kind}, community long")


def modularity(edges: DataFrame, membership: DataFrame, weight: str = "pmi") -> DataFrame:
    """One row: weighted modularity of a partition (node, community) at resolution 1."""
    ca = membership.select(F.col("node").alias("a"), F.col("community").alias("ca"))
    cb = membership.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    placed = edges.join(ca, "a").join(cb, "b").select("ca", "cb", F.col(weight).alias("w"))
    ends = placed.select(F.explode(F.array("ca", "cb")).alias("c"), "w", (F.col("ca") == F.col("cb")).alias("inside"))
    per = ends.groupBy("c").agg(F.sum("w").alias("degree"), (F.sum(F.when(F.col("inside"), F.col("w")).otherwise(0.0)) / 2).alias("inner"))
    total = edges.agg(F.sum(weight).alias("m"))
    part = F.col("inner") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))
    return per.crossJoin(F.broadcast(total)).agg(F.sum(part).alias("modularity"))  # one row


def neighbour_communities(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(node, n_neighbor_communities): other communities among a node's neighbours."""
    mine = membership.select("node", F.col("community").alias("own"))
    theirs = membership.select(F.col("node").alias("other"), F.col("community").alias("c"))
    near = both_ways(edges).join(mine, "node").join(theirs, "other")
    return near.groupBy("node").agg(F.count_distinct(F.when(F.col("c") != F.col("own"), F.col("c"))).alias("n_neighbor_communities"))


def shape(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, share of the largest component."""
    parts = connected_components(edges, "a", "b")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))
    figures = sizes.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.max("size").alias("largest"))
    both = figures.crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    n = F.col("nodes").cast("double")
    return both.select("nodes", "edges", (2 * F.col("edges") / F.nullif(n * (n - 1), F.lit(0.0))).alias("density"), "components", (F.col("largest") / n).alias("largest_component_share"))


def main_topic(story_entities: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """(entity_id, topic, topic_share): the most frequent topic of an entity's stories, ties to the smaller name.

    Without ``topics`` the rows of ``story_entities`` carry the topic of their story, and repeated ones count once.
    """
    if topics is None:
        part = story_entities.select("story_id", "entity_id", "topic").where("story_id IS NOT NULL AND topic IS NOT NULL").distinct()
    else:
        part = story_entities.select("story_id", "entity_id").join(topics.select("story_id", "topic").where("topic IS NOT NULL"), "story_id")
    counts = part.groupBy("entity_id", "topic").agg(F.count("*").alias("n"))
    return dominant(counts, "entity_id", "topic").select("entity_id", "topic", F.col("share").alias("topic_share"))


def dominant(counts: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n, share) of the label of most rows per key; ``counts`` has key, label, n."""
    w = Window.partitionBy(key)
    share = F.col("n").cast("double") / F.sum("n").over(w).cast("double")
    return counts.withColumn("share", share).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), label))).where("r = 1").drop("r")


def describe_communities(nodes: DataFrame, top: int = 10) -> DataFrame:
    """(community, size, top_entities, types, main_topic, main_topic_share, pagerank_sum) of ``nodes``
    (node, canonical, type, topic, community, pagerank)."""
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("pagerank"), "canonical"))
    names = nodes.withColumn("r", rank).where(F.col("r") <= top).groupBy("community")
    names = names.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "canonical"))), lambda x: x["canonical"]), ", ").alias("top_entities"))
    kinds = nodes.groupBy("community", "type").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("community")))
    kinds = kinds.withColumn("r", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "type"))).where("r <= 3")
    percent = F.concat("type", F.lit(" "), F.round(F.col("n").cast("double") * 100 / F.col("all")).cast("int").cast("string"), F.lit("%"))
    kinds = kinds.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", percent.alias("p")))), lambda x: x["p"]), ", ").alias("types"))
    topics = dominant(nodes.where("topic IS NOT NULL").groupBy("community", "topic").agg(F.count("*").alias("n")), "community", "topic")
    sums = nodes.groupBy("community").agg(F.count("*").alias("size"), F.sum("pagerank").alias("pagerank_sum"))
    out = sums.join(names, "community").join(kinds, "community").join(topics.select("community", F.col("topic").alias("main_topic"), F.col("share").alias("main_topic_share")), "community", "left")
    return out.select("community", "size", "top_entities", "types", "main_topic", "main_topic_share", "pagerank_sum")


def strong_edges(edges: DataFrame, quantile: float = 0.9, n: int = 20) -> DataFrame:
    """The n edges of largest pmi among those whose story count reaches the quantile; ties by ends."""
    bar = edges.agg(F.percentile("n_stories", F.lit(quantile)).alias("bar"))
    return edges.crossJoin(F.broadcast(bar)).where("n_stories >= bar").drop("bar").orderBy(F.desc("pmi"), "a", "b").limit(n)  # one row


def monthly_edges(story_entities: DataFrame, min_stories: int, min_pair: int, min_pmi: float, strong: int = 5) -> DataFrame:
    """(month, a, b, n_stories, pmi, is_new, is_strong): graphs of all months in one job.

    An edge is new in the first month that has it, unless that is the first month of all.
    """
    edges = cooccurrence(story_entities.where("month IS NOT NULL"), min_stories, min_pair, min_pmi, by=["month"])
    start = story_entities.agg(F.min("month").alias("start"))
    first = F.min("month").over(Window.partitionBy("a", "b"))
    fresh = (F.col("month") == first) & (F.col("month") > F.col("start"))
    out = edges.crossJoin(F.broadcast(start)).withColumn("is_new", fresh)  # one row
    return out.select("month", "a", "b", "n_stories", "pmi", "is_new", (F.col("is_new") & (F.col("n_stories") >= strong)).alias("is_strong"))


def monthly_stats(story_entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(month, stories, nodes, edges, density, new_edges, new_strong_edges); months without edges have zeros."""
    stories = story_entities.where("month IS NOT NULL").groupBy("month").agg(F.count_distinct("story_id").alias("stories"))
    nodes = edges.select("month", F.explode(F.array("a", "b")).alias("x")).groupBy("month").agg(F.count_distinct("x").alias("nodes"))
    counts = edges.groupBy("month").agg(F.count("*").alias("edges"), F.count_if("is_new").alias("new_edges"), F.count_if("is_strong").alias("new_strong_edges"))
    out = stories.join(nodes, "month", "left").join(counts, "month", "left").fillna(0, ["nodes", "edges", "new_edges", "new_strong_edges"])
    n = F.col("nodes").cast("double")
    density = F.coalesce(2 * F.col("edges") / F.nullif(n * (n - 1), F.lit(0.0)), F.lit(0.0))
    return out.select("month", "stories", "nodes", "edges", density.alias("density"), "new_edges", "new_strong_edges")


def monthly_shapes(edges: DataFrame) -> DataFrame:
    """(month, components, largest_component_share): all months' graphs are one graph whose nodes carry their month."""
    name = lambda c: F.concat_ws("\x00", "month", F.col(c).cast("string")).alias(c)
    parts = connected_components(settle(edges.select(name("a"), name("b"))), "a", "b")  # its edges are read twice
    sizes = parts.groupBy(F.substring_index("component", "\x00", 1).alias("month"), "component").agg(F.count("*").alias("size"))
    share = F.max("size").cast("double") / F.sum("size").cast("double")
    return sizes.groupBy("month").agg(F.count("*").alias("components"), share.alias("largest_component_share"))


def monthly_pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 50, top: int = 10) -> DataFrame:
    """(month, rank, node, pagerank) of the ``top`` nodes of each month, all months iterated together."""
    there = edges.select("month", F.col("a").alias("node"), F.col("b").alias("other"), F.col("pmi").alias("w"))
    both = there.unionByName(edges.select("month", F.col("b").alias("node"), F.col("a").alias("other"), F.col("pmi").alias("w")))
    links = settle(both.withColumn("p", F.col("w") / F.sum("w").over(Window.partitionBy("month", "node"))).select("month", "node", "other", "p"))
    sizes = links.groupBy("month").agg(F.count_distinct("node").cast("double").alias("n"))
    ranks = links.select("month", "node").distinct().join(sizes, "month").withColumn("pr", F.lit(1.0) / F.col("n"))
    for k in range(rounds):
        got = links.join(ranks, ["month", "node"]).groupBy("month", "other", "n").agg(F.sum(F.col("pr") * F.col("p")).alias("s"))
        ranks = got.select("month", F.col("other").alias("node"), "n", (F.lit(1 - alpha) / F.col("n") + F.lit(alpha) * F.col("s")).alias("pr"))
        if (k + 1) % 5 == 0:
            ranks = settle(ranks)
    rank = F.row_number().over(Window.partitionBy("month").orderBy(F.round("pr", 9).desc(), "node"))
    return ranks.withColumn("rank", rank).where(F.col("rank") <= top).select("month", "rank", "node", F.col("pr").alias("pagerank"))


def monthly_communities(edges: DataFrame, seed: int = 42, max_edges: int = 2_000_000) -> DataFrame:
    """(month, communities, modularity): Louvain on each month's graph, one task a month of at most ``max_edges`` edges (checked)."""
    largest = edges.groupBy("month").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > max_edges:
        raise ValueError(f"louvain takes at most {max_edges} edges a month, not {largest}: filter the graphs first")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacency: dict = defaultdict(dict)
        for a, b, w in pdf.sort_values(["a", "b"])[["a", "b", "pmi"]].itertuples(index=False):
            adjacency[a][b] = adjacency[b][a] = w
        member = _louvain(adjacency, seed)
        m2 = sum(sum(v.values()) for v in adjacency.values())
        inner, degree = defaultdict(float), defaultdict(float)
        for u, near in adjacency.items():
            for v, w in near.items():
                degree[member[u]] += w
                inner[member[u]] += w if member[u] == member[v] else 0.0
        q = sum(inner[c] / m2 - (degree[c] / m2) ** 2 for c in degree)
        return pd.DataFrame({"month": [pdf["month"].iloc[0]], "communities": [len(degree)], "modularity": [q]})

    return edges.select("month", "a", "b", "pmi").groupBy("month").applyInPandas(run, "month string, communities long, modularity double")


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, nmi (arithmetic mean) and ari of two labellings of the same rows."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cells.agg(F.sum("n").alias("t"))
    choose = lambda c: c * (c - 1) / 2
    joint = cells.join(rows, "a").join(cols, "b").crossJoin(F.broadcast(total))  # one row
    mutual = joint.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("i"), F.sum(choose(F.col("n"))).alias("sij"))
    side = lambda d, c, h, s: d.crossJoin(F.broadcast(total)).agg((-F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))).alias(h), F.sum(choose(F.col(c))).alias(s))
    out = mutual.crossJoin(F.broadcast(side(rows, "na", "ha", "sa"))).crossJoin(F.broadcast(side(cols, "nb", "hb", "sb"))).crossJoin(F.broadcast(total))
    expected = F.col("sa") * F.col("sb") / F.nullif(choose(F.col("t")), F.lit(0.0))
    ari = (F.col("sij") - expected) / F.nullif((F.col("sa") + F.col("sb")) / 2 - expected, F.lit(0.0))
    nmi = F.col("i") / F.nullif((F.col("ha") + F.col("hb")) / 2, F.lit(0.0))
    return out.select(F.col("t").cast("long").alias("n"), F.coalesce(nmi, F.lit(1.0)).alias("nmi"), F.coalesce(ari, F.lit(1.0)).alias("ari"))
