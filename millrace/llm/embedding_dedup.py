"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors are rotated to principal axes, the largest variance first, and cut into blocks and tiles
along the leading one: blocks and tiles whose ranges on it lie further apart than a pair at the
threshold can, are never compared. A tile pair accumulates the leading dimensions of all its
products in one matrix product whose extra column is the norm of what is left, which bounds the
rest; pairs whose bound cannot reach the threshold stop there, the others go on in steps, and
what remains is decided by the cosine in double precision. In a tile pair where over an eighth of
the pairs pass the first bound, the other steps are one product over all dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.skew import join_counted
from ..session import settle
from .vectors import Forest, matrix, sound

THRESHOLD = 0.9
#: Rows of the block that a task holds, and of the tiles that it compares.
BLOCK, TILE = 8192, 1024
#: Vectors, of least hash, from which the axes are taken; any axes give the same result.
AXES_ROWS = 4096
#: Ranges of the leading axis, at most, by which vectors are dealt to blocks.
SLABS = 64
#: What a bound may be off by, as the screening product is in single precision.
SLACK = 1e-4


def principal_axes(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns, the axis of largest mean square first."""
    values, axes = np.linalg.eigh(x.T @ x)
    return axes[:, np.argsort(-values)]


def reach(threshold: float) -> float:
    """How far apart unit vectors of that cosine lie at most, on any axis."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component near 1: same cosines, and norms in range."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def steps_of(dim: int) -> list[int]:
    """Dimensions after which the bound is tried."""
    return sorted({max(1, dim // 4), max(1, dim // 2), dim})


def close_pairs(a: np.ndarray, b: np.ndarray, unit_a: np.ndarray, unit_b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with cosine >= threshold.

    ``unit_a``, ``unit_b`` are the rotated unit rows, ``a``, ``b`` the raw rows in double precision.
    """
    dim = unit_a.shape[1]
    steps = steps_of(dim)
    head = steps[0]
    rest = lambda u, k: np.sqrt(np.maximum((u[:, k:] ** 2).sum(1), 0))
    lead = lambda u: np.concatenate([u[:, :head], rest(u, head)[:, None]], 1).astype(np.float32)
    i, j = np.nonzero(lead(unit_a) @ lead(unit_b).T >= threshold - SLACK)
    if len(i) * 8 > len(a) * len(b):  # dense tile: whole products cost less than gathering
        i, j = np.nonzero(unit_a @ unit_b.T >= threshold - SLACK)
    else:
        done, total = 0, np.zeros(len(i))
        for k in steps:
            total += np.einsum("nk,nk->n", unit_a[i, done:k], unit_b[j, done:k])
            on = total + (rest(unit_a, k)[i] * rest(unit_b, k)[j] if k < dim else 0) >= threshold - SLACK
            i, j, total, done = i[on], j[on], total[on], k
    keep = np.zeros(len(i), bool)
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    for s in range(0, len(i), 1 << 16):
        p, q = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        keep[s : s + len(p)] = np.einsum("nk,nk->n", a[p], b[q]) / (na[p] * nb[q]) >= threshold
    return i[keep], j[keep]


def compare_blocks(x: np.ndarray, first: np.ndarray, second: np.ndarray, axes: np.ndarray, weight: np.ndarray, threshold: float, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows ``first`` and ``second`` of x (the same array object: within it).

    Returns for each row the weight of the rows it links with, and the least row of its component.
    """
    links, forest = np.zeros(len(x), np.int64), Forest(len(x))
    if not len(x):
        return links, forest.label
    x = scaled(x)
    unit = (x / np.sqrt((x * x).sum(1))[:, None]) @ axes
    within, far = first is second, reach(threshold)
    first = first[np.argsort(unit[first, 0], kind="stable")]
    second = first if within else second[np.argsort(unit[second, 0], kind="stable")]
    for s in range(0, len(first), tile):
        for t in range(s if within else 0, len(second), tile):
            p, q = first[s : s + tile], second[t : t + tile]
            if unit[q[0], 0] - unit[p[-1], 0] > far or unit[p[0], 0] - unit[q[-1], 0] > far:
                continue
            i, j = close_pairs(x[p], x[q], unit[p], unit[q], threshold)
            if within and s == t:
                above = i < j
                i, j = i[above], j[above]
            i, j = p[i], q[j]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            forest.link(i, j)
    return links, forest.label


def class_links(classes: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(cid, links, root) parts: per tile pair the weight a class links with, and a member of its component.

    ``classes`` has cid, weight and x (array<double>, sound, not zero), and is settled.
    """
    sizes = classes.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()  # one row per dimension
    parts = []
    for r in sizes:
        dim = r["dim"]
        rows = classes.where(F.size("x") == dim)
        sample = rows.orderBy(F.xxhash64("x"), "cid").limit(AXES_ROWS).select("x").toArrow().column("x").combine_chunks()
        sample = scaled(matrix(sample, np.float64))
        sample /= np.sqrt((sample * sample).sum(1))[:, None]
        axes = principal_axes(sample)

        def compare(batches: Iterator[pa.RecordBatch], axes: np.ndarray = axes) -> Iterator[pa.RecordBatch]:
            """Runs of one pair of blocks, in order; a run holds two blocks at most."""

            def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                whole = pa.Table.from_batches(held).combine_chunks()
                x = matrix(whole.column("x").combine_chunks(), np.float64)
                cid, weight = whole.column("cid").to_numpy(), whole.column("weight").to_numpy()
                right = whole.column("side").to_numpy() == 1
                first = np.flatnonzero(~right)
                second = np.flatnonzero(right) if right.any() else (first if whole.column("low")[0] == whole.column("high")[0] else np.zeros(0, np.int64))
                links, label = compare_blocks(x, first, second, axes, weight, threshold, tile)
                on = np.flatnonzero(links > 0)
                return pa.record_batch([pa.array(cid[on]), pa.array(links[on]), pa.array(cid[label[on]])], names=["cid", "links", "root"])

            held: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                low, high = batch.column("low").to_numpy(), batch.column("high").to_numpy()
                cuts = np.flatnonzero((np.diff(low) != 0) | (np.diff(high) != 0)) + 1
                for s, t in zip([0, *cuts], [*cuts, len(low)]):
                    part = batch.slice(s, t - s)
                    if held and (held[0].column("low")[0] != part.column("low")[0] or held[0].column("high")[0] != part.column("high")[0]):
                        yield one(held)
                        held = []
                    held.append(part)
            if held:
                yield one(held)

        # slabs along the leading axis, each cut by hash into blocks of about ``block`` rows
        cuts = np.unique(np.quantile(sample @ axes[:, 0], np.linspace(0, 1, min(SLABS, -(-r["n"] // block)) + 1)[1:-1])).tolist()
        largest = F.array_max(F.transform("x", lambda v: F.abs(v)))
        near_one = F.transform("x", lambda v: v / largest)
        norm = F.sqrt(F.aggregate(near_one, F.lit(0.0), lambda t, v: t + v * v))
        lead = F.aggregate(F.zip_with(near_one, F.lit(axes[:, 0].tolist()), lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v) / norm
        slab = F.size(F.filter(F.lit(cuts), lambda c: c < F.col("lead"))) if cuts else F.lit(0)
        rows = settle(rows.withColumn("lead", lead).withColumn("slab", slab))
        found = sorted(rows.groupBy("slab").agg(F.count("*").alias("n"), F.min("lead").alias("lo"), F.max("lead").alias("hi")).collect())  # SLABS rows at most
        blocks, start = [-(-f["n"] // block) for f in found], 0
        ranges = []
        for n in blocks:
            ranges.append((start, start + n - 1))
            start += n
        far = reach(threshold)
        near = {f["slab"]: [s for s, g in zip(ranges, found) if max(g["lo"] - f["hi"], f["lo"] - g["hi"]) <= far] for f in found}
        mine = {f["slab"]: s for f, s in zip(found, ranges)}
        both = F.create_map(*[x for k in near for x in (F.lit(k), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in near[k]]))])[F.col("slab")]
        first, last = (F.create_map(*[F.lit(x) for k in mine for x in (k, mine[k][i])])[F.col("slab")] for i in (0, 1))
        own = (first + F.pmod(F.xxhash64("cid"), last - first + 1)).cast("int")
        dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.flatten(F.transform(both, lambda s: F.sequence(s["a"], s["b"])))))
        dealt = dealt.select(
            F.least("own", "other").alias("low"),
            F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "cid",
            "weight",
            "x",
        )
        dealt = dealt.repartition("low", "high").sortWithinPartitions("low", "high")
        parts.append(dealt.mapInArrow(compare, "cid long, links long, root long"))
    if not parts:
        return classes.sparkSession.createDataFrame([], "cid long, links long, root long")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Equal vectors are compared once, as a class with the number of its rows, and count as
    linked with each other; each row of the table is a vector of its own, repeated ones too.
    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing and are their own component; vectors of different dimensions don't link. Rows with
    a null vec_id have kept null, and name a component only where no other id is in it. An
    empty table gives no rows; other columns, labels included, are not looked at.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select("vec_id", F.when(sound(F.col("embedding")), x).alias("x"))
    rows = rows.withColumn("x", F.when(F.exists("x", lambda v: v != 0), F.col("x")))
    classes = settle(rows.where("x IS NOT NULL").groupBy("x").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight")))
    classes = settle(classes.withColumn("cid", F.monotonically_increasing_id()))
    parts = settle(class_links(classes, threshold, block, tile))
    links = parts.groupBy("cid").agg(F.sum("links").alias("links"))
    groups = connected_components(parts.select(F.col("cid").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "cid")
    least = groups.join(classes.select("cid", "least"), "cid").groupBy("component").agg(F.min("least").alias("group_least"))
    of_linked = groups.join(least, "component").select("cid", "group_least")
    named = (
        classes.join(links, "cid", "left")
        .join(of_linked, "cid", "left")
        .select("x", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("group_least", "least").alias("component_id"))
    )
    linked = join_counted(rows.where("x IS NOT NULL"), settle(named), "x", "weight").select("vec_id", "n_links", "component_id")
    alone = rows.where("x IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), least AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY u
), counted AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.u = e.vec_id LEFT JOIN counted ON counted.u = e.vec_id
"""
