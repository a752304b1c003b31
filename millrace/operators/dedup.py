"""Exact, near and semantic duplicate pairs."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import settle
from .skew import BROADCAST_IDS, by_ids, join_counted

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of a MinHash signature and rows in each: a pair of Jaccard s meets with probability 1 - (1 - s^6)^40.
BANDS, ROWS = 40, 6


def exact_groups(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, digest, first, size) of documents that have words; ``first`` is the smallest id of equal texts.

    Null and empty texts, and texts of punctuation alone, have no words and are left out; an empty
    table gives no rows.
    """
    # the comparison key is the words joined by spaces
    digest = X.let(X.comparison_key(F.col("text")), lambda k: F.when(k != "", F.sha2(k, 256)))
    return _grouped(settle(docs.select(id_col, digest.alias("digest"))).where("digest IS NOT NULL"), id_col)


def _grouped(keyed: DataFrame, id_col: str) -> DataFrame:
    """exact_groups() of stored (id, digest)."""
    groups = keyed.groupBy("digest").agg(F.min(id_col).alias("first"), F.count("*").alias("size"))
    return join_counted(keyed, settle(groups), "digest").select(id_col, "digest", "first", "size")


def exact_pairs(docs: DataFrame, id_col: str = "doc_id", groups: DataFrame | None = None) -> DataFrame:
    """Star pairs (first, other) of equal texts: the same components as all pairs, but linear in number.

    ``groups`` is exact_groups() of the same documents, where it is at hand.
    """
    g = (exact_groups(docs, id_col) if groups is None else groups).where(F.col(id_col) != F.col("first"))
    return g.select(F.col("first").alias("a"), F.col(id_col).alias("b"), F.lit("exact").alias("level"), F.lit(1.0).alias("score"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of an Arrow list of longs; a null list is empty."""
    return column.offsets.to_numpy(), np.asarray(column.values, np.int64)


def shingle_sets(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id") -> DataFrame:
    """(id, sh, n): sorted 64-bit hashes of the distinct shingles of each distinct text's first document.

    Null texts and texts of fewer than ``k`` words have no row.
    """
    return groups_and_sets(docs, k, id_col)[1]


def groups_and_sets(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """exact_groups() and shingle_sets() of the same documents, both stored, from one reading of their texts.

    Words are hashed in Spark beside the digest, runs of them combined in Arrow batches. Copies are
    hashed like any text and left out afterwards.
    """
    # one evaluation of the key a row
    both = X.let(X.comparison_key(F.col("text")), lambda key: F.when(key != "", F.struct(F.sha2(key, 256).alias("digest"), F.transform(F.split(key, " "), lambda w: F.xxhash64(w)).alias("wh"))))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, hashes = batch.column(1).flatten()
            at, v = _lists(hashes)
            v, runs = v.view(np.uint64), max(0, len(v) - k + 1)
            s = np.zeros(runs, np.uint64)
            for i in range(k):
                s = s * np.uint64(0x9E3779B97F4A7C15) + v[i : i + runs]
            s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            s = (s ^ (s >> np.uint64(29))).view(np.int64)
            sets = [np.unique(s[at[r] : max(at[r], at[r + 1] - k + 1)]) for r in range(len(at) - 1)]
            n = np.array([len(x) for x in sets], np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), digest, lists, pa.array(n)], [id_col, "digest", "sh", "n"])

    kind = dict(docs.dtypes)[id_col]
    # as one column: a filter on it, or its fields, would have Spark take the key again
    stored = settle(docs.select(id_col, both.alias("x")).mapInArrow(combined, f"{id_col} {kind}, digest string, sh array<long>, n int"))
    groups = settle(_grouped(stored.select(id_col, "digest").where("digest IS NOT NULL"), id_col))
    copies = groups.where(F.col(id_col) != F.col("first")).select(id_col)
    firsts = by_ids(stored.where("n > 0").select(id_col, "sh", "n"), copies, id_col, keep=False)
    return groups, firsts if copies.count() <= BROADCAST_IDS else settle(firsts)


#: Cells in which shingles are counted, by the leading bits of their hashes, and how many of them are summed together.
CELL_BITS, SLAB_BITS = 22, 16


def _levels(sets: DataFrame) -> np.ndarray:
    """For each cell of shingle hashes how often its shingles occur in all sets, on a scale of quarter powers of two; 0: once at most.

    4 MB whatever the input: tasks send their counts compressed, slabs of cells are summed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            h = _lists(batch.column(0))[1].view(np.uint64) >> np.uint64(64 - CELL_BITS)
            cells += np.bincount(h.astype(np.int64), minlength=len(cells)).astype(np.uint32)
        slabs = cells.reshape(-1, 1 << SLAB_BITS)
        used = np.flatnonzero(slabs.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([zlib.compress(slabs[i].tobytes(), 1) for i in used], pa.binary())], ["slab", "counts"])

    def level(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint64) for x in pdf["counts"])
        scale = np.where(total > 1, 1 + np.floor(4 * np.log2(np.maximum(total, 1))), 0).clip(0, 255).astype(np.uint8)
        return pd.DataFrame({"slab": pdf["slab"].iloc[:1], "levels": [zlib.compress(scale.tobytes(), 1)]})

    counted = sets.select("sh").mapInArrow(count, "slab int, counts binary")
    out = np.zeros((1 << CELL_BITS - SLAB_BITS, 1 << SLAB_BITS), np.uint8)
    for r in counted.groupBy("slab").applyInPandas(level, "slab int, levels binary").collect():
        out[r["slab"]] = np.frombuffer(zlib.decompress(r["levels"]), np.uint8)
    return out.ravel()


def near_pairs(sets: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", forest: bool = False, apart: DataFrame | None = None) -> DataFrame:
    """(a, b, score): pairs of distinct texts whose shingle sets have Jaccard >= threshold; exact.

    With ``forest`` of these pairs so many that all of their components hold together, fewer than sets a cell.
    Pairs (a, b), a < b, of ``apart`` are left out before that: what they alone connect stays apart.

    Prefix filter: with all shingles in one order, two sets that similar share two of their first
    n - ceil(t n) + 2, or one where they need but one in common. Any order gives the same pairs; this one goes by the counts of cells of
    shingles over all sets, then by hash, so frequent shingles come last and hardly ever serve as a
    join key, and only prefixes, a fifth of the sets, are shuffled. A shared key also tells how much
    two sets can have in common at most; pairs that meet by chance share one, and their number grows with the square of the
    input, so they are no candidates. Near copies share nearly all of their keys: where the keys before
    are equal too the pair has met there already, under the same bounds, so it is sent once for a run of
    common keys, which counts as two if the next keys are equal. Candidates are checked on their whole sets. An empty table gives no pairs.

    ``sets`` is read several times: it should be stored, as shingle_sets() is.
    """
    levels = sets.sparkSession.sparkContext.broadcast(_levels(sets))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sh = _lists(batch.column(1))
            h = sh.view(np.uint64)
            level = levels.value[(h >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
            order = (level.astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))  # equal ones stay in the sets' own order
            chosen, rows, places, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for r in range(len(at) - 1):
                n = int(at[r + 1] - at[r])
                if n:
                    first = at[r] + np.argsort(order[at[r] : at[r + 1]], kind="stable")[: n - math.ceil(threshold * n - 1e-9) + 2]
                    place = np.flatnonzero(level[first])  # what occurs once can't be shared: it only uses up the prefix
                    chosen.append(first[place])
                    s = sh[first[place]]
                    before.append(np.append(0, s[:-1] & ~0xFFFF)[: len(s)] | np.append(s[1:] & 0x7FFF | 0x8000, 0)[: len(s)])
                    places.append(place.astype(np.int32))
                    rows.append(np.full(len(place), r))
            # p: 48 bits of the key before and 16 of the next, where 0 is none
            rows, chosen = pa.array(np.concatenate(rows)), np.concatenate(chosen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(np.concatenate(places)), pa.array(sh[chosen]), pa.array(np.concatenate(before))], [id_col, "n", "at", "s", "p"])

    kind = dict(sets.dtypes)[id_col]
    keys = sets.select(id_col, "sh", "n").mapInArrow(prefixes, f"{id_col} {kind}, n int, at int, s long, p long")
    a, b = (keys.select(F.col(id_col).alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"), F.col("p").alias(f"p{x}"), "s") for x in "ab")
    length = (F.col("nb") >= F.col("na") * F.lit(threshold)) & (F.col("na") >= F.col("nb") * F.lit(threshold))
    most = F.least("ata", "atb") + F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    enough = most >= (F.col("na") + F.col("nb")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6)
    before, following, differ = F.lit(~0xFFFF), F.lit(0xFFFF), F.col("pa").bitwiseXOR(F.col("pb"))
    new = (differ.bitwiseAND(before) != 0) | (F.col("pa").bitwiseAND(before) == 0)
    two = (differ.bitwiseAND(following) == 0) & (F.col("pa").bitwiseAND(following) != 0)
    one_is_all = F.greatest("na", "nb") * F.lit(threshold) <= F.lit(1 + 1e-9)
    met = a.join(b, "s").where((F.col("a") < F.col("b")) & new & length & enough).select("a", "b", F.when(two | one_is_all, 2).otherwise(1).alias("keys"))
    candidates = met.groupBy("a", "b").agg(F.sum("keys").alias("keys")).where("keys >= 2").select("a", "b")
    if apart is not None:
        candidates = candidates.join(apart.select("a", "b"), ["a", "b"], "left_anti")
    return _verified(candidates, sets, threshold, id_col, forest)


#: Sets of one cell, about, half of which meet the other half; values of sets that a task compares at a time.
CELL_SETS, MEET_VALUES = 512, 2_000_000
#: Sets of a task, about.
TASK_SETS = 8192


def _cells(candidates: DataFrame) -> DataFrame:
    """(cell, a, b): candidates dealt to cells of at most about CELL_SETS sets, near copies of one text together.

    A pair goes by the least candidate partner of its smaller end, so that of k texts all alike each
    is sent once and not k times; where those are many, they meet in a square of blocks.
    """
    both = candidates.select("a", "b").unionByName(candidates.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    rooted = settle(candidates.join(roots, "a").select("root", "a", "b"))
    sizes = rooted.select("root", F.explode(F.array("a", "b")).alias("x")).distinct().groupBy("root").agg(F.count("*").alias("size"))
    half = CELL_SETS // 2
    large = settle(sizes.where(F.col("size") > half).select("root", F.ceil(F.col("size") / half).alias("grid")))
    dealt = rooted.join(F.broadcast(large) if large.count() <= BROADCAST_IDS else large, "root", "left")
    block = lambda x: F.coalesce(F.pmod(F.xxhash64(x), F.col("grid")), F.lit(0))
    return dealt.select(F.xxhash64("root", block("a"), block("b")).alias("cell"), "a", "b")


def _verified(candidates: DataFrame, sets: DataFrame, threshold: float, id_col: str, forest: bool = False) -> DataFrame:
    """(a, b, score) of the candidates whose whole sets have Jaccard >= threshold; sets of no candidate stay where they are.

    Sets move once for each of their cells, not for each of their pairs. With ``forest`` pairs that
    are connected within their cell already are neither compared nor returned.
    """
    placed = settle(_cells(settle(candidates)))
    needed = settle(placed.select("cell", F.explode(F.array("a", "b")).alias(id_col)).distinct())
    count = needed.count()
    moved = sets.select(id_col, "sh").join(F.broadcast(needed) if count <= BROADCAST_IDS else needed, id_col)
    kind = dict(sets.dtypes)[id_col]
    rows = moved.select("cell", F.col(id_col).alias("a"), F.lit(None).cast(kind).alias("b"), "sh")
    rows = rows.unionByName(placed.withColumn("sh", F.lit(None).cast("array<bigint>")))
    tasks, most = max(sets.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_SETS)), MEET_VALUES

    def scored(rows: pa.Table) -> pa.RecordBatch:
        """The similar ones of the pairs in ``rows``, which has all sets of its cells."""
        alone = pc.is_null(rows["b"])
        held, asked = rows.filter(alone), rows.filter(pc.invert(alone))
        ids, lists = held["a"].combine_chunks(), held["sh"].combine_chunks()
        flat, n = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.append(0, np.cumsum(n))
        values, codes = np.unique(flat, return_inverse=True)
        left, right = (pc.index_in(asked[x], value_set=ids).to_numpy().astype(np.int64) for x in "ab")
        order = np.argsort(left, kind="stable")
        common, here, tree = np.zeros(len(order), np.int64), np.zeros(len(values), bool), np.arange(len(n))
        bounds = np.flatnonzero(np.diff(left[order], prepend=-1, append=-1))
        for low, high in zip(bounds[:-1], bounds[1:]):
            one, asks = left[order[low]], order[low:high]
            if forest:
                asks = asks[tree[right[asks]] != tree[one]]
            mine, theirs = codes[at[one] : at[one + 1]], right[asks]
            here[mine] = True
            met = np.array([np.count_nonzero(here[codes[at[r] : at[r + 1]]]) for r in theirs], np.int64)
            here[mine] = False
            if forest:  # of those of one tree the first that is similar
                similar = np.flatnonzero(met / np.maximum(1, n[one] + n[theirs] - met) >= threshold)
                trees, first = np.unique(tree[theirs[similar]], return_index=True)
                asks, met = asks[similar[first]], met[similar[first]]
                tree[np.isin(tree, trees)] = tree[one]
            common[asks] = met
        score = common / np.maximum(1, n[left] + n[right] - common)
        similar = pa.array(np.flatnonzero(score >= threshold))
        a, b = (asked[x].combine_chunks().take(similar) for x in "ab")
        return pa.RecordBatch.from_arrays([a, b, pa.array(score).take(similar)], ["a", "b", "score"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            size += len(batch.column(3).values)
            cells = batch.column(0).to_numpy()
            last = int(np.searchsorted(cells, cells[-1]))
            if size < most or not (last or len(waiting) > 1):
                continue
            if not last and len(waiting) > 1 and waiting[-2].column(0)[-1].as_py() == cells[0]:
                continue  # one cell so far, or its end is not in sight
            yield scored(pa.Table.from_batches([*waiting[:-1], batch.slice(0, last)]))
            waiting = [batch.slice(last)]
            size = len(waiting[0].column(3).flatten())
        if waiting:
            yield scored(pa.Table.from_batches(waiting))

    return rows.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(compared, f"a {kind}, b {kind}, score double")


def minhash_bands(sets: DataFrame, bands: int = BANDS, rows: int = ROWS, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(id, band, key): MinHash signatures in bands, computed on stretches of many sets at a time, in 32 bits."""
    rng = np.random.default_rng(seed)
    mul = rng.integers(1, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sh = _lists(batch.column(1))
            filled = np.flatnonzero(np.diff(at) > 0)
            h = ((sh.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
            low = 0
            while low < len(filled):
                start = int(at[filled[low]])
                high = max(low + 1, int(np.searchsorted(at[filled + 1], start + 16_384, "right")))
                part, firsts = h[start : at[filled[high - 1] + 1]], at[filled[low:high]] - start
                signature = np.array([np.minimum.reduceat(part * m + c, firsts) for m, c in zip(mul, add)], np.uint64)
                mixed = np.zeros((bands, high - low), np.uint64)
                for i in range(rows):
                    mixed = (mixed ^ signature[i::rows]) * np.uint64(0x9E3779B97F4A7C15)
                ids = batch.column(0).take(pa.array(np.tile(filled[low:high], bands)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.repeat(np.arange(bands, dtype=np.int32), high - low)), pa.array(mixed.ravel().view(np.int64))], [id_col, "band", "key"])
                low = high

    kind = dict(sets.dtypes)[id_col]
    return sets.select(id_col, "sh").mapInArrow(banded, f"{id_col} {kind}, band int, key long")


def lsh_pairs(sets: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id") -> DataFrame:
    """Candidate pairs of equal band keys, verified by their Jaccard similarity.

    A pair of Jaccard 0.8 is missed with a probability of about 5e-6, a more similar one more rarely;
    ``near_pairs`` misses none.
    """
    keyed = settle(minhash_bands(sets, bands, rows, id_col=id_col))
    a, b = keyed.withColumnRenamed(id_col, "a"), keyed.withColumnRenamed(id_col, "b")
    candidates = a.join(b, ["band", "key"]).where("a < b").select("a", "b").distinct()
    return _verified(candidates, sets, threshold, id_col)


def unit(v):
    """The vector over its norm, a zero vector unchanged, in double precision."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(wide, lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def band_pairs(rows: DataFrame, threshold: float = 0.9, days: int = 3, block: int = 2048) -> DataFrame:
    """(a, b, score): rows (id, ts, v) at most ``days`` apart with dot product >= threshold; a is the earlier, by id on a tie.

    Interval join by buckets of ``days``: rows within reach lie in one bucket or in two next to
    each other. Buckets are cut by hash into blocks of about ``block`` rows, and each pair of blocks
    is one matrix product, so a busy bucket is many tasks of two blocks. Rows without id or ts,
    and vectors that are null or empty or hold a null or NaN, have no pairs, nor have vectors of
    different length; an empty table gives none.
    """
    seconds = days * 86_400
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    timed = rows.where(F.col("id").isNotNull() & F.col("ts").isNotNull() & (F.size("v") > 0) & fine)
    timed = timed.select("id", at.alias("t"), "v", F.size("v").alias("dim")).withColumn("bucket", F.floor(F.col("t") / seconds))
    sizes = settle(timed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    placed = timed.join(sizes, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def met(other: str, side: int, step: int) -> DataFrame:
        """Rows beside each block of their own bucket or the one ``step`` further; pairs are keyed by the earlier block."""
        there = sizes.select("dim", (F.col("bucket") - step).alias("bucket"), "parts")
        each = placed.join(there, ["dim", "bucket"]).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        p, q = ("part", other) if side == 0 else (other, "part")
        early = F.col("bucket") if side == 0 else F.col("bucket") + step
        keyed = each.select("dim", early.alias("early"), F.lit(abs(step)).alias("gap"), F.col(p).alias("p"), F.col(q).alias("q"), F.lit(side).alias("side"), "id", "t", "v")
        return keyed if step else keyed.where("p < q" if side else "p <= q")

    dealt = met("other", 0, 0).unionByName(met("other", 1, 0)).unionByName(met("other", 0, 1)).unionByName(met("other", 1, -1))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0], pdf[pdf.side == 1]
        same = pdf["gap"].iloc[0] == 0 and pdf["p"].iloc[0] == pdf["q"].iloc[0]
        right = left if same else right
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "score": []})
        scores = np.stack(left.v.map(lambda v: np.asarray(v, float))) @ np.stack(right.v.map(lambda v: np.asarray(v, float))).T
        near = (scores >= threshold) & (np.abs(left.t.to_numpy()[:, None] - right.t.to_numpy()[None]) <= seconds)
        i, j = np.nonzero(np.triu(near, 1) if same else near)
        ti, tj, a, b = left.t.to_numpy()[i], right.t.to_numpy()[j], left.id.to_numpy()[i], right.id.to_numpy()[j]
        swap = (ti > tj) | ((ti == tj) & (a > b))
        return pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b), "score": scores[i, j]})

    kind = dict(rows.dtypes)["id"]
    found = dealt.groupBy("dim", "early", "gap", "p", "q").applyInPandas(products, f"a {kind}, b {kind}, score double")
    return found.where("a <> b")


def level_stats(pairs: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(level, pairs, articles, pct): pairs, distinct ends and their share of ``n_docs`` (one row: n)."""
    pairs = settle(pairs)  # read twice
    counts = pairs.groupBy("level").agg(F.count("*").alias("pairs"))
    ends = pairs.select("level", F.explode(F.array("a", "b")).alias("x")).groupBy("level").agg(F.count_distinct("x").alias("articles"))
    return counts.join(ends, "level").crossJoin(F.broadcast(n_docs)).select("level", "pairs", "articles", (F.lit(100.0) * F.col("articles") / F.col("n")).alias("pct"))


def knn_pairs(rows: DataFrame, k: int = 10, threshold: float = 0.85) -> DataFrame:
    """(a, b, score) with a < b: pairs of one kind where either is among the other's k nearest at or above threshold.

    ``rows`` has id, kind, v. Blocks of one kind are multiplied in numpy, each against each, in
    tasks of bounded size; ties go to the smaller id. Vectors that are null or empty or hold a null
    or NaN, and rows without id or kind, take no part; vectors of different length have no pairs;
    an empty table gives none.
    """
    block = 2048
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")))
    rows = rows.where(F.col("id").isNotNull() & F.col("kind").isNotNull() & (F.size("v") > 0) & fine)
    rows = rows.select("id", F.struct("kind", F.size("v").alias("dim")).alias("kind"), "v")
    sizes = rows.groupBy("kind").agg(F.ceil(F.count("*") / block).cast("int").alias("grid"))
    placed = rows.join(sizes, "kind").withColumn("own", F.pmod(F.xxhash64("id"), F.col("grid")).cast("int"))
    asks = placed.select("kind", F.col("own").alias("p"), F.explode(F.sequence(F.lit(0), F.col("grid") - 1)).alias("q"), F.lit(0).alias("side"), "id", "v")
    held = placed.select("kind", F.explode(F.sequence(F.lit(0), F.col("grid") - 1)).alias("p"), F.col("own").alias("q"), F.lit(1).alias("side"), "id", "v")

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf.side == 0].sort_values("id"), pdf[pdf.side == 1].sort_values("id")
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "score": []})
        scores = np.stack(left.v.map(lambda v: np.asarray(v, float))) @ np.stack(right.v.map(lambda v: np.asarray(v, float))).T
        ids, others = left.id.to_numpy(), right.id.to_numpy()
        scores[ids[:, None] == others[None]] = -np.inf
        scores[~(scores >= threshold)] = -np.inf
        near = scores >= threshold
        crowded = np.flatnonzero(near.sum(1) > k)
        if len(crowded):  # only what reaches the k-th score of its row stays, ties at it go to the smaller ids
            reach = np.partition(scores[crowded], -k, axis=1)[:, -k]
            near[crowded] = scores[crowded] >= reach[:, None]
            for r in crowded[near[crowded].sum(1) > k]:
                at = np.flatnonzero(near[r])
                near[r, at[np.argsort(-scores[r, at], kind="stable")[k:]]] = False
        i, j = np.nonzero(near)
        return pd.DataFrame({"a": ids[i], "b": others[j], "score": scores[i, j]})

    found = asks.unionByName(held).groupBy("kind", "p", "q").applyInPandas(nearest, "a long, b long, score double")
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    top = found.withColumn("r", best).where(F.col("r") <= k)
    return top.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))
