"""Optimal length buckets: a dynamic programme over the global histogram of lengths chooses
the bucket boundaries of least padding; batches of a token budget form inside each bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import word_count

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows are numbered in slices of about SLICE_ROWS, SLICES of them at least.
SLICES, SLICE_ROWS = 64, 4_000_000


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Boundaries (largest length of each bucket, ascending) of least total padding.

    ``histogram`` holds (length, rows), sorted by length. With C the running row count the
    padded tokens of a bucket (i, j] are length_j * (C_j - C_i), so each layer of the programme
    takes, for growing length_j, the minimum over lines of slope -C_i: one pass over a convex
    hull, in exact integers. Fewer distinct lengths than buckets give a boundary each.
    """
    lengths = [x for x, _ in histogram]
    n = len(lengths)
    if n <= buckets:
        return lengths
    running = [0]
    for _, rows in histogram:
        running.append(running[-1] + rows)
    best = [0] + [lengths[j - 1] * running[j] for j in range(1, n + 1)]
    choices = []
    for layer in range(2, buckets + 1):
        now, came = [0] * (n + 1), [0] * (n + 1)
        hull: list[int] = []
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if i >= layer - 1:
                while len(hull) - head >= 2:
                    a, b = hull[-2], hull[-1]
                    # b is never the least if a and i meet before a and b do
                    if (best[i] - best[a]) * (running[b] - running[a]) <= (best[b] - best[a]) * (running[i] - running[a]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            if j < layer:
                continue
            x = lengths[j - 1]
            while len(hull) - head >= 2 and best[hull[head + 1]] - x * running[hull[head + 1]] <= best[hull[head]] - x * running[hull[head]]:
                head += 1
            i = hull[head]
            now[j], came[j] = best[i] + x * (running[j] - running[i]), i
        best, _ = now, choices.append(came)
    out, j = [], n
    for came in reversed(choices):
        out.append(lengths[j - 1])
        j = came[j]
    out.append(lengths[j - 1])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET, slices: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding.

    Every batch of a bucket holds max(1, token_budget // bucket_len) rows but for its last one,
    so its padded size is within the budget unless one row alone exceeds it. Null and empty
    texts have length 0; repeated rows are packed each; an empty table gives no rows; other
    columns are not looked at. Rows get their number within a bucket from (slice, order in the
    slice), with the slices' offsets from their counts, so no task holds a whole bucket.
    The histogram that reaches the driver has at most sqrt(2 * tokens) + 1 entries, as that
    many distinct lengths need so many tokens.
    """
    sized = settle(docs.select("doc_id", word_count(F.col("text")).alias("n_tokens")))
    counts = sized.groupBy("n_tokens").agg(F.count("*").alias("rows"))
    histogram = sorted((r["n_tokens"], r["rows"]) for r in counts.collect())
    bounds = optimal_boundaries(histogram, buckets)
    slices = slices or max(SLICES, sum(rows for _, rows in histogram) // SLICE_ROWS)
    n = F.col("n_tokens")
    bucket = sum(((n > b).cast("int") for b in bounds[:-1]), F.lit(0))
    placed = sized.withColumn("bucket", bucket).withColumn("bucket_len", F.element_at(F.array(*[F.lit(b).cast("long") for b in bounds or [0]]), F.col("bucket") + 1))
    placed = placed.withColumn("capacity", F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.lit(1), F.col("bucket_len")))).cast("long"))
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(slices)))
    starts = placed.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("bucket", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # buckets * slices rows
    number = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("n_tokens", "doc_id")) - 1 + F.col("start")
    return (
        placed.join(F.broadcast(starts), ["bucket", "slice"])
        .withColumn("number", number)
        .select(
            "doc_id",
            "n_tokens",
            "bucket",
            "bucket_len",
            F.floor(F.col("number") / F.col("capacity")).cast("long").alias("batch_id"),
            (F.col("number") % F.col("capacity")).alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )
