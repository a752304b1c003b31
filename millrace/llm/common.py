"""Pieces that several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words in ``text``; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text (0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def held_out(doc_id: Column, parts: int) -> Column:
    return fold(doc_id, parts) == 2


def unit_hash(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the values (52 bits of md5)."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def first_by_hash(df: DataFrame, limit: int, seed: int, *key: str) -> DataFrame:
    """The ``limit`` rows of least key hash, ties by key.

    Rows are counted first, and only those in a share of the hash range that holds about twice
    ``limit`` rows are sorted, so what tasks hand on doesn't grow with their number.
    """
    order = F.xxhash64(F.lit(seed), *key)
    share = 2 * limit / max(1, df.count()) + 1e-6
    near = df.where(F.pmod(F.shiftrightunsigned(order, 11), F.lit(2**32)) < int(share * 2**32)) if share < 1 else df
    return near.orderBy(order, *key).limit(limit)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, parts: int = 4, seed: int = 7) -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled training rows, half of each class, by hash order.

    The bound is the documented one for fitting classifiers: rows whose fold is the
    held-out one, and rows without id, text or label, take no part. A document labelled
    more than once counts with its highest label, one that occurs more than once with its
    first text in text order.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"), parts))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    halves = [first_by_hash(known.where(F.col("y") == y), limit // 2, seed, "doc_id") for y in (0, 1)]
    picked = halves[0].unionByName(halves[1])  # at most ``limit`` rows of 12 bytes
    return (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
    )


def byte_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)
