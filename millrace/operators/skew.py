"""Joins whose keys may be very unevenly frequent, and tasks of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1 / HOT_KEYS of all rows are joined by broadcast; there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000
#: Rows of a few columns that a task gets at most, about, where keys are even.
TASK_ROWS = 1_000_000
#: So many ids are broadcast at most.
BROADCAST_IDS = 1_000_000


def spread(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """``rows``, of which there are about ``count``, dealt by ``keys`` to so many tasks that each gets TASK_ROWS.

    Adaptive execution merges partitions up to a size in compressed bytes; sorted and repeated keys
    compress so well that a task may get tens of millions of rows. A number given here is kept.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS)), *keys)


def join_counted(rows: DataFrame, groups: DataFrame, key: str, count: str = "size") -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row per ``key`` and the number of its rows in ``count``.

    Groups of frequent keys, fewer than HOT_KEYS rows whatever the input's size, are broadcast, so
    their rows stay where they are; all others are joined by key. Both sides are read twice: settle
    what is costly. Rows with a null key are left out.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) > F.lit(total // HOT_KEYS)
    marked = rows.join(F.broadcast(groups.where(often).withColumn("__hot", F.lit(True))), key, "left")
    hot = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot IS NULL").select(*rows.columns).join(groups.where(~often), key)
    return hot.unionByName(rest)


def by_ids(rows: DataFrame, ids: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """``rows`` whose ``key`` is in ``ids``, or with ``keep`` false those whose key isn't.

    Up to BROADCAST_IDS ids, counted first, are broadcast, so that wide rows stay where they are; more
    of them are joined by key. ``ids`` is read twice: settle what is costly.
    """
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi" if keep else "left_anti")
