"""Batches of whole texts that ask shards of a key space for corpus-wide facts.

A batch reduces its keys to distinct ones, sorted, before they are shuffled, so a frequent key
costs one entry per batch. A shard owns a contiguous range of 64-bit keys, combines what all
batches sent it and answers each batch in the batch's own key order.

Batches don't write to each shard: keys travel in levels. At each level a sender splits its keys
into ``fan`` ranges at most; a node merges what up to ``fan`` senders have in one range, and is a
sender of the next level. Rows per batch are thus bounded by ``fan`` a level, and the number of
levels is the logarithm of the number of batches to that base; with the default all inputs below
64 GB take one level and those below 256 TB two. Answers come back the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Bytes of text in a batch; the number of batches and shards follows from the table's size.
BATCH_BYTES = 16 << 20
#: Ranges into which a sender splits its keys at a level, at most.
FAN = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DDL = {"string": "string", "int32": "int", "int64": "long", "binary": "binary", "bool": "boolean", "double": "double"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[str(f.type)]}" for f in schema)


def batch_count(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(1, math.ceil(total / batch_bytes))


def labels(docs: DataFrame, n: int) -> list[int]:
    """n numbers that Spark's hash deals evenly to the shuffle partitions, so that few batches don't meet in one task."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each, taken, out = -(-n // parts), {}, []
    tried = spark.range(32 * n + 1024).select(F.col("id").cast("int").alias("i"))
    for r in tried.select("i", F.pmod(F.hash("i"), F.lit(parts)).alias("p")).collect():  # 32 numbers a batch, see ``dealt``
        if len(out) < n and taken.get(r["p"], 0) < each:
            taken[r["p"]] = taken.get(r["p"], 0) + 1
            out.append(r["i"])
    return out if len(out) == n else list(range(n))


@dataclass(frozen=True)
class Dealt:
    """Rows of a table in batches: (doc_id, text as bytes, ..., number, batch), batch being the label of the number."""

    rows: DataFrame
    names: list[int] | None

    def named(self, told: DataFrame) -> DataFrame:
        """Answers with the label of the batch that they are for."""
        return told.withColumn("batch", _label(F.col("sender"), self.names))


def _label(number, names: list[int] | None):
    return F.element_at(F.lit(names).cast("array<int>"), (number + 1).cast("int")) if names else number.cast("int")


def dealt(docs: DataFrame, batches: int, *more) -> Dealt:
    """Rows dealt evenly by their place in the table, whatever their id, source or text, repeated rows too.

    All passes must see one order: a table read from files does; where a shuffle comes before, the
    rows are settled first. Up to FAN batches get labels that land in different tasks.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *more)
    if "Exchange" in kept._jdf.queryExecution().executedPlan().toString():
        kept = settle(kept)
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches)).cast("int")
    names = labels(docs, batches) if 1 < batches <= FAN else None
    numbered = kept.withColumn("number", number)
    return Dealt(numbered.withColumn("batch", _label(F.col("number"), names)), names)


class _Numbers(dict):
    """Numbers words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tokens(texts: pa.ChunkedArray | pa.Array, lower: bool = False, part_bytes: int = 2 << 20) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Words of texts end to end, as numbers in the order in which they are met; words per text; the distinct words.

    Words are runs of anything but ASCII white space; null texts have none. ``lower`` folds A to Z.
    Texts are split in parts of about ``part_bytes``, so what is held beside the result is small.
    """
    whole = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    before = np.cumsum(pc.fill_null(pc.binary_length(whole), 0).to_numpy().astype(np.int64)) // part_bytes
    first = np.flatnonzero(np.diff(before, prepend=-1))
    ids, numbers, lengths = _Numbers(), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for a, b in zip(first, np.append(first[1:], len(whole))):
        part = pc.fill_null(whole.slice(a, b - a), b"").view(pa.string())  # bytes that are no UTF-8 pass, all steps are bytewise
        split = pc.ascii_split_whitespace(pc.ascii_lower(part) if lower else part)
        words = split.flatten()
        full = pc.binary_length(words).to_numpy() > 0
        ends = np.cumsum(split.value_lengths().to_numpy())
        lengths.append(np.diff(np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], ends])]))
        encoded = words.filter(pa.array(full)).dictionary_encode()
        known = encoded.dictionary.view(pa.binary()).to_pylist()
        numbers.append(np.fromiter(map(ids.__getitem__, known), np.int32, len(known))[encoded.indices.to_numpy()])
    return np.concatenate(numbers), np.concatenate(lengths), list(ids)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def distinct_sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted distinct keys, by sorting."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def distinct_places(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and which of them each value is; fewer and smaller arrays than np.unique takes."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    where = np.empty(len(values), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return ranked[new], where


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard numbers that grow with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first one whole, the others as differences of six bytes where they fit."""
    if not len(keys):
        return b""
    steps = np.diff(keys)
    if len(steps) and int(steps.max()) >> 48:
        return b"w" + keys.tobytes()
    return b"d" + keys[:1].tobytes() + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack_keys(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    if blob[:1] == b"w":
        return np.frombuffer(blob, np.uint64, offset=1)
    six = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, 6)
    out = np.zeros((len(six) + 1, 8), np.uint8)
    out[1:, :6] = six
    steps = out.view(np.uint64).ravel()
    steps[0] = np.frombuffer(blob, np.uint64, 1, 1)[0]
    return np.cumsum(steps, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts of one byte; those from 255 on follow in full."""
    big = counts[counts >= 255].astype(np.int64)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + big.tobytes() + np.int64(len(big)).tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n_big = int(np.frombuffer(blob[-8:], np.int64)[0])
    end = len(blob) - 8 - 8 * n_big
    out = np.frombuffer(blob, np.uint8, end).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, np.int64, n_big, end)
    return out


def combine(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys and summed counts of all parts, and for each part where its keys are among them."""
    parts = list(parts)
    keys = np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)])
    if not len(keys):
        return keys, counts, [np.zeros(0, np.int64) for _ in parts]
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(first) - 1
    ends = np.cumsum([len(k) for k, _ in parts])[:-1]
    return ranked[first], np.add.reduceat(counts[order], np.flatnonzero(first)), np.split(where, ends)


class Payload(Protocol):
    """What travels: lists of entries ordered by 64-bit keys, and how they are merged and answered."""

    #: Binary columns that hold a sender's entries.
    fields: tuple[str, ...]
    #: Whether senders write to each of their ranges, empty ones too, so that all learn the whole totals.
    everywhere: bool

    def merge(self, rows: list[tuple[bytes, ...]]) -> tuple[Any, list[np.ndarray]]:
        """Distinct entries of several senders in key order, and for each sender where its answers are."""

    def split(self, merged: Any, cells: int) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(cell, fields) for each of ``cells`` key ranges that holds entries."""

    def answer(self, merged: Any) -> tuple[np.ndarray, np.ndarray]:
        """Answers in entry order, and this shard's share of totals that all batches learn."""

    def pack(self, answers: np.ndarray) -> bytes: ...

    def unpack(self, blob: bytes) -> np.ndarray: ...


class Counts:
    """Keys with counts; the answer to a key is the sum of its counts, ``limit`` at most."""

    fields = ("keys", "counts")
    everywhere = False

    def __init__(self, limit: int | None = None):
        self.limit = limit

    def merge(self, rows):
        keys, sums, where = combine((unpack_keys(k), unpack_counts(c)) for k, c in rows)
        return (keys, sums), where

    def split(self, merged, cells):
        keys, sums = merged
        owner = shard_of(keys, cells)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(keys))):
            yield int(owner[a]), self.blobs((keys[a:b], sums[a:b]))

    def blobs(self, merged) -> tuple[bytes, ...]:
        return pack_keys(merged[0]), pack_counts(merged[1])

    def answer(self, merged):
        sums = merged[1]
        return sums if self.limit is None else np.minimum(sums, self.limit), self.totals(*merged)

    def totals(self, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.int64)

    def pack(self, answers):
        return pack_counts(answers)

    def unpack(self, blob):
        return unpack_counts(blob)


@dataclass(frozen=True)
class Route:
    """Levels between batches and shards, and the ranges that a sender splits its keys into."""

    fan: int
    levels: int

    @classmethod
    def plan(cls, batches: int, most: int = FAN) -> "Route":
        levels, fan = 1, 1
        while most**levels < batches:
            levels += 1
        while fan**levels < batches:
            fan += 1
        return cls(fan, levels)


def ask_schema(payload: Payload) -> pa.Schema:
    return pa.schema([("cell", pa.int64()), ("sender", pa.int64()), *[(f, pa.binary()) for f in payload.fields]])


TELL = pa.schema([("home", pa.int64()), ("sender", pa.int64()), ("part", pa.int64()), ("answer", pa.binary()), ("share", pa.binary())])


def asks(payload: Payload, merged: Any, sender: int, route: "Route", level: int = 1, home: int = 0) -> pa.Table:
    """Rows of one sender to the cells of ``level``, a sender of cell ``home`` of the level before."""
    sent = dict(payload.split(merged, route.fan**level))
    if payload.everywhere:
        none = payload.merge([])[0]
        empty = tuple(payload.blobs(none))
        sent = {cell: sent.get(cell, empty) for cell in range(home * route.fan, (home + 1) * route.fan)}
    rows = [(cell, sender, *blobs) for cell, blobs in sent.items()]
    schema = ask_schema(payload)
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def told_to(payload: Payload, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A sender's answers in its entry order, and the summed shares."""
    parts = told.sort_by("part").to_pydict()
    shares = [np.frombuffer(x, np.int64) for x in parts["share"]]
    answers = [payload.unpack(x) for x in parts["answer"]]
    return np.concatenate(answers) if answers else np.zeros(0, np.int64), np.sum(shares, 0) if shares else np.zeros(0, np.int64)


def exchange(asked: DataFrame, payload: Payload, route: Route) -> DataFrame:
    """(home, sender, part, answer, share): answers to the rows that batches sent as senders of level one."""
    fan, fields = route.fan, payload.fields

    def entries(table: pa.Table) -> list[tuple[bytes, ...]]:
        return list(zip(*[table.column(f).to_pylist() for f in fields]))

    def reply(table: pa.Table, where: list[np.ndarray], whole: np.ndarray, share: np.ndarray) -> pa.Table:
        cells, shared = table.column("cell").to_numpy(), np.asarray(share, np.int64).tobytes()
        out = [cells // fan, table.column("sender").to_numpy(), cells % fan, [payload.pack(whole[w]) for w in where], [shared] * len(cells)]
        return pa.table([pa.array(c, f.type) for c, f in zip(out, TELL)], schema=TELL)

    def up(level: int):
        def run(table: pa.Table) -> pa.Table:
            merged, _ = payload.merge(entries(table))
            return asks(payload, merged, table.column("sender")[0].as_py() // fan, route, level + 1, table.column("cell")[0].as_py())

        return run

    def tell(table: pa.Table) -> pa.Table:
        merged, where = payload.merge(entries(table))
        return reply(table, where, *payload.answer(merged))

    def down(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return TELL.empty_table()
        _, where = payload.merge(entries(table))
        return reply(table, where, *told_to(payload, told))

    node = F.floor(F.col("sender") / fan).cast("long").alias("node")
    levels = [asked]
    for level in range(1, route.levels):
        levels.append(levels[-1].groupBy("cell", node).applyInArrow(up(level), ddl(ask_schema(payload))))
    told = levels[-1].groupBy("cell").applyInArrow(tell, ddl(TELL))
    for asked_before in reversed(levels[:-1]):
        told = asked_before.groupBy("cell", node).cogroup(told.groupBy("home", "sender")).applyInArrow(down, ddl(TELL))
    return told
