"""SimHash near-duplicates: exact comparison of fingerprint tiles.

Fingerprints are binned by the population counts of their four 16-bit quarters. Two
fingerprints that differ in r bits have counts that differ by r at most in sum, so only tiles
of bins within the radius are paired; a pair of tiles is compared with one exclusive-or and
a bit count per pair of members. A tile pair passes on a forest of its links, not the links,
as components need no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.skew import join_counted
from ..session import settle
from .common import byte_batches

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints in a tile; larger bins are cut into several.
TILE = 4096
QUARTERS = 4
_BASE = 17  # a quarter's count is 0 to 16
CELLS = _BASE**QUARTERS


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the word shingles; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(b" ".join(words), seed)
        n = 1
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
        digest = xxhash.xxh64_digest
        n = len(words) - shingle + 1
        digests = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(n, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(0, dtype=np.int64) * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, fp) and the long columns ``carried``, fp a long with the fingerprint's bits, for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            found = np.array([fingerprint(t or b"") for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64)), *[batch.column(c) for c in carried]], names=["doc_id", "fp", *carried])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), *carried)
    return read.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def quarter_counts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, QUARTERS)).astype(np.int64)


def cell_of(counts: np.ndarray) -> np.ndarray:
    return counts @ (_BASE ** np.arange(QUARTERS, dtype=np.int64))


def offsets(radius: int) -> np.ndarray:
    """Steps between bins whose counts differ by ``radius`` at most in sum."""
    grid = np.stack(np.meshgrid(*[np.arange(-radius, radius + 1)] * QUARTERS, indexing="ij"), -1).reshape(-1, QUARTERS)
    return grid[np.abs(grid).sum(1) <= radius]


def forest(a: np.ndarray, b: np.ndarray, radius: int, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, least member) of the components that links between two tiles make."""
    nodes = np.unique(np.concatenate([a, b]))
    label = np.arange(len(nodes))
    ia, ib = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    linked = np.zeros(len(nodes), bool)
    for k in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[k : k + rows, None] ^ b[None]) <= radius)
        x, y = ia[k + i], ib[j]
        other = x != y
        x, y = x[other], y[other]
        if not len(x):
            continue
        linked[x] = linked[y] = True
        while True:  # hook the larger root under the smaller, then shorten all paths
            lx, ly = label[x], label[y]
            low = np.minimum(lx, ly)
            if (lx == ly).all():
                break
            np.minimum.at(label, np.maximum(lx, ly), low)
            while (label[label] != label).any():
                label = label[label]
    member = np.flatnonzero(linked & (label != np.arange(len(nodes))))
    return nodes[member], nodes[label[member]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(src, dst) star edges between distinct fingerprints (column fp) that chain within ``radius`` bits."""
    spark = distinct.sparkSession
    cells = F.lit(0).cast("long")
    for q in range(QUARTERS):
        quarter = F.shiftrightunsigned(F.col("fp"), 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))
        cells = cells + F.bit_count(quarter).cast("long") * F.lit(_BASE**q).cast("long")
    counted = distinct.groupBy(cells.alias("cell")).agg(F.count("*").alias("n")).collect()  # CELLS = 83521 rows at most
    tiles = np.zeros(CELLS, np.int32)
    for r in counted:
        tiles[r["cell"]] = -(-r["n"] // tile)
    shared = spark.sparkContext.broadcast(tiles)
    steps = offsets(radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Send each fingerprint to the tile pairs that need it: key (low cell, its tile, high cell, its tile)."""
        n_tiles = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy().view(np.uint64)
            counts = quarter_counts(fp)
            own = cell_of(counts)
            mine = (fp * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % np.maximum(1, n_tiles[own])
            for step in steps:
                near = counts + step
                ok = ((near >= 0) & (near < _BASE)).all(1)
                other = np.where(ok, cell_of(near), 0)
                ok &= n_tiles[other] > 0
                repeat = np.where(ok, n_tiles[other], 0)
                if not repeat.any():
                    continue
                at = np.repeat(np.arange(len(fp)), repeat)
                part = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                a, b, ta, tb = own[at], other[at], mine[at], part
                swap = (a > b) | ((a == b) & (ta > tb))
                low, high = np.where(swap, b, a), np.where(swap, a, b)
                tl, th = np.where(swap, tb, ta), np.where(swap, ta, tb)
                yield pa.record_batch(
                    [pa.array((low * CELLS + high).astype(np.int64)), pa.array((tl << 32 | th).astype(np.int64)), pa.array(swap), pa.array(fp[at].view(np.int64))],
                    names=["cells", "tiles", "second", "fp"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows of one tile pair, in order; a run may span batches and holds two tiles at most."""

        def links(key: tuple[int, int], second: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            within = key[0] // CELLS == key[0] % CELLS and key[1] >> 32 == key[1] & 0xFFFFFFFF
            first, other = (fp, fp) if within else (fp[~second], fp[second])
            if not len(first) or not len(other):
                return None
            u, v = forest(first, other, radius)
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["src", "dst"]) if len(u) else None

        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, tls = batch.column("cells").to_numpy(), batch.column("tiles").to_numpy()
            second, fp = batch.column("second").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(tls) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(fp)]):
                key = (int(cells[a]), int(tls[a]))
                if held and held[0] == key:
                    held = (key, [*held[1], second[a:b]], [*held[2], fp[a:b]])
                    continue
                if held and (out := links(held[0], np.concatenate(held[1]), np.concatenate(held[2]))):
                    yield out
                held = (key, [second[a:b]], [fp[a:b]])
        if held and (out := links(held[0], np.concatenate(held[1]), np.concatenate(held[2]))):
            yield out

    dealt = distinct.select("fp").mapInArrow(deal, "cells long, tiles long, second boolean, fp long")
    return dealt.repartition("cells", "tiles").sortWithinPartitions("cells", "tiles").mapInArrow(compare, "src long, dst long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reached over links of at most ``radius`` differing
    bits. Null and empty texts have fingerprint zero, linked like any other; a null doc_id is
    never a component's id unless no other id is in it; repeated rows are one node; an empty
    table gives no rows; other columns are not looked at.
    """
    printed = settle(fingerprints(docs))
    distinct = settle(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")))
    links = settle(fingerprint_links(distinct, radius, tile))
    groups = connected_components(links).withColumnRenamed("node", "fp")
    linked = groups.join(distinct, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("group_least"))
    of_linked = groups.join(least, "component").select("fp", "group_least")
    named = distinct.join(of_linked, "fp", "left").select("fp", "size", F.coalesce("group_least", "least").alias("component_id"))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return join_counted(printed, settle(named), "fp").select("doc_id", "fp", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` without near-duplicates: one row of each component, that of the smallest doc_id; same columns.

    A null doc_id comes after all others, and rows of one doc_id are ordered by their hash.
    Components are told apart by their fingerprints, so different texts without an id, or
    under one repeated id, all stay. Rows are told apart by 128 bits of hash.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    values = [*columns, *[c.isNull() for c in columns]]  # a null alone leaves a hash as it is
    rows = docs.withColumns({"__row": F.xxhash64(*values), "__row2": F.xxhash64(F.lit(1), *values)})
    printed = fingerprints(rows, "__row", "__row2")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row", "__row2")
    distinct = settle(printed.groupBy("fp").agg(F.min(order).alias("least")))
    groups = connected_components(settle(fingerprint_links(distinct, radius))).withColumnRenamed("node", "fp")
    of_each = distinct.join(groups, "fp", "left").groupBy(F.coalesce("component", "fp")).agg(F.min("least").alias("least"))
    kept = rows.join(of_each.select("least.__row", "least.__row2"), ["__row", "__row2"], "left_semi")
    return kept.dropDuplicates(["__row", "__row2"]).select(*columns)
