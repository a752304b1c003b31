"""Substring deduplication with an FM-index per shard.

A window of words belongs to the shard of its anchor, the word 5-gram of least hash in it, so
equal windows meet in one shard and each shard indexes only what is dealt to it. Anchors that
one document alone holds settle their windows at once. The others' windows travel as segments,
maximal runs of windows of one anchor. A shard builds a compressed FM-index over its distinct
segments, with the least doc_id of each, and streams the segments of the documents against it:
where the matching statistic reaches a window's length, the interval of its occurrences is
reported, and the least doc_id in the interval is the answer. Windows of anchors that very many
documents hold are dealt one by one, by their own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .exchange import ddl
from .fmindex import FMIndex

WINDOW = 13
ANCHOR = 5
#: Documents that hold an anchor from which on its windows are dealt by their own hash.
HOT_ANCHOR = 2048
#: Stands for a null doc_id: larger than every other.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Batch:
    """Words of a batch's texts end to end, as numbers and hashes."""

    doc_id: np.ndarray
    start: np.ndarray
    length: np.ndarray
    row: np.ndarray
    hashes: np.ndarray
    window: int
    anchor: int

    @classmethod
    def read(cls, table: pa.Table, window: int, anchor: int) -> "Batch":
        number, length, distinct = ex.tokens(table.column("text"))
        doc_id = pc.fill_null(table.column("doc_id"), NO_ID).to_numpy()
        hashes = ex.hashes(distinct)[number] if len(number) else np.zeros(0, np.uint64)
        return cls(doc_id, np.cumsum(length) - length, length, np.repeat(np.arange(len(length), dtype=np.int32), length), hashes, window, anchor)

    def grams(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position on, where so many are left."""
        n = max(0, len(self.hashes) - size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.hashes[k : k + n]
        return ex.mix(out)

    def runs(self) -> "Runs":
        """Maximal runs of windows of one row that share their anchor."""
        n = max(0, len(self.hashes) - self.window + 1)
        at = np.flatnonzero(self.row[:n] == self.row[self.window - 1 : self.window - 1 + n])
        if not len(at):
            return Runs(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        least, reach, wanted = self.grams(self.anchor), 1, self.window - self.anchor + 1
        while reach < wanted:
            step = min(reach, wanted - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        least = least[at]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])
        head = np.flatnonzero(new)
        return Runs(at[head], np.diff(np.append(head, len(at))), least[head])


@dataclass
class Runs:
    """First window of each run, number of windows, anchor."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def _holders(batch: Batch, runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors and the number of rows of the batch that hold each."""
    row = batch.row[runs.start]
    order = np.argsort(runs.anchor, kind="stable")  # rows stay ascending within an anchor
    a, r = runs.anchor[order], row[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    return ex.distinct_sums(a[new], np.ones(int(new.sum()), np.int64))


@dataclass
class Pieces:
    """Distinct segments of a batch in the order of their keys, and where each window's answer will be."""

    key: np.ndarray
    start: np.ndarray
    length: np.ndarray
    least: np.ndarray
    window_at: np.ndarray
    answer: np.ndarray

    @classmethod
    def cut(cls, batch: Batch, runs: Runs, counts: np.ndarray, keys: np.ndarray, hot: int) -> "Pieces":
        held = counts[np.searchsorted(keys, runs.anchor)] if len(keys) else np.zeros(0, np.int64)
        live = held > 1
        first, windows, anchor, alone = runs.start[live], runs.windows[live], runs.anchor[live], held[live] > hot
        if not len(first):
            none = np.zeros(0, np.int64)
            return cls(none.view(np.uint64), none, none, none, none, none)
        # windows of hot anchors are segments of their own
        pieces = np.where(alone, windows, 1)
        start = np.repeat(first, pieces) + (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        alone, anchor = np.repeat(alone, pieces), np.repeat(anchor, pieces)
        windows = np.where(alone, 1, np.repeat(windows, pieces))
        head = np.cumsum(windows) - windows
        place = np.arange(int(windows.sum())) - np.repeat(head, windows)
        at = np.repeat(start, windows) + place
        whole = np.zeros(len(at), np.uint64)
        for k in range(batch.window):
            whole = whole * np.uint64(0xD6E8FEB86659FD93) + batch.hashes[at + k]
        whole = ex.mix(whole)
        key = np.where(alone, whole[head], ex.mix(anchor))
        # segments of equal words: a hash over the window hashes in order
        content = np.add.reduceat(ex.mix(whole + place.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), head)
        content = ex.mix(content + windows.astype(np.uint64))
        order = np.lexsort((batch.doc_id[batch.row[start]], content, key))
        first = np.ones(len(order), bool)
        first[1:] = (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])
        group = np.cumsum(first) - 1
        of_segment = np.empty(len(order), np.int64)
        of_segment[order] = group
        pick = order[first]
        offset = np.cumsum(windows[pick]) - windows[pick]
        answer = np.repeat(offset[of_segment], windows) + place
        return cls(key[pick], start[pick], windows[pick] + batch.window - 1, batch.doc_id[batch.row[start[pick]]], at, answer)


def _gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each of many runs, end to end."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


@dataclass
class Merged:
    """Distinct segments in key order: words end to end and the least doc_id of the documents that hold each."""

    key: np.ndarray
    length: np.ndarray
    words: np.ndarray
    least: np.ndarray


class Segments:
    """Segments on their way to the shard of their key; the answer to each window is a doc_id."""

    fields = ("keys", "lengths", "words", "least")
    everywhere = False

    def __init__(self, window: int):
        self.window = window

    def merge(self, rows: list[tuple[bytes, ...]]) -> tuple[Merged, list[np.ndarray]]:
        key, length, words, least = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i, t in enumerate((np.uint64, np.int32, np.uint64, np.int64)))
        length = length.astype(np.int64)
        start, windows = np.cumsum(length) - length, length - self.window + 1
        place = np.arange(len(words)) - np.repeat(start, length)
        content = np.add.reduceat(ex.mix(words + place.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)), start)
        content = ex.mix(content + length.astype(np.uint64))
        order = np.lexsort((least, content, key))
        first = np.ones(len(order), bool)
        first[1:] = (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])
        pick, group = order[first], np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        merged = Merged(key[pick], length[pick], words[_gather(start[pick], length[pick])], least[pick])
        mine = np.cumsum(windows[pick]) - windows[pick]
        ends = np.cumsum([len(r[1]) // 4 for r in rows])[:-1]
        return merged, [_gather(mine[g], n) for g, n in zip(np.split(group, ends), np.split(windows, ends))]

    def split(self, merged: Merged, cells: int) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        owner = ex.shard_of(merged.key, cells)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        at = np.concatenate([[0], np.cumsum(merged.length)])
        for a, b in zip(first, np.append(first[1:], len(owner))):
            words = merged.words[at[a] : at[b]]
            yield int(owner[a]), (merged.key[a:b].tobytes(), merged.length[a:b].astype(np.int32).tobytes(), words.tobytes(), merged.least[a:b].tobytes())

    def answer(self, merged: Merged) -> tuple[np.ndarray, np.ndarray]:
        return least_holders(merged.words, merged.length, merged.least, self.window), np.zeros(0, np.int64)

    def pack(self, answers: np.ndarray) -> bytes:
        return answers.astype(np.int64).tobytes()

    def unpack(self, blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, np.int64)


def least_holders(words: np.ndarray, length: np.ndarray, least: np.ndarray, window: int) -> np.ndarray:
    """For each window of the segments, in order, the least doc_id whose segments hold its words.

    The segments, end to end in ``words``, are indexed with the ids in ``least`` and streamed
    against the index. A window that one place alone holds keeps its own segment's id.
    """
    n = length - window + 1
    answer = np.repeat(least, n)
    if not len(answer):
        return answer
    symbol = np.unique(words, return_inverse=True)[1].astype(np.int64) + 1
    own = length + 1
    begin = np.cumsum(own) - own
    text = np.zeros(int(own.sum()), np.int64)
    text[_gather(begin, length)] = symbol
    index = FMIndex(text, window, np.repeat(least, own))
    size, low, _ = index.matching_statistics(text, begin, length)
    at = _gather(begin, n)
    reached = np.flatnonzero(size[at] >= window)
    class_of = index.classes(window).number(low[at[reached]])
    shared = class_of >= 0
    answer[reached[shared]] = index.least[class_of[shared]]
    return answer


def dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT_ANCHOR, batch_bytes: int = ex.BATCH_BYTES, fan: int = ex.FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts in a document of
    smaller doc_id; windows are judged on the input. Null texts have no words; texts of fewer
    words than a window lose none; a repeated doc_id is no smaller than itself; a null doc_id
    is larger than all others; an empty table gives no rows; other columns are not looked at.
    ``anchor`` is at most ``window``. Words are told apart by 64-bit hashes: a wrong match takes
    two words of one hash inside equal contexts. Equal segments are told apart by 64 bits within
    a batch or a shard, whose sizes don't grow with the corpus.
    """
    anchor = min(anchor, window)
    batches = ex.batch_count(docs, batch_bytes)
    route, counts, segments = ex.Route.plan(batches, fan), ex.Counts(hot + 1), Segments(window)
    dealt = ex.dealt(docs, batches)
    rows = dealt.rows

    def ask(table: pa.Table) -> pa.Table:
        batch = Batch.read(table, window, anchor)
        return ex.asks(counts, _holders(batch, batch.runs()), table.column("number")[0].as_py(), route)

    def cut_pieces(table: pa.Table, told: pa.Table) -> tuple[Batch, Pieces]:
        batch = Batch.read(table, window, anchor)
        runs = batch.runs()
        return batch, Pieces.cut(batch, runs, ex.told_to(counts, told)[0], ex.distinct(runs.anchor), hot)

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ex.ask_schema(segments).empty_table()
        batch, own = cut_pieces(left, right)
        merged = Merged(own.key, own.length, batch.hashes[_gather(own.start, own.length)], own.least)
        return ex.asks(segments, merged, left.column("number")[0].as_py(), route)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT.empty_table()
        first = right.column("of_counts")
        batch, own = cut_pieces(left, right.filter(first))
        least, _ = ex.told_to(segments, right.filter(pc.invert(first)))
        n = len(batch.hashes)
        gone = np.zeros(n + 1, np.int64)
        if len(own.window_at):
            bad = own.window_at[least[own.answer] < batch.doc_id[batch.row[own.window_at]]]
            np.add.at(gone, bad, 1)
            np.add.at(gone, bad + batch.window, -1)
        keep = np.cumsum(gone[:n]) == 0
        out = []
        for d, text, s, size in zip(left.column("doc_id").to_pylist(), left.column("text").to_pylist(), batch.start, batch.length):
            words, flags = (text or b"").split(), keep[s : s + size]
            kept = words if flags.all() else [w for w, k in zip(words, flags.tolist()) if k]
            out.append((d, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_OUT)], schema=_OUT)

    told = dealt.named(ex.exchange(rows.groupBy("batch").applyInArrow(ask, ddl(ex.ask_schema(counts))), counts, route))
    cut = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(deal, ddl(ex.ask_schema(segments)))
    found = dealt.named(ex.exchange(cut, segments, route))
    answers = told.withColumn("of_counts", F.lit(True)).unionByName(found.withColumn("of_counts", F.lit(False)))
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(remove, ddl(_OUT))


ORACLE = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 12)) AS i FROM worded WHERE len(w) >= 13
), keyed AS (
  SELECT v.doc_id, v.i, md5(array_to_string(w[v.i : v.i + 12], ' ')) AS k FROM windows v JOIN worded USING (doc_id)
), least AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) < doc_id AS dup FROM keyed
), places AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM least WHERE dup
), gone AS (
  SELECT doc_id, list(p) AS ps, count(*) AS n FROM places GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, j: ps IS NULL OR NOT list_contains(ps, j)), ' ')) AS kept_sha256
FROM worded LEFT JOIN gone USING (doc_id)
"""
