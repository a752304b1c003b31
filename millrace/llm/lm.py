"""LM scoring by a weighted backoff automaton.

States are the root, one for each word, and one for each pair of words that the training texts
hold STATE times or more. An arc out of a state is a smoothed n-gram: its weight is the log
probability of the next word, and it leads to the longest state that the text then ends in.
Failure arcs lead from a pair's state to that of its second word and from a word's state to the
root, whose arcs are the smoothed unigrams. Texts are read once from left to right, all texts of
a batch together: each carries its state, and adds up the weights of the arcs that it takes.

Counts are taken over all training documents. Each batch of texts asks shards of the n-gram
space for the counts of its own n-grams, first of words and pairs, then of the triples that
leave its states, and builds the part of the automaton that it can reach, so nothing that grows
with the corpus is ever in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .common import held_out
from .exchange import ddl

FOLDS = 7
#: Weight of a context's own statistics, by its order: TRUST * c / (c + HALF) after c occurrences.
TRUST, HALF = {1: 0.8, 2: 0.5}, 10.0
#: Occurrences from which on a pair of words is a state.
STATE = 16
#: What stands for a text's end, and for the context at its start; no word can hold a line feed.
END, START = b"\n", b"\n\n"
ROOT = -1
#: The two lowest bits of a key are the length of its n-gram.
_WORD, _PAIR, _TRIPLE = np.uint64(1), np.uint64(2), np.uint64(3)


def _tagged(hashes: np.ndarray, tag: np.uint64) -> np.ndarray:
    return hashes & ~np.uint64(3) | tag


_END_KEY = _tagged(np.array([xxhash.xxh3_64_intdigest(END)], np.uint64), _WORD)[0]


class NgramCounts(ex.Counts):
    """Sums of counts; the totals are training tokens, distinct training tokens and training texts."""

    everywhere = True

    def totals(self, keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        words = keys & np.uint64(3) == _WORD
        return np.array([sums[words].sum(), (sums[words] > 0).sum(), sums[keys == _END_KEY].sum()], np.int64)


def own_share(order: int, count: np.ndarray) -> np.ndarray:
    """The weight of a context's own statistics."""
    return TRUST[order] * count / (count + HALF)


@dataclass
class Automaton:
    """States: 0 to words - 1 for words (START included), then the pairs; ``keys`` is state * words + word of each arc, sorted."""

    words: int
    root: np.ndarray
    failure: np.ndarray
    fall: np.ndarray
    keys: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def build(cls, grams: "Grams", total: int, distinct: int) -> "Automaton":
        """From the counts of a batch's n-grams and the corpus totals.

        P(w) = (c(w) + 1) / (N + V + 1), one share being left for words never seen;
        P(w | u) = r c(u, w) / c(u) + (1 - r) P(w); P(w | u, v) = r c(u, v, w) / c(u, v) + (1 - r) P(w | v),
        where the state (u, v) exists, with r = own_share() of the context's count.
        """
        n = len(grams.count)
        root = (grams.count + 1) / (total + 1 * (distinct + 1))
        second = (grams.pair % n).astype(np.int32)
        context = grams.context.astype(float)
        share = own_share(1, context)
        seen = np.flatnonzero(grams.pair_count > 0)
        u, w = (grams.pair[seen] // n).astype(np.int32), second[seen]
        lower = np.zeros(len(grams.pair))  # P(second | first)
        lower[seen] = share[u] * grams.pair_count[seen] / context[u] + (1 - share[u]) * root[w]
        del u, w
        # the state that a text ends in after a pair
        after = second.copy()
        after[grams.state] = n + np.arange(len(grams.state))
        held = grams.pair_count[grams.state].astype(float)
        share3 = own_share(2, held)
        full = np.flatnonzero(grams.triple_count > 0)
        s, last = grams.triple[full] // len(grams.pair), grams.triple[full] % len(grams.pair)
        p3 = share3[s] * grams.triple_count[full] / held[s] + (1 - share3[s]) * lower[last]
        # arcs out of words are sorted already, and come before those out of pairs
        own = (n + s) * n + second[last]
        order = np.argsort(own)
        return cls(
            n,
            np.log10(root),
            np.log10(np.concatenate([1 - share, 1 - share3])),
            np.concatenate([np.full(n, ROOT), second[grams.state]]),
            np.concatenate([grams.pair[seen], own[order]]),
            np.log10(np.concatenate([lower[seen], p3[order]])),
            np.concatenate([after[seen], after[last[order]]]),
        )

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and weights of reading one word in each of many states, over failure arcs where there is no other."""
        at, weight, out = state.copy(), np.zeros(len(state)), word.copy()
        todo = np.arange(len(state))
        while len(todo):
            here, read = at[todo], word[todo]
            done = here == ROOT
            weight[todo[done]] += self.root[read[done]]
            todo, here, read = todo[~done], here[~done], read[~done]
            key = here * self.words + read
            arc = np.searchsorted(self.keys, key)
            hit = arc < len(self.keys)
            hit[hit] = self.keys[arc[hit]] == key[hit]
            weight[todo[hit]] += self.weight[arc[hit]]
            out[todo[hit]] = self.target[arc[hit]]
            todo, here = todo[~hit], here[~hit]
            weight[todo] += self.failure[here]
            at[todo] = self.fall[here]
        return out, weight

    def score(self, words: np.ndarray, begin: np.ndarray, length: np.ndarray, stretch: int = 512) -> np.ndarray:
        """Log10 probability of each text by traversals from left to right, all side by side.

        ``words`` holds START before each text. Long texts are cut into stretches that first read
        the two words before them from the root: a state holds two words at most, so each stretch
        begins in the state in which the one before it ends.
        """
        pieces = -(-length // stretch)
        owner = np.repeat(np.arange(len(length)), pieces)
        skip = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * stretch
        lead = np.where(skip > 0, 2, 1)
        size = np.minimum(stretch, length[owner] - skip) + lead
        by_length = np.argsort(-size, kind="stable")
        first, size, lead = (begin[owner] + skip - lead)[by_length], size[by_length], lead[by_length]
        state, total = np.full(len(first), ROOT), np.zeros(len(first))
        for k in range(int(size.max(initial=0))):
            on = int(np.searchsorted(-size, -k, "left"))  # stretches longer than k
            state[:on], weight = self.step(state[:on], words[first[:on] + k])
            total[:on] += np.where(k >= lead[:on], weight, 0.0) if k < 2 else weight
        out = np.zeros(len(length))
        np.add.at(out, owner[by_length], total)
        return out


@dataclass
class Grams:
    """Numbered n-grams of a batch with their corpus counts, as far as they are known yet.

    ``pair`` is first * words + second, sorted; ``state`` the pairs that are states; ``triple`` is
    state * pairs + last pair, sorted; ``context`` counts what follows each word.
    """

    count: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    pair_count: np.ndarray
    state: np.ndarray
    triple: np.ndarray
    triple_count: np.ndarray


class Batch:
    """Texts of a batch as numbered tokens, each with START before and END after its words."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, held: np.ndarray):
        number, length, distinct = ex.tokens(texts, lower=True)
        n = len(distinct)
        self.start, self.end, self.words = n, n + 1, n + 2
        self.hashes = ex.hashes([*distinct, START, END])
        del distinct
        self.begin, self.length = np.cumsum(length + 2) - length - 1, length + 1
        self.seq = np.empty(len(number) + 2 * len(length), np.int32)
        token = np.ones(len(self.seq), bool)
        token[self.begin - 1] = False
        self.at = np.flatnonzero(token).astype(np.int32)  # places of tokens that are read, START being none
        token[self.begin + length] = False
        self.seq[token] = number
        self.seq[self.begin - 1], self.seq[self.begin + length] = self.start, self.end
        del number, token
        self.trained = np.repeat(~held, self.length)
        read = self.seq[self.at]
        self.count = np.bincount(read[self.trained], minlength=self.words)
        self.pair, self.pair_of = ex.distinct_places(self.seq[self.at - 1].astype(np.int64) * self.words + read)
        del read
        self.own_pairs = np.bincount(self.pair_of[self.trained], minlength=len(self.pair))
        first, second = self.hashes[self.pair // self.words], self.hashes[self.pair % self.words]
        self.pair_hash = ex.mix(first * np.uint64(0xD6E8FEB86659FD93) + second)

    def first_asks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of words and pairs, their training counts here, and where each word's and pair's key is."""
        keys, where = ex.distinct_places(np.concatenate([_tagged(self.hashes, _WORD), _tagged(self.pair_hash, _PAIR)]))
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, where, np.concatenate([self.count, self.own_pairs]))
        return keys, counts, where

    def grams(self, told: pa.Table, where: np.ndarray, state: int) -> tuple[Grams, np.ndarray, np.ndarray]:
        """What the first answers tell, with the triples out of states; corpus totals; the triple that each token ends, or -1."""
        known, totals = ex.told_to(_COUNTS, told)
        known = known[where]
        count, pair_count = known[: self.words], known[self.words :]
        context = count.copy()
        context[self.start], context[self.end] = totals[2], 0  # nothing follows an end
        states = np.flatnonzero((pair_count >= state) & (self.pair % self.words != self.end))
        number = np.full(len(self.pair), -1, np.int32)
        number[states] = np.arange(len(states))
        # tokens whose two words before are a state, and whose last pair was seen
        before = np.full(len(self.at), -1, np.int32)
        before[1:] = number[self.pair_of[:-1]]
        before[np.cumsum(self.length) - self.length] = -1
        live = np.flatnonzero((before >= 0) & (pair_count[self.pair_of] > 0))
        triple, of = ex.distinct_places(before[live].astype(np.int64) * len(self.pair) + self.pair_of[live])
        triple_of = np.full(len(self.at), -1, np.int32)
        triple_of[live] = of
        return Grams(count, context, self.pair, pair_count, states, triple, np.zeros(0, np.int64)), totals, triple_of

    def second_asks(self, grams: Grams, triple_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys of the triples, their training counts here, and where each one's key is."""
        own = np.bincount(triple_of[(triple_of >= 0) & self.trained], minlength=len(grams.triple))
        pairs = max(1, len(grams.pair))
        hashed = ex.mix(self.pair_hash[grams.state[grams.triple // pairs]] * np.uint64(0x2545F4914F6CDD1D) + self.hashes[grams.pair[grams.triple % pairs] % self.words])
        keys, where = ex.distinct_places(_tagged(hashed, _TRIPLE))
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, where, own)
        return keys, counts, where


_COUNTS = NgramCounts()
_TRIPLES = ex.Counts()
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("mean_score", pa.float64())])


def _read(table: pa.Table) -> Batch:
    return Batch(table.column("text"), table.column("held").to_numpy())


def _score(table: pa.Table, first: pa.Table, second: pa.Table, state: int) -> pa.Table:
    batch = _read(table)
    grams, totals, triple_of = batch.grams(first, batch.first_asks()[2], state)
    known, _ = ex.told_to(_TRIPLES, second)
    grams.triple_count = known[batch.second_asks(grams, triple_of)[2]]
    del triple_of, known, batch.pair_of, batch.pair_hash
    automaton = Automaton.build(grams, int(totals[0]), int(totals[1]))
    seen, batch.pair, batch.own_pairs = grams.count > 0, None, None
    del grams
    score = automaton.score(batch.seq, batch.begin, batch.length)
    tokens = batch.seq[batch.at]
    starts = np.cumsum(batch.length) - batch.length
    n_known = np.add.reduceat(seen[tokens].astype(np.int64), starts)
    base = np.add.reduceat(automaton.root[tokens], starts)
    n = len(score)
    doc_id, held = table.column("doc_id").combine_chunks(), table.column("held").combine_chunks()
    return pa.table([doc_id, held, pa.array(batch.length), pa.array(n_known), pa.array(np.full(n, totals[0])), pa.array(base), pa.array(score), pa.array(score / batch.length)], schema=_OUT)


def score(docs: DataFrame, folds: int = FOLDS, state: int = STATE, batch_bytes: int = ex.BATCH_BYTES, fan: int = ex.FAN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mean_score (per token).

    Null and empty texts consist of an end alone; long texts are read whole; a repeated row
    counts each time; a null doc_id has fold 0; an empty table gives no rows; other columns
    are not looked at. n-grams are told apart by 62-bit hashes of their words.
    """
    batches = ex.batch_count(docs, batch_bytes)
    route = ex.Route.plan(batches, fan)
    dealt = ex.dealt(docs, batches, held_out(F.col("doc_id"), folds).alias("held"))
    rows = dealt.rows

    def ask(table: pa.Table) -> pa.Table:
        keys, counts, _ = _read(table).first_asks()
        return ex.asks(_COUNTS, (keys, counts), table.column("number")[0].as_py(), route)

    def ask_again(left: pa.Table, told: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ex.ask_schema(_TRIPLES).empty_table()
        batch = _read(left)
        grams, _, triple_of = batch.grams(told, batch.first_asks()[2], state)
        keys, counts, _ = batch.second_asks(grams, triple_of)
        return ex.asks(_TRIPLES, (keys, counts), left.column("number")[0].as_py(), route)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _OUT.empty_table()
        first = right.column("first")
        return _score(left, right.filter(first), right.filter(pc.invert(first)), state)

    told = dealt.named(ex.exchange(rows.groupBy("batch").applyInArrow(ask, ddl(ex.ask_schema(_COUNTS))), _COUNTS, route))
    again = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(ask_again, ddl(ex.ask_schema(_TRIPLES)))
    more = dealt.named(ex.exchange(again, _TRIPLES, route))
    answers = told.withColumn("first", F.lit(True)).unionByName(more.withColumn("first", F.lit(False)))
    return rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(answer, ddl(_OUT))


#: The columns of ``score`` that don't depend on the automaton, for documents as the query reads them.
BASE_SQL = r"""
WITH tokens AS (
  SELECT doc_id, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10))) AS w FROM documents
), held AS (
  SELECT doc_id, held_out FROM folds
), counts AS (
  SELECT w, count(*) AS c FROM tokens JOIN held USING (doc_id) WHERE NOT held_out GROUP BY w
), totals AS (
  SELECT sum(c) AS n, count(*) AS v FROM counts
)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens,
  sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n + 1 * (v + 1))::DOUBLE)) AS base_score
FROM tokens JOIN held USING (doc_id) LEFT JOIN counts USING (w), totals GROUP BY doc_id
"""
