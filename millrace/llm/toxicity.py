"""Toxicity: a linear-chain conditional random field tags toxic words.

Words of labelled documents get labels from how their forms spread over toxic and clean
documents; a two-state chain over hashed form features is fitted to them by gradient steps on
the conditional likelihood: feature weights, bias, transitions and the initial score all follow
the difference between what forward-backward expects and what the labels hold. Marginals of
every word of a whole text then give the document's score and the offsets of offending words.

Texts of the sample stay in tasks; the driver sees counts, hashed features of a bounded number
of chains, and a few numbers a document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import settle
from .common import byte_batches, held_out, labelled_sample
from .exchange import distinct, mix

#: Labelled rows that a fit looks at, whole texts: half of each class, by hash order.
FIT_ROWS = 6_000
#: Chains of their texts that hold marked words, by hash order, from which the field is fitted, and as
#: many again, twice, of plain ones.
FIT_CHAINS = 8_000
THRESHOLD = 0.3
#: A word at this marginal or above is an offending span.
SPAN_MARGINAL = 0.5
SLOTS = 1 << 18
BLOCK = 64

_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Features of a word: the whole form, the last 5 bytes, prefixes, and longer prefixes with the
#: word's shape (capital first, punctuation after it, longer than the prefix).
PREFIXES, SHAPED = (4, 5, 6, 7, 8), (5, 6, 7)
KINDS = 2 + len(PREFIXES) + len(SHAPED)


@dataclass
class Words:
    """Words of a run of texts: byte bounds in the joined buffer, text number, feature slots."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    slots: np.ndarray


def word_features(texts: list[bytes]) -> Words:
    """Split texts at ASCII white space and hash each word's form without outer punctuation."""
    joined = b"\n".join(texts) + b"\n" + b" " * 16
    raw = np.frombuffer(joined, np.uint8)
    space = _SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(end) and len(end) > len(start):
        end = end[-len(start) :] if len(start) else end[:0]
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    text = np.searchsorted(offsets, start, "right") - 1
    core = np.append(np.flatnonzero(_CORE[raw]), len(raw))
    first = np.minimum(core[np.searchsorted(core, start)], end)
    last_at = np.searchsorted(core, end) - 1
    last = np.where(last_at >= 0, core[np.maximum(last_at, 0)], -1)
    stop = np.where(last >= first, last + 1, first)
    low = _LOWER[raw]
    length = stop - first
    slots = np.empty((KINDS, len(start)), np.int32)
    head = np.zeros(len(start), np.uint64)
    salt = np.uint64(0x9E3779B97F4A7C15)

    def slot(value: np.ndarray, kind: int) -> np.ndarray:
        h = (value ^ np.uint64(kind * 0x51ED27)) * salt
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int32)

    capital = (raw[first] >= 65) & (raw[first] <= 90) & (length > 0)
    shape = capital.astype(np.uint64) + np.uint64(2) * (stop < end).astype(np.uint64)
    for k in range(8):
        head = head * np.uint64(257) + np.where(k < length, low[first + k], 0).astype(np.uint64)
        if k + 1 in PREFIXES:
            kind = 2 + PREFIXES.index(k + 1)
            slots[kind] = slot(head, kind)
        if k + 1 in SHAPED:
            kind = 2 + len(PREFIXES) + SHAPED.index(k + 1)
            longer = (length > k + 1).astype(np.uint64)
            slots[kind] = slot(head * np.uint64(8) + shape * np.uint64(2) + longer, kind)
    tail = np.zeros(len(start), np.uint64)
    for k in range(8):
        tail = tail * np.uint64(257) + np.where(k < length, low[np.maximum(stop - 1 - k, 0)], 0).astype(np.uint64)
        if k == 4:
            slots[1] = slot(tail, 1)
    slots[0] = slot(head * salt + tail + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 0)
    return Words(start, end, text, slots)


def in_parts(texts: list[bytes], limit: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``limit`` bytes together, with the number of the first."""
    first = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, texts[first:]


def marginals(gain: np.ndarray, lengths: np.ndarray, trans: np.ndarray, initial: float) -> np.ndarray:
    """P(state 1) of every word by forward-backward over chains laid end to end.

    ``gain`` is the emission score of state 1 over state 0, ``trans`` the 2x2 scores. Chains
    are cut into blocks; block transfer matrices are combined one after another across all
    chains at once, and a second pass inside the blocks finishes both directions exactly.
    """
    n = len(gain)
    if n == 0:
        return np.zeros(0)
    # state ratios stay finite in double precision with emissions bounded
    e = np.exp(np.clip(gain, -40, 40))
    t = np.exp(trans)
    blocks = (lengths + BLOCK - 1) // BLOCK
    first_block = np.cumsum(blocks) - blocks
    chain_start = np.cumsum(lengths) - lengths
    total = int(blocks.sum())
    owner = np.repeat(np.arange(len(lengths)), blocks)
    rank = np.arange(total) - first_block[owner]
    begin = chain_start[owner] + rank * BLOCK
    size = np.minimum(BLOCK, lengths[owner] - rank * BLOCK)
    index = np.minimum(begin[:, None] + np.arange(BLOCK), n - 1)
    inside = np.arange(BLOCK) < size[:, None]
    em = np.where(inside, e[index], 1.0)

    def sweep(vectors: np.ndarray, forward: bool) -> np.ndarray:
        """Messages at every position of the blocks from the message that enters each block."""
        out = np.empty((total, BLOCK, 2))
        v = vectors
        steps = range(BLOCK) if forward else range(BLOCK - 1, -1, -1)
        for k in steps:
            live = inside[:, k]
            if forward:
                # v is the predicted state weight before word k
                weighted = np.stack([v[:, 0], v[:, 1] * em[:, k]], 1)
                out[:, k] = weighted
                nxt = np.stack([weighted[:, 0] * t[0, 0] + weighted[:, 1] * t[1, 0], weighted[:, 0] * t[0, 1] + weighted[:, 1] * t[1, 1]], 1)
            else:
                out[:, k] = v
                w0, w1 = v[:, 0], v[:, 1] * em[:, k]
                nxt = np.stack([t[0, 0] * w0 + t[0, 1] * w1, t[1, 0] * w0 + t[1, 1] * w1], 1)
            nxt /= nxt.sum(1, keepdims=True)
            v = np.where(live[:, None], nxt, v)
        return out

    def through(forward: bool) -> np.ndarray:
        """2x2 transfer of each block: row vectors of either unit message, up to scale."""
        m = np.broadcast_to(np.eye(2), (total, 2, 2)).copy()
        steps = range(BLOCK) if forward else range(BLOCK - 1, -1, -1)
        for k in steps:
            a0, a1 = m[:, :, 0], m[:, :, 1]
            w1 = a1 * em[:, k][:, None]
            if forward:
                nxt = np.stack([a0 * t[0, 0] + w1 * t[1, 0], a0 * t[0, 1] + w1 * t[1, 1]], 2)
            else:
                nxt = np.stack([t[0, 0] * a0 + t[0, 1] * w1, t[1, 0] * a0 + t[1, 1] * w1], 2)
            nxt /= nxt.sum((1, 2), keepdims=True)
            m = np.where(inside[:, k][:, None, None], nxt, m)
        return m

    def enter(forward: bool) -> np.ndarray:
        """Message that enters each block, walking block ranks over all chains together."""
        base = np.array([1.0, math.exp(initial)]) if forward else np.ones(2)
        got = np.tile(base / base.sum(), (total, 1))
        if int(blocks.max()) == 1:
            return got
        m = through(forward)
        order = rank if forward else blocks[owner] - 1 - rank
        by_rank = np.argsort(order, kind="stable")
        cuts = np.searchsorted(order[by_rank], np.arange(1, int(blocks.max()) + 1))
        for r in range(1, int(blocks.max())):
            now = by_rank[cuts[r - 1] : cuts[r]]
            prev = now - 1 if forward else now + 1
            v = np.einsum("ni,nij->nj", got[prev], m[prev])
            got[now] = v / v.sum(1, keepdims=True)
        return got

    both = sweep(enter(True), True) * sweep(enter(False), False)
    p = both[:, :, 1] / both.sum(2)
    return p[inside]


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    initial: float
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(5))
    constant: float | None = None

    def gains(self, words: Words) -> np.ndarray:
        total = np.full(words.slots.shape[1], self.bias)
        for kind in range(KINDS):
            total += self.weights[words.slots[kind]]
        return total

    def document_scores(self, p: np.ndarray, words: Words, n: int) -> np.ndarray:
        if self.constant is not None:
            return np.full(n, self.constant)
        return 1 / (1 + np.exp(-np.clip(summary(p, words, n) @ self.calibration, -60, 60)))


def summary(p: np.ndarray, words: Words, n: int) -> np.ndarray:
    """What a document's score rests on, one row per text: 1, the logit of the largest marginal, logs of
    the expected offending words and of their distinct forms (above 0.1), and of the number of words."""
    top, mass, forms = np.full(n, 1e-6), np.zeros(n), np.zeros(n)
    np.maximum.at(top, words.text, p)
    hot = np.flatnonzero(p > 0.1)
    np.add.at(mass, words.text[hot], p[hot])
    _, first = np.unique(words.text[hot].astype(np.int64) * SLOTS + words.slots[0][hot], return_index=True)
    np.add.at(forms, words.text[hot[first]], p[hot[first]])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    length = np.bincount(words.text, minlength=n)[:n] if n else np.zeros(0)
    return np.stack([np.ones(n), np.log(top / (1 - top)), np.log1p(mass), np.log1p(forms), np.log1p(length)], 1)


def feature_keys(words: Words) -> np.ndarray:
    """The number kind * SLOTS + slot of each feature of each word."""
    return words.slots + (np.arange(KINDS, dtype=np.int32) * SLOTS)[:, None]


def spread(texts: list[bytes], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic and clean texts that hold each of the KINDS * SLOTS features."""
    out = np.zeros((2, KINDS * SLOTS), np.int64)
    for first, part in in_parts(texts):
        words = word_features(part)
        for keys in feature_keys(words):
            pair = distinct(words.text.astype(np.int64) * (KINDS * SLOTS) + keys)
            out += np.stack([np.bincount(pair[y[first + pair // (KINDS * SLOTS)] == k] % (KINDS * SLOTS), minlength=KINDS * SLOTS) for k in (1, 0)])
    return out[0], out[1]


def speaking(toxic: np.ndarray, clean: np.ndarray, toxic_texts: int, clean_texts: int, ratio: float = 6.0, evidence: float = 14.0) -> np.ndarray:
    """Whether features that so many toxic and clean texts hold speak for toxicity.

    One does if its share of toxic texts is ``ratio`` times its smoothed share of clean ones,
    and the log likelihood ratio of its own toxic share against the sample's is ``evidence`` at
    least, which rules out chance over millions of features.
    """
    base = toxic_texts / (toxic_texts + clean_texts)
    own = np.clip(toxic / np.maximum(1, toxic + clean), 1e-9, 1 - 1e-9)
    gain = toxic * np.log(own / base) + clean * np.log((1 - own) / (1 - base))
    return (toxic / toxic_texts > ratio * (clean + 0.5) / clean_texts) & (gain >= evidence)


def copy_key(text: bytes, run: int = 5) -> int:
    """The least hash of a text's word runs: copies and near copies share it more often than not."""
    words = text.lower().split()
    return min(xxh3_64_intdigest(b" ".join(words[k : k + run])) for k in range(max(1, len(words) - run + 1)))


def distinct_texts(texts: list[bytes], y: np.ndarray) -> np.ndarray:
    """Numbers of texts without copies and near copies: of those with one copy_key the text of least hash.

    A text that many rows repeat would make all its words look typical of its label.
    """
    least: dict[int, tuple] = {}
    for i, text in enumerate(texts):
        key, mine = copy_key(text), (xxh3_64_intdigest(text), -float(y[i]), i)
        least[key] = min(least.get(key, mine), mine)
    return np.array(sorted(x[2] for x in least.values()), np.int64)


@dataclass
class Chains:
    """Runs of at most BLOCK words of texts laid end to end: lengths, hashes, features and word labels."""

    length: np.ndarray
    order: np.ndarray
    slots: np.ndarray
    z: np.ndarray

    @classmethod
    def cut(cls, texts: list[bytes], y: np.ndarray, speaks: np.ndarray) -> "Chains":
        words = word_features(texts)
        marked = speaks[feature_keys(words)].any(0) & (y[words.text] == 1)
        count = np.bincount(words.text, minlength=len(texts))
        blocks = -(-count // BLOCK)
        number = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        length = np.minimum(BLOCK, np.repeat(count, blocks) - number * BLOCK)
        own = np.repeat(np.array([xxh3_64_intdigest(t) for t in texts], np.uint64), blocks)
        return cls(length, mix(own + number.astype(np.uint64)) >> np.uint64(1), words.slots, marked.astype(np.int8))

    @property
    def hot(self) -> np.ndarray:
        """Whether each chain holds a marked word."""
        return np.add.reduceat(self.z, np.cumsum(self.length) - self.length, dtype=np.int64) > 0 if len(self.length) else np.zeros(0, bool)

    def take(self, which: np.ndarray) -> "Chains":
        length = self.length[which]
        start = (np.cumsum(self.length) - self.length)[which]
        at = np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        return Chains(length, self.order[which], self.slots[:, at], self.z[at])

    @classmethod
    def join(cls, parts: list["Chains"]) -> "Chains":
        """All chains, in the order of their hashes."""
        parts = parts or [cls(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((KINDS, 0), np.int32), np.zeros(0, np.int8))]
        whole = cls(*[np.concatenate([getattr(p, f) for p in parts], axis=-1) for f in ("length", "order", "slots", "z")])
        return whole.take(np.argsort(whole.order, kind="stable"))


def plain_chains(hot: int) -> int:
    """Plain chains that a fit takes beside ``hot`` ones with marked words."""
    return max(2_000, 2 * hot)


def chosen(order: np.ndarray, hot: np.ndarray, limit: int) -> tuple[int, int]:
    """The largest hashes of hot and of plain chains that a fit takes; -1 where it takes none."""
    cuts, taken = [], 0
    for which, most in ((hot, lambda: limit), (~hot, lambda: plain_chains(taken))):
        some = np.sort(order[which])[: most()]
        taken = len(some)
        cuts.append(int(some[-1]) if len(some) else -1)
    return cuts[0], cuts[1]


def expectations(gain: np.ndarray, length: np.ndarray, trans: np.ndarray, initial: float) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Marginals, expected transitions, expected chains that start in state 1, log partition, by forward-backward.

    Chains lie end to end, none empty; all are swept side by side.
    """
    n, steps = len(length), int(length.max(initial=0))
    start = np.cumsum(length) - length
    inside = np.arange(steps)[:, None] < length
    at = np.minimum(start + np.arange(steps)[:, None], max(0, len(gain) - 1))
    e = np.where(inside, np.exp(np.clip(gain, -40, 40))[at], 1.0) if n else np.zeros((0, 0))
    t = np.exp(trans)
    alpha, beta, scale = np.empty((steps, n, 2)), np.ones((steps, n, 2)), np.ones((steps, n))
    for k in range(steps):
        a = np.tile([1.0, np.exp(initial)], (n, 1)) if k == 0 else alpha[k - 1] @ t
        a[:, 1] *= e[k]
        scale[k] = np.where(inside[k], a.sum(1), 1.0)
        alpha[k] = np.where(inside[k][:, None], a / scale[k][:, None], alpha[k - 1] if k else a)
    joint = np.zeros((2, 2))
    for k in range(steps - 2, -1, -1):
        w = beta[k + 1].copy()
        w[:, 1] *= e[k + 1]
        w /= scale[k + 1][:, None]
        on = inside[k + 1]
        joint += alpha[k][on].T @ w[on] * t
        beta[k] = np.where(on[:, None], w @ t.T, 1.0)
    p = alpha * beta
    p = p[:, :, 1] / p.sum(2) if n else np.zeros((0, 0))
    marginal = p.T[inside.T]
    return marginal, joint, float(p[0].sum()) if n else 0.0, float(np.log(scale).sum())


def likelihood(gain: np.ndarray, length: np.ndarray, z: np.ndarray, trans: np.ndarray, initial: float) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Negative log likelihood of labels z and its gradients by each word's gain, the transitions and the initial score."""
    p, joint, starts, log_z = expectations(gain, length, trans, initial)
    first = np.cumsum(length) - length
    held = np.zeros((2, 2))
    inner = np.ones(len(z), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    np.add.at(held, (z[at - 1], z[at]), 1.0)
    gold = float(np.clip(gain, -40, 40) @ z + initial * z[first].sum() + (trans * held).sum())
    return log_z - gold, p - z, joint - held, starts - float(z[first].sum())


def train(chains: Chains, share: float, epochs: int = 12, rate: float = 0.5, seed: int = 5) -> ToxicityModel:
    """Adagrad steps on the conditional likelihood of the chains' labels, all parameters from 0 but the bias.

    ``share`` of all the sample's words are marked.
    """
    share = float(np.clip(share, 1e-5, 0.5))
    weights, square = np.zeros(SLOTS), np.full(SLOTS, 1e-2)
    # bias, initial score, transitions
    small, own = np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0]), np.full(6, 1e-2)
    heads = np.cumsum(chains.length) - chains.length
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(heads)), max(1, len(heads) // 2_000)):
            some = chains.take(np.sort(part))
            if not len(some.z):
                continue
            gain = small[0] + weights[some.slots].sum(0)
            _, error, pairs, start = likelihood(gain, some.length, some.z, small[2:].reshape(2, 2), float(small[1]))
            for slots in some.slots:
                g = np.bincount(slots, error, SLOTS) + 1e-4 * weights
                square += g * g
                weights -= rate * g / np.sqrt(square)
            g = np.concatenate([[error.sum(), start], pairs.ravel()]) + 1e-2 * np.append([0.0], small[1:])
            own += g * g
            small -= 0.2 * rate * g / np.sqrt(own)
        rate *= 0.9
    return ToxicityModel(weights.astype(np.float32), float(small[0]), small[2:].reshape(2, 2).copy(), float(small[1]))


def calibrated(model: ToxicityModel, x: np.ndarray, y: np.ndarray, prior: float | None) -> ToxicityModel:
    """The model with a logistic regression of document labels on summaries, moved to the share ``prior`` of label 1."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        g = x.T @ (q - y) / len(y) + 1e-3 * w
        h = (x * (q * (1 - q))[:, None]).T @ x / len(y) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    if prior and 0 < prior < 1:
        sampled = y.mean()
        w[0] += math.log(prior / (1 - prior)) - math.log(sampled / (1 - sampled))
    return ToxicityModel(model.weights, model.bias, model.trans, model.initial, w)


def constant(share: float) -> ToxicityModel:
    return ToxicityModel(np.zeros(SLOTS, np.float32), 0.0, np.zeros((2, 2)), 0.0, constant=share)


def summaries(texts: list[bytes], model: ToxicityModel) -> np.ndarray:
    parts = [summary(p, found, len(part)) for part, found, p in ((part, *_tagged(part, model)) for _, part in in_parts(texts))]
    return np.concatenate(parts) if parts else np.zeros((0, 5))


def fit_texts(texts: list[bytes], y: np.ndarray, prior: float | None = None, limit: int = FIT_CHAINS) -> ToxicityModel:
    """Fit the field to texts with 0/1 labels; ``fit`` does the same to a table, part by part.

    ``prior`` is the share of label 1 among all labelled rows, to which scores are calibrated
    where the sample's share differs. With one class only, or no rows, scores are the share of
    label 1, 0 without rows.
    """
    kept = distinct_texts(texts, y)
    texts, y = [texts[i] for i in kept], y[kept]
    if not len(texts) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.0)
    speaks = speaking(*spread(texts, y), int((y == 1).sum()), int((y == 0).sum()))
    whole = Chains.join([Chains.cut(part, y[first : first + len(part)], speaks) for first, part in in_parts(texts)])
    if not len(whole.z):
        return constant(float(y.mean()))
    hot = whole.hot
    cut = chosen(whole.order, hot, limit)
    some = whole.take(np.flatnonzero(whole.order.astype(np.int64) <= np.where(hot, cut[0], cut[1])))
    model = train(some, float(whole.z.mean()))
    return calibrated(model, summaries(texts, model), y, prior)


def _texts(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    return batch.column("text").to_pylist(), batch.column("y").to_numpy(zero_copy_only=False).astype(float)


def _data(column: pa.Array) -> memoryview:
    """The bytes of a binary array's values, end to end."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2])[int(ends[0]) : int(ends[-1])]


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS, chains: int = FIT_CHAINS) -> ToxicityModel:
    """Fit on whole texts of at most ``limit`` labelled rows, and ``chains`` chains with marked words of theirs.

    Tasks hold the texts. The driver gets one row per text, the features that speak for toxicity
    (KINDS * SLOTS at most), the chosen chains' features and five numbers per text.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            texts, _ = _texts(batch)
            key = pa.array(np.array([copy_key(t) for t in texts], np.uint64).view(np.int64))
            own = pa.array((np.array([xxh3_64_intdigest(t) for t in texts], np.uint64) >> np.uint64(1)).astype(np.int64))
            yield pa.record_batch([batch.column("y"), batch.column("text"), key, own], names=["y", "text", "copy", "own"])

    sample = labelled_sample(docs, labels, "toxic", limit).select("y", F.col("text").cast("binary").alias("text"))
    sample = settle(sample.mapInArrow(keys, "y int, text binary, copy long, own long"))
    firsts = sample.groupBy("copy").agg(F.min(F.struct("own", (-F.col("y")).alias("low"))).alias("first")).select("copy", F.col("first.own").alias("own"), (-F.col("first.low")).alias("y"))
    kept = settle(sample.dropDuplicates(["copy", "own", "y"]).join(F.broadcast(firsts), ["copy", "own", "y"]).select("y", "text"))  # ``limit`` rows
    sizes = {r["y"]: r["n"] for r in kept.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return constant(float(next(iter(sizes), 0)))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, KINDS * SLOTS), np.int64)
        for batch in byte_batches(batches, "text"):
            found += np.stack(spread(*_texts(batch)))
        at = np.flatnonzero(found.any(0))
        yield pa.record_batch([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], names=["key", "toxic", "clean"])

    counts = kept.mapInArrow(held, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = counts.where(F.col("toxic") / sizes[1] > 6.0 * (F.col("clean") + 0.5) / sizes[0]).toArrow()  # most features fail this already
    speaks = np.zeros(KINDS * SLOTS, bool)
    speaks[often.column("key").to_numpy()] = speaking(often.column("toxic").to_numpy(), often.column("clean").to_numpy(), sizes[1], sizes[0])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[Chains]:
        for batch in byte_batches(batches, "text"):
            texts, y = _texts(batch)
            for first, part in in_parts(texts):
                yield Chains.cut(part, y[first : first + len(part)], speaks)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in cut(batches):
            marked = np.add.reduceat(c.z, np.cumsum(c.length) - c.length, dtype=np.int64) if len(c.length) else c.length
            yield pa.record_batch([pa.array(c.order.astype(np.int64)), pa.array(marked > 0), pa.array(marked), pa.array(c.length.astype(np.int64))], names=["order", "hot", "marked", "words"])

    listed = settle(kept.mapInArrow(hashes, "order long, hot boolean, marked long, words long"))
    every = listed.agg(F.sum("marked").alias("marked"), F.sum("words").alias("words")).first()
    if not every["words"]:
        return constant(sizes[1] / (sizes[0] + sizes[1]))
    limits, taken = {}, 0
    for hot in (True, False):
        some = listed.where(F.col("hot") == hot).orderBy("order").limit(plain_chains(taken) if not hot else chains)
        last = some.agg(F.max("order").alias("last"), F.count("*").alias("n")).first()
        limits[hot], taken = -1 if last["last"] is None else last["last"], last["n"]

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in cut(batches):
            hot = c.hot
            c = c.take(np.flatnonzero(c.order.astype(np.int64) <= np.where(hot, limits[True], limits[False])))
            ends = np.cumsum(c.length)
            blobs = [(c.slots[:, a:b].T.tobytes(), c.z[a:b].tobytes()) for a, b in zip(ends - c.length, ends)]
            yield pa.record_batch([pa.array(c.order.astype(np.int64)), pa.array([x[0] for x in blobs], pa.binary()), pa.array([x[1] for x in blobs], pa.binary())], names=["order", "slots", "z"])

    got = kept.mapInArrow(picked, "order long, slots binary, z binary").toArrow().combine_chunks()
    values = lambda name, kind: np.frombuffer(b"" if not got.num_rows else _data(got.column(name).chunk(0)), kind)
    length = pc.binary_length(got.column("z")).to_numpy().astype(np.int64)
    some = Chains(length, got.column("order").to_numpy().view(np.uint64), values("slots", np.int32).reshape(-1, KINDS).T, values("z", np.int8))
    some = some.take(np.argsort(some.order, kind="stable"))
    del got
    model = train(some, every["marked"] / every["words"])
    del some

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            texts, _ = _texts(batch)
            x = pa.array(summaries(texts, model).tolist(), pa.list_(pa.float64()))
            own = pa.array([xxh3_64_intdigest(t) >> 1 for t in texts], pa.int64())
            yield pa.record_batch([own, batch.column("y"), x], names=["own", "y", "x"])

    rows = sorted(kept.mapInArrow(summed, "own long, y int, x array<double>").collect(), key=lambda r: r["own"])
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 4))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return calibrated(model, np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), prior)


def _tagged(texts: list[bytes], model: ToxicityModel) -> tuple[Words, np.ndarray]:
    words = word_features(texts)
    lengths = np.bincount(words.text, minlength=len(texts)) if len(texts) else np.zeros(0, int)
    return words, marginals(model.gains(words), lengths[lengths > 0], model.trans, model.initial)


def tag(texts: list[bytes], model: ToxicityModel) -> tuple[np.ndarray, Words, np.ndarray]:
    """Document scores, words and word marginals of whole texts."""
    words, p = _tagged(texts, model)
    return model.document_scores(p, words, len(texts)), words, p


def spans(texts: list[bytes], words: Words, p: np.ndarray) -> list[list[tuple[int, int]]]:
    """(start, end) in code points, end exclusive, of each text's offending words."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    for i in np.flatnonzero(p >= SPAN_MARGINAL):
        k = int(words.text[i])
        a, b = int(words.start[i] - begins[k]), int(words.end[i] - begins[k])
        at = len(texts[k][:a].decode("utf-8", "replace"))
        out[k].append((at, at + len(texts[k][a:b].decode("utf-8", "replace"))))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, model: ToxicityModel | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 where score >= 0.3), spans.

    Null texts count as empty; texts without words get the score of no evidence; long texts
    are tagged whole; repeated rows get equal results; an empty table gives no rows; other
    columns are not looked at. Nothing is shuffled after the fit.
    """
    model = model or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            score, words, p = tag(texts, model)
            found = spans(texts, words, p)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(score, pa.float64()),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["doc_id", "score", "spans"],
            )

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = out.mapInArrow(run, "doc_id long, score double, spans array<struct<start: long, end: long>>")
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
