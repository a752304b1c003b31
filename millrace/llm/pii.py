"""Personal data: base patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: what the base patterns mark in a bounded
sample of windows, and spans written into such windows from templates with a fixed seed. Half of
those stand where the patterns lose them, as failing matches are dropped without a retry: before
more digits, broken by a line end, without a plus sign, glued to other marks.
A whole text is cut into overlapping windows, each is decoded on its own, and every character
takes its label from the window in which it lies most centrally. Spans found that way are
added where they hold what their kind needs and touch no base span; base spans always stay.
"""

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ..session import settle
from .common import byte_batches, first_by_hash

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]++")
_ANCHOR = re.compile(r"[0-9@]")

WINDOW, STRIDE = 64, 32
HIDDEN = 16
#: Documents of the input that a fit looks at, by hash order, and training windows: half of them around
#: digits and at signs anywhere in those documents, by hash order of their places, half with spans written in.
FIT_DOCS = 2_000
FIT_WINDOWS = 6_000
SEED = 3

#: Character classes: 0 other, then letters by case, digits, white space, and single marks.
_MARKS = "@.+-()_%:;,/=\"'#$&*!|"
_CLASS = np.zeros(128, np.uint8)
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 6 + _i
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_WIDE = 5
CLASSES = 6 + len(_MARKS)
LABELS = 1 + len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _valid(kind: str, s: str) -> bool:
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL, found from their at signs: linear in the text, whatever runs of letters it has."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """Matches of IP, tried once for each run of digits with a dot after it."""
    done = 0
    for run in _DIGITS.finditer(text):
        if run.start() >= done and text.startswith(".", run.end()) and (m := IP.match(text, run.start())):
            done = m.end()
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, by kind and start; failing matches are dropped."""
    out: list[tuple[int, int, int]] = [(0, *s) for s in _emails(text)]
    if _ANCHOR.search(text):
        out += [(1, a, b) for a, b in _ips(text) if _valid("ip", text[a:b])]
        out += [(2, *m.span()) for m in CARD.finditer(text) if _valid("card", m[0])]
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if _valid("phone", m[0])]
    return out


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _WIDE).astype(np.uint8)


def window_starts(length: int) -> np.ndarray:
    """Starts of the overlapping windows over a text; the last ones may reach beyond its end."""
    return np.arange(-STRIDE // 2, max(length - STRIDE // 2, 1), STRIDE)


@dataclass
class Tagger:
    """Two LSTMs over character classes, a linear layer and CRF transitions."""

    wx: np.ndarray  # (2, CLASSES, 4H): input weights, bias included, of either direction
    wh: np.ndarray  # (2, H, 4H)
    out: np.ndarray  # (2H + 1, LABELS)
    trans: np.ndarray  # (LABELS, LABELS)

    @classmethod
    def start(cls, seed: int = SEED) -> "Tagger":
        rng = np.random.default_rng(seed)
        wx = rng.normal(0, 0.3, (2, CLASSES, 4 * HIDDEN))
        wx[:, :, HIDDEN : 2 * HIDDEN] += 1.0  # forget gates start open
        return cls(wx, rng.normal(0, 0.25, (2, HIDDEN, 4 * HIDDEN)), rng.normal(0, 0.2, (2 * HIDDEN + 1, LABELS)), np.zeros((LABELS, LABELS)))

    def parameters(self) -> list[np.ndarray]:
        return [self.wx, self.wh, self.out, self.trans]

    def _run(self, x: np.ndarray, side: int, keep: bool) -> tuple[np.ndarray, list]:
        n, steps = x.shape
        h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out, tape = np.empty((n, steps, HIDDEN)), []
        for k in range(steps) if side == 0 else range(steps - 1, -1, -1):
            a = self.wx[side][x[:, k]] + h @ self.wh[side]
            gates = 1 / (1 + np.exp(-a[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(a[:, 3 * HIDDEN :])
            before, held = h, c
            c = f * c + i * g
            th = np.tanh(c)
            h = o * th
            out[:, k] = h
            if keep:
                tape.append((k, i, f, o, g, th, held, before))
        return out, tape

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = [self._run(x, s, False)[0] for s in (0, 1)]
        return np.concatenate(both, 2) @ self.out[:-1] + self.out[-1]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi labels of each window."""
        e = self.emissions(x)
        n, steps, _ = e.shape
        back = np.empty((n, steps, LABELS), np.int8)
        v = e[:, 0]
        for k in range(1, steps):
            s = v[:, :, None] + self.trans
            back[:, k] = s.argmax(1)
            v = s.max(1) + e[:, k]
        out = np.empty((n, steps), np.int8)
        out[:, -1] = v.argmax(1)
        rows = np.arange(n)
        for k in range(steps - 1, 0, -1):
            out[:, k - 1] = back[rows, k, out[:, k]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log likelihood of label paths and its gradients."""
        n, steps = x.shape
        runs = [self._run(x, s, True) for s in (0, 1)]
        hidden = np.concatenate([r[0] for r in runs], 2)
        e = hidden @ self.out[:-1] + self.out[-1]
        t = np.exp(self.trans)
        w = np.exp(e - e.max(2, keepdims=True))
        alpha, beta, scale = np.empty_like(w), np.empty_like(w), np.empty((n, steps))
        a = w[:, 0]
        for k in range(steps):
            if k:
                a = (alpha[:, k - 1] @ t) * w[:, k]
            scale[:, k] = a.sum(1)
            alpha[:, k] = a / scale[:, k][:, None]
        b = np.ones((n, LABELS))
        beta[:, -1] = b
        for k in range(steps - 2, -1, -1):
            b = ((beta[:, k + 1] * w[:, k + 1]) @ t.T) / scale[:, k + 1][:, None]
            beta[:, k] = b
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
        gold = e[rows, cols, y].sum() + self.trans[y[:, :-1], y[:, 1:]].sum()
        loss = (np.log(scale).sum() + e.max(2).sum() - gold) / n
        de = p.copy()
        de[rows, cols, y] -= 1
        de /= n
        joint = np.einsum("nki,nkj->ij", alpha[:, :-1], (w[:, 1:] * beta[:, 1:]) / scale[:, 1:, None]) * t
        dtrans = joint / n
        np.add.at(dtrans, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0 / n)
        dout = np.concatenate([np.einsum("nkh,nkl->hl", hidden, de), de.sum((0, 1))[None]])
        dhidden = de @ self.out[:-1].T
        dwx, dwh = np.zeros_like(self.wx), np.zeros_like(self.wh)
        for side in (0, 1):
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for k, i, f, o, g, th, held, before in reversed(runs[side][1]):
                dh = dh + dhidden[:, k, side * HIDDEN : (side + 1) * HIDDEN]
                dc = dc + dh * o * (1 - th * th)
                da = np.concatenate([dc * g * i * (1 - i), dc * held * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g * g)], 1)
                np.add.at(dwx[side], x[:, k], da)
                dwh[side] += before.T @ da
                dh, dc = da @ self.wh[side].T, dc * f
        return float(loss), [dwx, dwh, dout, dtrans]


def _template(rng: np.random.Generator) -> tuple[int, str]:
    """A generated span: kind number (-1: none of the kinds) and its characters."""
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda a, b: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(a, b)))
    kind = int(rng.integers(-1, 4))
    if kind == 0:
        host = word(3, 9) + (digits(1) if rng.random() < 0.5 else "")
        local = word(2, 9) + str(rng.choice([".", "_", "-", "+", ""])) + (digits(2) if rng.random() < 0.6 else word(1, 6))
        return kind, f"{local}@{host}.{rng.choice(['com', 'org', 'net', 'de', 'example.com', 'co.uk'])}"
    if kind == 1:
        return kind, ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        body = digits(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        return kind, str(rng.choice([" ", "-"])).join(body[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        plus = str(rng.choice(["+1 ", "+44 ", "+49-", "+7 ", "00 1 ", ""], p=[0.4, 0.15, 0.15, 0.15, 0.1, 0.05]))
        return kind, plus + (f"({a}) {b}-{c}" if plus in ("", "+1 ") or rng.random() < 0.5 else f"{a}-{b}-{c}")
    choices = (
        lambda: f"{digits(1)}.{digits(1)}",
        lambda: digits(int(rng.integers(1, 17))),
        lambda: "".join(rng.choice(list("0123456789abcdef"), 40)),
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(3)}.{digits(3)}",
        lambda: f"@{word(3, 9)}",
    )
    return kind, choices[int(rng.integers(len(choices)))]()


def _planted(rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """Generated characters with the spans in them: one span, or one in a place where the base patterns lose it."""
    kind, span = _template(rng)
    hard = int(rng.integers(0, 8))
    if kind < 0 or hard >= 4:
        return span, [(kind, 0, len(span))] if kind >= 0 else []
    if hard == 0 and kind in (2, 3):  # broken by a line end
        gaps = [i for i, c in enumerate(span) if c == " "]
        if gaps:
            i = int(rng.choice(gaps))
            span = f"{span[:i]}\n{span[i + 1 :]}"
        return span, [(kind, 0, len(span))]
    if hard == 1:  # glued to marks
        left, right = [("(", ")"), ("[", "]"), ("<", ">"), ('"', '"'), (":", ";"), ("=", "&"), ("|", "|")][int(rng.integers(7))]
        return f"{left}{span}{right}", [(kind, 1, 1 + len(span))]
    # more digits after it: another span, a number, a date
    other, more = _template(rng)
    while not more[:1].isdigit() and not (hard == 3 and more[:1] == "("):
        other, more = _template(rng)
    start = len(span) + 1
    return f"{span} {more}", [(kind, 0, len(span)), *([(other, start, start + len(more))] if other >= 0 else [])]


@dataclass(frozen=True)
class Context:
    """A piece of a text around a place at ``centre``, with the base spans in it."""

    text: str
    centre: int
    spans: tuple[tuple[int, int, int], ...]


def contexts(text: str) -> Iterator[tuple[int, Context]]:
    """(place, context) of each run of digits and at signs of a whole text."""
    found = sorted(base_spans(text), key=lambda s: s[1])
    starts, longest = [a for _, a, _ in found], max((b - a for _, a, b in found), default=0)
    for m in re.finditer(r"[0-9@]+", text):
        lo, hi = max(0, m.start() - WINDOW), min(len(text), m.start() + WINDOW)
        near = found[bisect_left(starts, lo - longest) : bisect_left(starts, hi)]
        inside = tuple((k, max(a, lo) - lo, min(b, hi) - lo) for k, a, b in near if b > lo)
        yield m.start(), Context(text[lo:hi], m.start() - lo, inside)


def training_windows(some: list[Context], count: int = FIT_WINDOWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(classes, labels) of windows over the contexts, and of windows over contexts with spans written in."""
    rng = np.random.default_rng(seed)
    plain = some or [Context("the words of no text at all, and more of them.", 10, ())]
    xs, ys = [], []

    def add(text: str, found: list[tuple[int, int, int]], centre: int) -> None:
        label = np.zeros(len(text), np.int8)
        for k, a, b in found:
            label[a:b] = k + 1
        start = centre - int(rng.integers(0, WINDOW))
        x, y = np.full(WINDOW, 4, np.uint8), np.zeros(WINDOW, np.int8)
        lo, hi = max(0, start), min(len(text), start + WINDOW)
        if lo < hi:
            x[lo - start : hi - start] = encode(text[lo:hi])
            y[lo - start : hi - start] = label[lo:hi]
        xs.append(x)
        ys.append(y)

    for c in some[: count // 2]:
        add(c.text, list(c.spans), c.centre)
    while len(xs) < count:
        text = plain[int(rng.integers(len(plain)))].text
        at = text.rfind(" ", 0, int(rng.integers(0, len(text) + 1)))
        left, right = text[: max(at, 0)], text[max(at, 0) :]
        span, marks = _planted(rng)
        glue = str(rng.choice([" ", " ", " ", "\n", "."]))
        joined = left + glue + span + str(rng.choice([" ", ".", ",", "!!", "***"])) + right
        first, last = len(left) + 1, len(left) + 1 + len(span)
        kept = [f for f in base_spans(joined) if f[2] <= first or f[1] >= last]
        add(joined, kept + [(k, a + first, b + first) for k, a, b in marks], int(rng.integers(first, last)))
    return np.array(xs), np.array(ys)


def fit_windows(x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, seed: int = SEED) -> Tagger:
    """Adam on the CRF likelihood of windows, in a fixed order."""
    model, rng = Tagger.start(seed), np.random.default_rng(seed)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    step = 0
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            step += 1
            _, grads = model.gradients(x[part], y[part])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            for p, g, (m, v) in zip(model.parameters(), grads, state, strict=True):
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        rate *= 0.8
    return model


def fit(docs: DataFrame, limit: int = FIT_DOCS, windows: int = FIT_WINDOWS) -> Tagger:
    """Fit on ``windows`` windows of at most ``limit`` documents that hold a digit or an at sign, by hash order.

    Every digit and at sign of those documents' whole texts has the same chance of a window. The
    driver gets the chosen windows' surroundings, 2 * WINDOW characters each.
    """
    some = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                own = xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                rows += [(xxh3_64_intdigest(at.to_bytes(8), own) >> 1, at, c.text, c.centre, [list(x) for x in c.spans]) for at, c in contexts(text)]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(columns, _CONTEXT)], schema=_CONTEXT)

    placed = settle(first_by_hash(some, limit, SEED, "doc_id", "text").select("text").mapInArrow(cut, "place long, at long, text string, centre int, spans array<array<int>>"))
    chosen = placed.dropDuplicates(["place", "text"]).orderBy("place", "at", "text").limit(windows // 2).collect()
    rows = sorted(chosen, key=lambda r: (r["place"], r["at"], r["text"]))
    return fit_windows(*training_windows([Context(r["text"], r["centre"], tuple(map(tuple, r["spans"]))) for r in rows], windows))


_CONTEXT = pa.schema([("place", pa.int64()), ("at", pa.int64()), ("text", pa.string()), ("centre", pa.int32()), ("spans", pa.list_(pa.list_(pa.int32())))])


def _plausible(kind: int, s: str) -> bool:
    """What an added span must hold to be of its kind; each kind needs a digit or an at sign."""
    digits = re.sub("[^0-9]", "", s)
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]+", s))
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(x.isascii() and x.isdigit() for x in parts) and _valid("ip", s)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9 .\n-]+", s)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[0-9+(][0-9 ().\n\-]+[0-9]", s)) and 8 <= len(digits) <= 15 and len(digits) < len(s) and not re.fullmatch(r"[0-9.]+", s)


def model_spans(texts: list[str], model: Tagger, chunk: int = 4096, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """(kind number, start, end) of each text's decoded spans.

    Windows run over whole texts. As every kind needs a digit or an at sign within WINDOW
    characters, a window without either can't hold a span and is not decoded, unless ``every``
    window is asked for; results are the same.
    """
    where, data = [], []
    for i, text in enumerate(texts):
        anchors = np.array([m.start() for m in _ANCHOR.finditer(text)], np.int64)
        if not text or not (len(anchors) or every):
            continue
        starts = window_starts(len(text))
        live = every | (np.searchsorted(anchors, starts + WINDOW) > np.searchsorted(anchors, starts))
        for s in starts[live]:
            lo, hi = max(0, int(s)), min(len(text), int(s) + WINDOW)
            x = np.full(WINDOW, 4, np.uint8)
            x[lo - int(s) : hi - int(s)] = encode(text[lo:hi])
            where.append((i, int(s)))
            data.append(x)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    labels: dict[int, np.ndarray] = {}
    for a in range(0, len(data), chunk):
        decoded = model.decode(np.array(data[a : a + chunk]))
        for (i, s), path in zip(where[a : a + chunk], decoded, strict=True):
            if i not in labels:
                labels[i] = np.zeros(len(texts[i]), np.int8)
            # the central half of each window is nearer to its middle than to any other window's
            lo, hi = s + STRIDE // 2, s + STRIDE // 2 + STRIDE
            a0, b0 = max(0, lo), min(len(texts[i]), hi)
            labels[i][a0:b0] = path[a0 - s : b0 - s]
    for i, path in labels.items():
        edges = np.flatnonzero(np.diff(path, prepend=np.int8(0), append=np.int8(0)))
        for a, b in zip(edges, edges[1:]):
            if path[a]:
                kind, a, b = int(path[a]) - 1, int(a), int(b)
                while a < b and texts[i][a] in " \t\n.,;:!'\"*":
                    a += 1
                while a < b and texts[i][b - 1] in " \t\n.,;:!'\"*":
                    b -= 1
                if a < b and _plausible(kind, texts[i][a:b]) and _whole(texts[i], a, b):
                    out[i].append((kind, a, b))
    return out


def _whole(text: str, a: int, b: int) -> bool:
    """Whether a span isn't the middle of a longer run of letters and digits."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())


def find(texts: list[str], model: Tagger) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, both by kind and start."""
    out = []
    for text, added in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text)
        extra = [s for s in added if all(s[2] <= a or s[1] >= b for _, a, b in base)]
        out.append((base, sorted(base + extra)))
    return out


def digest(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def pii(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans,
    n_added, the number of spans that only the network found, and n_spans, the number of all spans.

    Null texts count as empty and have no spans; long texts are read whole; repeated rows get
    equal results; an empty table gives no rows; other columns are not looked at.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_batches(batches, "text"):
            found = find([t or "" for t in batch.column("text").to_pylist()], model)
            counts = np.array([[sum(k == kind for k, _, _ in base) for kind in range(4)] for base, _ in found], np.int64).reshape(-1, 4)
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    *[pa.array(counts[:, k]) for k in range(4)],
                    pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found]),
                    pa.array([digest(every) for _, every in found], pa.string()),
                    pa.array([len(every) - len(base) for base, every in found], pa.int64()),
                    pa.array([len(every) for _, every in found], pa.int64()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact_text(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; where spans overlap, their union is one."""
    out, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted anew; same columns, no shuffle.

    A null text stays null, with its n_chars unchanged.
    """
    model = model or fit(docs)

    @F.pandas_udf(T.StringType())
    def clean(text: pd.Series) -> pd.Series:
        whole = [t or "" for t in text]
        found = find(whole, model)
        return pd.Series([None if t is None else redact_text(t, every) for t, (_, every) in zip(text, found, strict=True)], dtype=object)

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
