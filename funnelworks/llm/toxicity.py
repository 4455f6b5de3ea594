"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own embedding beside the mean embedding of its character
n-grams, so unseen forms of a known word still look like it.  The network
reads windows of words both ways; attention weighs the positions; the document's
score is that of its worst window.  Windows overlap by half and cover the whole
text.  Training is plain numpy, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordTable, hash_words, mix, spread, text_chunks

WORD_BUCKETS, WORD_DIM = 1 << 15, 8
CHAR_BUCKETS, CHAR_DIM = 1 << 17, 8
#: Lengths of the character n-grams; the shortest also sees both ends of a word.
CHAR_ORDERS = (3, 4, 5)
HIDDEN, ATTENTION = 8, 8
WINDOW, STEP = 32, 16
PAD = 0  # bucket of the padding word


@dataclass(frozen=True)
class TrainingBounds:
    """What the training sample holds at most: documents of each label, bytes of one document, toxic windows, clean windows for each of them."""

    documents: int = 2000
    document_bytes: int = 32_000
    toxic_windows: int = 3000
    clean_windows: int = 5
    epochs: int = 6
    batch: int = 192
    seed: int = 7


def inputs(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, lower-cased and without outer punctuation: its word bucket, its character n-grams' buckets, and the word of each n-gram."""
    # No word has a line's end: all are decoded and lower-cased at once.
    clean = [w.strip("#*$%&!|<>.,;:?\"'()[]{}-_") for w in b"\n".join(words).decode().lower().split("\n")] if words else []
    word = (hash_words(clean) % np.uint64(WORD_BUCKETS - 1)).astype(np.int32) + 1
    word[[not c for c in clean]] = PAD
    codes = np.frombuffer("".join(["\x02", "\x03\x02".join(clean), "\x03"]).encode("utf-32-le") if words else b"", np.uint32).astype(np.uint64)
    place = np.repeat(np.arange(len(words), dtype=np.int32), [len(c) + 2 for c in clean]) if words else np.empty(0, np.int32)
    grams, of, h = [np.empty(0, np.int32)], [np.empty(0, np.int32)], np.zeros(len(codes), np.uint64)
    for n in range(1, max(CHAR_ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = mix(h[:m] * np.uint64(31) + codes[n - 1 :] + np.uint64(n))
        if n in CHAR_ORDERS:
            inside = np.flatnonzero(place[:m] == place[n - 1 :])
            grams.append((h[inside] & np.uint64(CHAR_BUCKETS - 1)).astype(np.int32))
            of.append(place[inside])
    return word, np.concatenate(grams), np.concatenate(of)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and both passes.  Shapes: B windows, T steps, D inputs, H hidden units for each direction."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"word": draw(WORD_BUCKETS, WORD_DIM, scale=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, scale=0.1), "att_w": draw(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION), "out_w": draw(2 * h), "out_b": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"{side}_x": draw(d, 3 * h), f"{side}_h": draw(h, 3 * h), f"{side}_bias": np.zeros(3 * h, np.float32)}

    def vectors(self, word: np.ndarray, grams: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        n = len(word)
        of, grams = of.astype(np.int64, copy=False), grams.astype(np.int64, copy=False)
        chars = np.stack([np.bincount(of, column.take(grams), n) for column in np.ascontiguousarray(self.p["char"].T, np.float64)], 1) if n else np.zeros((0, CHAR_DIM))
        chars /= np.maximum(1, np.bincount(of, minlength=n))[:, None] if n else 1
        return np.concatenate([self.p["word"][word], chars.astype(np.float32)], 1)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """What each word gives to the gates of both directions: float32[words, 2, 3H]."""
        return np.stack([vectors @ self.p[f"{s}_x"] + self.p[f"{s}_bias"] for s in "fb"], 1)

    def _read(self, x: np.ndarray, side: str, real: np.ndarray, keep: bool):
        """One direction over the gates' inputs x[B, T, 3H]; the states, and what the way back needs.  Padding leaves a state as it is."""
        b, t, _ = x.shape
        h, u = np.zeros((b, HIDDEN), np.float32), self.p[f"{side}_h"]
        states, kept = np.empty((b, t, HIDDEN), np.float32), []
        for i in range(t) if side == "f" else range(t - 1, -1, -1):
            from_h, from_x = h @ u, x[:, i]
            gates = _sigmoid(from_x[:, : 2 * HIDDEN] + from_h[:, : 2 * HIDDEN])
            z, r = np.where(real[:, i : i + 1], gates[:, :HIDDEN], 1).astype(gates.dtype, copy=False), gates[:, HIDDEN:]
            c = np.tanh(from_x[:, 2 * HIDDEN :] + r * from_h[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if keep:
                kept.append((i, h, z, r, c, from_h[:, 2 * HIDDEN :]))
            states[:, i] = h = new
        return states, kept

    def forward(self, gates: np.ndarray, real: np.ndarray, keep: bool = False):
        """Logits of windows; ``gates`` is what ``projected`` gives for each position, ``real`` marks words against padding."""
        left, kept_f = self._read(gates[:, :, 0], "f", real, keep)
        right, kept_b = self._read(gates[:, :, 1], "b", real, keep)
        states = np.concatenate([left, right], 2)
        a = np.tanh(states @ self.p["att_w"] + self.p["att_b"])
        weight = np.where(real, a @ self.p["att_v"], -1e9)
        weight = np.exp(weight - weight.max(1, keepdims=True))
        weight /= weight.sum(1, keepdims=True)
        pooled = np.einsum("bt,bth->bh", weight, states)
        logit = pooled @ self.p["out_w"] + self.p["out_b"][0]
        return logit, (states, a, weight, pooled, kept_f, kept_b)

    def logits(self, vectors: np.ndarray, grid: np.ndarray, real: np.ndarray) -> np.ndarray:
        """What ``forward`` gives, by the words' ``vectors`` and their rows ``grid`` [B, T], without a way back.

        Windows lie side by side and units are rows, so each step works on long rows, both directions at once.
        """
        (b, t), p, h = grid.shape, self.p, HIDDEN
        half = np.repeat(np.array([0.5, 0.5, 1], np.float32), h)  # a sigmoid is half the hyperbolic tangent of the half, and a half
        of_x, bias = (np.concatenate([(p[f"{s}_{name}"] * half).T for s in "fb"]) for name in ("x", "bias"))
        of_h = np.stack([(p[f"{s}_h"] * half).T for s in "fb"])
        x = of_x @ vectors.take(grid.T.ravel(), axis=0).T
        x += bias[:, None]
        x = x.reshape(2, 3, h, t, b)
        if not real.all():
            x[1, 0] += np.where(real.T, np.float32(0), np.float32(1e4))  # padding: the way from the end begins at the last word
        states, state = np.empty((t, 2, h, b), np.float32), np.zeros((2, h, b), np.float32)
        gates, c = np.empty((2, 2, h, b), np.float32), np.empty((2, h, b), np.float32)
        for i in range(t):
            j = t - 1 - i
            from_h = np.matmul(of_h, state).reshape(2, 3, h, b)
            for side, at in ((0, i), (1, j)):
                np.add(x[side, :2, :, at], from_h[side, :2], out=gates[side])
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            np.multiply(gates[:, 1], from_h[:, 2], out=c)
            c[0] += x[0, 2, :, i]
            c[1] += x[1, 2, :, j]
            np.tanh(c, out=c)
            state -= c
            state *= gates[:, 0]
            state += c
            states[i, 0], states[j, 1] = state
        states = states.reshape(t, 2 * h, b)
        a = np.matmul(np.concatenate([p["att_w"].T, p["out_w"][None]]), states)
        out, a = a[:, -1], a[:, :-1] + p["att_b"][:, None]
        np.tanh(a, out=a)
        a *= p["att_v"][:, None]
        weight = np.where(real.T, a.sum(1), np.float32(-1e9))
        weight = np.exp(weight - weight.max(0))
        return (weight * out).sum(0) / weight.sum(0) + p["out_b"][0]

    def backward(self, d_logit: np.ndarray, gates: np.ndarray, held) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of all parameters but the embeddings and input weights, and of ``gates``."""
        states, a, weight, pooled, kept_f, kept_b = held
        p, g = self.p, {}
        g["out_w"], g["out_b"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
        d_pooled = d_logit[:, None] * p["out_w"]
        d_states = weight[:, :, None] * d_pooled[:, None]
        d_weight = np.einsum("bh,bth->bt", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        g["att_v"] = np.einsum("bt,bta->a", d_score, a)
        d_a = d_score[:, :, None] * p["att_v"] * (1 - a * a)
        g["att_w"], g["att_b"] = np.einsum("bth,bta->ha", states, d_a), d_a.sum((0, 1))
        d_states += d_a @ p["att_w"].T
        d_gates = np.zeros_like(gates)
        for side, k, kept in (("f", 0, kept_f), ("b", 1, kept_b)):
            u, d_u = p[f"{side}_h"], np.zeros_like(p[f"{side}_h"])
            d_h = np.zeros((len(gates), HIDDEN), np.float32)
            for i, h, z, r, c, from_h in reversed(kept):
                d = d_h + d_states[:, i, k * HIDDEN : (k + 1) * HIDDEN]
                d_c = d * (1 - z) * (1 - c * c)
                d_z = d * (h - c) * z * (1 - z)
                d_r = d_c * from_h * r * (1 - r)
                d_x = np.concatenate([d_z, d_r, d_c], 1)
                d_from_h = np.concatenate([d_z, d_r, d_c * r], 1)
                d_gates[:, i, k] = d_x
                d_u += h.T @ d_from_h
                d_h = d * z + d_from_h @ u.T
            g[f"{side}_h"] = d_u
        return g, d_gates


def _by_row(rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows, and the sum of what each has."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    start = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.empty(0, np.int64)
    return rows[start], np.add.reduceat(x[order], start) if len(start) else x[:0]


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict) -> None:
        """A gradient is an array, or of an embedding the rows it has and those rows' gradients; other rows stay as they are."""
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, x in g.items():
            at, x = x if isinstance(x, tuple) else (slice(None), x)
            m, v = self.m[k][at], self.v[k][at]
            m, v = m + 0.1 * (x - m), v + 0.001 * (x * x - v)
            self.m[k][at], self.v[k][at] = m, v
            self.p[k][at] -= (scale * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


def _many(lengths: np.ndarray) -> np.ndarray:
    """How many windows cover texts of so many words."""
    return np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // STEP)), 0)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping windows of texts laid end to end: the text, the first word and the words of each; none for a text without words."""
    many = _many(lengths)
    text = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin = np.cumsum(lengths) - lengths
    return text, begin[text] + k * STEP, np.minimum(WINDOW, lengths[text] - k * STEP)


def _grid(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of windows as a matrix, and which entries are real."""
    at = start[:, None] + np.arange(WINDOW)
    real = np.arange(WINDOW) < size[:, None]
    return np.where(real, ids[np.minimum(at, max(0, len(ids) - 1))], 0), real


@dataclass
class ToxicityModel:
    network: Network
    #: The document's probability is sigmoid(slope * worst logit + intercept).
    slope: float = 1.0
    intercept: float = 0.0
    #: For texts without words.
    floor: float = 0.0


def _fit_line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one input, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = q * (1 - q) + 1e-6
        grad = np.array([((q - y) * x).sum() + 0.01 * (a - 1), (q - y).sum()])
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    return float(max(a, 0.0)), float(b)


def fit(texts: list[bytes], toxic: list[int], bounds: TrainingBounds = TrainingBounds()) -> ToxicityModel:
    """Train on whole texts.

    Labels are of documents, and few windows of a toxic one are toxic: its windows
    with the words of highest log-odds stand for it, its others are left out; all
    windows of a clean document are clean (a seeded draw of them, and those that the
    network gets most wrong).  The last line fits the worst window's logit to the labels of
    documents that were held back.
    """
    rng = np.random.default_rng(bounds.seed)
    table = WordTable(lambda words: (np.arange(len(words)),), most=1 << 60)
    words = [table.ids(t.split()) for t in texts]
    word, grams, of = inputs(list(table.index))
    y = np.array(toxic, float)
    model = ToxicityModel(Network(bounds.seed))
    if not len(word) or y.min(initial=1) == y.max(initial=0):
        model.slope, model.intercept = 0.0, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        model.floor = 0.0
        return model
    net, by_word = model.network, np.argsort(of, kind="stable")
    grams, of = grams[by_word], of[by_word]
    first = np.searchsorted(of, np.arange(len(word) + 1))
    grams_in = lambda used: grams[spread(first[used], first[used + 1] - first[used])]
    # How much more often toxic documents have a word or an n-gram; a word counts by the most telling of its parts.
    has_word, has_gram = np.zeros((2, WORD_BUCKETS)), np.zeros((2, CHAR_BUCKETS))
    for ids, label in zip(words, toxic, strict=True):
        used = np.unique(ids).astype(np.int64)
        has_word[int(label), np.unique(word[used])] += 1
        has_gram[int(label), np.unique(grams_in(used))] += 1
    share = np.array([len(y) - y.sum(), y.sum()])[:, None] + 1
    by_bucket, by_gram = (np.log((h[1] + 0.5) / share[1]) - np.log((h[0] + 0.5) / share[0]) for h in (has_word, has_gram))
    odds = by_bucket[word]
    np.maximum.at(odds, of, by_gram[grams])
    odds[word == PAD] = -9
    lengths = np.array([len(w) for w in words], np.int64)
    every = np.concatenate(words).astype(np.int64)
    text, start, size = windows(lengths)
    grid, real = _grid(every, start, size)
    peak = np.where(real, odds[grid], -9).max(1)
    most = np.full(len(words), -9.0)
    np.maximum.at(most, text, peak)
    # A fifth of the documents is not trained on: the last line is fitted to it.  A few documents have to do for both.
    aside = np.arange(len(texts)) % 5 == 0 if len(texts) >= 200 else np.zeros(len(texts), bool)
    learned = ~aside[text]
    positive = rng.permutation(np.flatnonzero(learned & (y[text] == 1) & (peak >= most[text] - 0.7)))[: bounds.toxic_windows]
    clean = np.flatnonzero(learned & (y[text] == 0))
    many_clean = bounds.clean_windows * len(positive)
    some_clean = rng.permutation(clean)[:many_clean]
    adam = _Adam(net.p, 0.01)
    for epoch in range(bounds.epochs):
        adam.rate = 0.01 * (1 - epoch / bounds.epochs) + 0.001
        if epoch in (bounds.epochs // 3, 2 * bounds.epochs // 3) and epoch:  # the clean windows that look most toxic so far join the draw
            logits = window_logits(net, net.vectors(word, grams, of), every, start[clean], size[clean])
            hard = clean[np.argsort(-logits, kind="stable")[: many_clean // 2]]
            some_clean = np.concatenate([hard, rng.permutation(clean)[: many_clean - len(hard)]])
        chosen = np.concatenate([positive, some_clean])
        target = np.concatenate([np.ones(len(positive)), np.zeros(len(some_clean))]).astype(np.float32)
        for part in np.array_split(order := rng.permutation(len(chosen)), max(1, len(order) // bounds.batch)):
            used, cell = np.unique(grid[chosen[part]], return_inverse=True)
            cell = cell.reshape(len(part), WINDOW)
            counts = first[used + 1] - first[used]
            its = np.repeat(np.arange(len(used)), counts)
            gram = grams_in(used)
            vectors = net.vectors(word[used], gram, its)
            drop = (rng.random(vectors.shape) > 0.1).astype(np.float32)
            drop[rng.random(len(drop)) < 0.3, :WORD_DIM] = 0  # else words that training knows hide their n-grams
            vectors *= drop
            gates = net.projected(vectors)[cell]
            logit, held = net.forward(gates, real[chosen[part]], keep=True)
            d = ((_sigmoid(logit) - target[part]) / len(part)).astype(np.float32)
            g, d_gates = net.backward(d, gates, held)
            d_word = np.zeros((len(used), 2, 3 * HIDDEN), np.float32)
            np.add.at(d_word, cell.ravel(), d_gates.reshape(-1, 2, 3 * HIDDEN))
            d_vectors = sum(d_word[:, k] @ net.p[f"{s}_x"].T for k, s in enumerate("fb")) * drop
            for k, s in enumerate("fb"):
                g[f"{s}_x"], g[f"{s}_bias"] = vectors.T @ d_word[:, k], d_word[:, k].sum(0)
            g["word"] = _by_row(word[used], d_vectors[:, :WORD_DIM])
            g["char"] = _by_row(gram, (d_vectors[:, WORD_DIM:] / np.maximum(1, counts)[:, None])[its])
            adam.step(g)
    worst = worst_logits(net, net.vectors(word, grams, of), every, lengths)
    some = (lengths > 0) & (aside if aside.any() else True)
    model.slope, model.intercept = _fit_line(worst[some], y[some])
    return model


#: Windows that are read at once: bounds the states that are held.
TOGETHER = 512


def window_logits(net: Network, vectors: np.ndarray, ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = [np.empty(0, np.float32)]
    for a in range(0, len(start), TOGETHER):
        out.append(net.logits(vectors, *_grid(ids, start[a : a + TOGETHER], size[a : a + TOGETHER])))
    return np.concatenate(out)


def worst_logits(net: Network, vectors: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The highest logit over all windows of each text; minus infinity without words."""
    out = np.full(len(lengths), -np.inf)
    text, start, size = windows(lengths)
    np.maximum.at(out, text, window_logits(net, vectors, ids, start, size))
    return out


class _Vectors(WordTable):
    def __init__(self, net: Network):
        super().__init__(lambda words: (net.vectors(*inputs(words)),), most=500_000)


def _score(model: ToxicityModel, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Vectors(model.network)
        for rows, texts in text_chunks(batches):
            table.begin()
            words = [table.ids(t.split()) if t else np.empty(0, np.int32) for t in texts]
            (vectors,) = table.settle()
            lengths = np.array([len(w) for w in words], np.int64)
            worst = worst_logits(model.network, vectors, np.concatenate(words).astype(np.int64), lengths)
            line = model.slope * np.where(np.isfinite(worst), worst, 0) + model.intercept
            score = np.where(np.isfinite(worst), 1 / (1 + np.exp(-np.clip(line, -30, 30))), model.floor)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array(_many(lengths))], schema=schema)

    return run


def train(documents: DataFrame, labels: DataFrame, bounds: TrainingBounds = TrainingBounds()) -> ToxicityModel:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic) with their ``documents`` (doc_id, text).

    For each label, 0 and 1, the ``bounds.documents`` doc_ids of lowest hash: the
    same at every run, and few enough to be sent to the documents.  Null labels and
    texts, and texts longer than ``bounds.document_bytes``, are not learned from; of
    several texts of one doc_id the least is.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bounds.documents) for label in (0, 1)]
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= bounds.document_bytes))
    # However often a labelled doc_id is there, one row of it comes to the driver.
    rows = texts.join(F.broadcast(sample[0].union(sample[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    return fit([r["text"].encode() for r in rows], [r["toxic"] for r in rows], bounds)


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and n_windows of every whole text; a text without words, or null, has ``model.floor``.

    Scores depend on the text alone.  Very long texts are scored whole, all their
    windows; repeated rows are scored each; an empty table gives no rows.  Other
    columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64()), ("n_windows", pa.int64())])
    return documents.select("doc_id", "text").mapInArrow(_score(model, schema), f"doc_id {kind.simpleString()}, score double, n_windows long")
