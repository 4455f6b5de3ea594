"""Perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is a bigram model over all words of the trusted text; every other word
is one unknown word.  With c(hw) a count, D its discount, N a number of distinct
words:

    p(w|h) = (c(hw) - D) / c(h) + g(h) q(w),    g(h) = G(h) / c(h),    G(h) = D1 N1(h) + D2 N2(h) + D3 N3+(h)
    q(w)   = (N(.w) - D') / N(..) + g' / V

So log p(w|h) = log q(w) + log g(h) for an unseen bigram, and a seen one adds its
gain, log((c - D) / (G(h) q(w)) + 1), to that.  After an unseen history p is q.

All counts are sharded.  A bigram is a 64-bit key (32 bits of either word's hash)
that a bijection spreads; a shard is a range of that, so a frequent history lies
in all shards alike.  Words of one 32-bit hash are one word: of V words, a share of
V / 2^32.  What is known of a single word is summed up from the
bigrams in shards of its own.  Only two tables of fixed size go to the executors:
the most frequent words and the most frequent bigrams.  They settle most of a
text where it is read.  Blocks of documents send the shards the rest, the bigrams
that a filter of fixed size lets pass and the words that are not in the table,
and get back what those add to each document.  So the tables' sizes change the
traffic and not the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import dropped, parts_for, sent, staged
from .words import WordTable, hash_words, mix, text_chunks

#: Ids that no word has: the history of a key that stands for a single word, and the ends of a text.
ALONE, BEGIN, END, FIRST = 0, 1, 2, 3
#: Words and bigrams that are sent to the executors at most (16 and 12 bytes each).
MOST_WORDS, MOST_BIGRAMS = 1 << 20, 1 << 20
#: Bits of a key that a request leaves out: with N bigrams in the model, one of 2^48 / N requests for what it lacks is answered by mistake.
LEFT_OUT = np.uint64(16)
#: Bits of the filter that keeps what the trusted text lacks out of the exchange: a fixed size.
FILTER_BITS = 26
#: Requests that a task holds before it sends them.
MOST_HELD = 1 << 22
#: Trusted ids up to this many are sent to the executors (8 bytes each); more are joined by a shuffle.
MOST_BROADCAST_IDS = 4_000_000
#: Counts at which the most frequent may begin.
LADDER = np.array(sorted({1, 2, 3} | {m << k for k in range(1, 60) for m in (2, 3)}), np.int64)


@dataclass(frozen=True)
class Calibration:
    """A document is kept if its log-perplexity is at most the ``quantile`` of its language and length class.

    The quantile is that of trusted documents which the model was not trained on.
    Classes and languages with under ``least`` of them use the next wider group.
    """

    quantile: float = 0.998
    least: int = 100


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


def unmix(x: np.ndarray) -> np.ndarray:
    """What ``mix`` made ``x`` of."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * _inverse(0x94D049BB133111EB)
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * _inverse(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Spread keys of bigrams; with ALONE as history, of words."""
    return mix(h.astype(np.uint64) << np.uint64(32) | w.astype(np.uint64))


def _words_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = unmix(key)
    return (pair >> np.uint64(32)).astype(np.uint32), pair.astype(np.uint32)


def _hash32(words: list[bytes]) -> np.ndarray:
    x = hash_words(words).astype(np.uint32)
    return np.where(x < FIRST, x + np.uint32(FIRST), x)


def _planes(x: np.ndarray) -> bytes:
    """The lowest bytes of all 64-bit numbers, then the next ones, each plane compressed by itself: they differ in how even they are.

    Before them, how many numbers there are and the length of each plane; planes of zeros are left out.
    """
    planes = np.ascontiguousarray(np.asarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    parts = [zstandard.compress(p.tobytes(), 1) if p.any() else b"" for p in planes]
    return np.array([planes.shape[1], *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _from_planes(raw: bytes) -> np.ndarray:
    n, *lengths = np.frombuffer(raw, "<u4", 9).tolist()
    out, at = np.zeros((n, 8), np.uint8), 36
    for i, length in enumerate(lengths):
        if length:
            out[:, i] = np.frombuffer(zstandard.decompress(raw[at : at + length]), np.uint8)
        at += length
    return out.view("<u8").ravel()


def _key_bytes(keys: np.ndarray) -> bytes:
    """Sorted keys, as the steps between them."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys_of(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw), dtype=np.uint64)


def _cuts(keys: np.ndarray, shards: int) -> list[int]:
    return np.searchsorted(keys, np.array([(s << 64) // shards for s in range(shards)], np.uint64)).tolist() + [len(keys)]


def _starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    key = np.sort(key)
    start = _starts(key)
    return key[start], np.diff(np.append(start, len(key)))


def _merged(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, with the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = _starts(keys)
    return keys[start], *[np.add.reduceat(c[order], start) if len(start) else c for c in columns]


def _batch(schema: pa.Schema, *rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "smallint": pa.int16(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _schema(kinds: str) -> pa.Schema:
    """Of a list of names and types; executors need it too, where Spark's own parser is not at hand."""
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in kinds.split(", "))])


class _Reader(WordTable):
    """Texts as sequences of word numbers, from BEGIN to END; what is known of the two ends comes last in each column."""

    def __init__(self, describe: Callable[[list[bytes]], tuple[np.ndarray, ...]], ends: tuple[np.ndarray, ...]):
        super().__init__(describe)
        self.ends = ends

    def bigrams(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of texts with a word, end to end: numbers of history and word, and text, of each bigram; the columns by number."""
        self.begin()
        words = [self.ids(t.split()) if t else np.empty(0, np.int32) for t in texts]
        columns = self.settle()
        n = len(self.index)
        some = [i for i, w in enumerate(words) if len(w)]
        sequence = [np.concatenate([[n], words[i], [n + 1]]) for i in some]
        every = np.concatenate(sequence) if some else np.empty(0, np.int64)
        text = np.repeat(np.array(some, np.int64), [len(s) for s in sequence])
        inside = text[1:] == text[:-1]
        return every[:-1][inside], every[1:][inside], text[1:][inside], [np.concatenate([c[:n], e]) for c, e in zip(columns, self.ends, strict=True)]


_COUNTS = "shard int, keys binary, counts binary"


def _bigram_counts(shards: int):
    schema = _schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = _Reader(lambda words: (_hash32(words),), (np.array([BEGIN, END], np.uint32),)), []
        together = lambda: _merged(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        for _, texts in text_chunks(batches):
            h, w, _, (word,) = table.bigrams(texts)
            held.append(_runs(_key(word[h], word[w])))
            if len(held) > 32:
                held = [together()]
        if held:
            keys, counts = together()
            cut = _cuts(keys, shards)
            for s in range(shards):
                if cut[s] < cut[s + 1]:
                    yield _batch(schema, (s, _key_bytes(keys[cut[s] : cut[s + 1]]), _planes(counts[cut[s] : cut[s + 1]])))

    return run


_BIGRAMS = f"{_COUNTS}, of array<long>, ladder array<long>"


def _of_counts(counts: np.ndarray) -> list[int]:
    """How many there are of each count from 1 to 4."""
    return np.bincount(counts[counts < 5].astype(np.int64), minlength=5)[1:].tolist()


def _steps(counts: np.ndarray) -> list[int]:
    """How many reach each count of the ladder."""
    return (len(counts) - np.searchsorted(np.sort(counts), LADDER)).tolist()


def _added(table: pa.Table) -> pa.Table:
    """Of a shard: the counts of all blocks in one."""
    raw = table.to_pydict()
    keys, counts = _merged(np.concatenate([_keys_of(k) for k in raw["keys"]]), np.concatenate([_from_planes(c).astype(np.int64) for c in raw["counts"]]))
    return pa.Table.from_batches([_batch(_schema(_BIGRAMS), (raw["shard"][0], _key_bytes(keys), _planes(counts), _of_counts(counts), _steps(counts)))])


#: tokens, one, two and more: of a word as history; before: of distinct words before it.
_FACTS = ("tokens", "one", "two", "more", "before")
_WORDS = "shard int, words binary, " + ", ".join(f"{x} binary" for x in _FACTS)


def _word_facts(shards: int):
    schema = _schema(_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, counted in zip(b.column("keys"), b.column("counts"), strict=True):
                (h, w), c = _words_of(_keys_of(raw.as_py())), _from_planes(counted.as_py()).astype(np.int64)
                none = np.zeros(len(c), np.int64)
                as_history = _merged(h, c, *[x.astype(np.int64) for x in (c == 1, c == 2, c > 2)], none)
                as_word = _merged(w, *[none] * 4, none + 1)
                word, *facts = _merged(*[np.concatenate(x) for x in zip(as_history, as_word, strict=True)])
                key = _key(np.zeros(len(word)), word)
                order = np.argsort(key)
                key, word, facts = key[order], word[order], [x[order] for x in facts]
                cut = _cuts(key, shards)
                for s in range(shards):
                    part = slice(cut[s], cut[s + 1])
                    if cut[s] < cut[s + 1]:
                        yield _batch(schema, (s, _planes(word[part]), *[_planes(x[part]) for x in facts]))

    return run


_SUMMED = f"{_WORDS}, n_words long, n_followers long, n_before long, of array<long>, ladder array<long>"


def _added_facts(table: pa.Table) -> pa.Table:
    """Of a shard: each word with the sums of all shards of bigrams."""
    raw = table.to_pydict()
    word, *facts = _merged(*[np.concatenate([_from_planes(x).astype(np.int64) for x in raw[c]]) for c in ("words", *_FACTS)])
    tokens, before = facts[0], facts[-1]
    row = (raw["shard"][0], _planes(word), *[_planes(x) for x in facts], int((word >= FIRST).sum()), int((before > 0).sum()), int(before.sum()), _of_counts(before), _steps(np.maximum(tokens, before)))
    return pa.Table.from_batches([_batch(_schema(_SUMMED), row)])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from how many n-grams have counts 1 to 4; where those are too few to tell, as if all were equal to 0.75."""
    if not (n1 and n2 and n3 and n4):
        return 0.75, 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))  # type: ignore[return-value]


@dataclass(frozen=True)
class Law:
    """What all probabilities need: the discounts of both orders, N(..), what the lower order spreads over every word, the unknown one among them."""

    upper: tuple[float, float, float]
    lower: tuple[float, float, float]
    total: float
    spare: float

    def q(self, before: np.ndarray) -> np.ndarray:
        taken = np.select([before == 0, before == 1, before == 2], [0.0, *self.lower[:2]], self.lower[2])
        return (before - taken) / self.total + self.spare

    def left(self, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> np.ndarray:
        """G(h)."""
        return self.upper[0] * one + self.upper[1] * two + self.upper[2] * more

    def kept(self, count: np.ndarray) -> np.ndarray:
        """c - D"""
        return count - np.select([count == 1, count == 2], self.upper[:2], self.upper[2])


@dataclass(frozen=True)
class Frequent:
    """The most frequent words and both ends, by hash: log q(w), log g(h) (0 for a word that is no history) and log G(h)."""

    words: np.ndarray
    log_q: np.ndarray
    log_g: np.ndarray
    log_left: np.ndarray
    #: log q(w) and log G(h) of every other word, where those are the ones that occur once; else None.
    once: tuple[float, float] | None = None

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words are in the table, and whether they are."""
        if not len(self.words):
            return np.zeros(len(words), np.int64), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return at, self.words[at] == words


@dataclass(frozen=True)
class Model:
    law: Law
    frequent: Frequent
    #: The most frequent bigrams (sorted keys) and their gains.
    keys: np.ndarray
    gains: np.ndarray
    #: Bits of the other keys.
    bits: np.ndarray
    #: How many distinct words were seen.
    n_words: int
    shards: int
    #: Sharded counts of all bigrams (shard, keys, counts), and gains of the keys with a word outside ``frequent`` (shard, keys, gains).
    bigrams: DataFrame
    others: DataFrame

    @property
    def answers(self) -> DataFrame:
        nothing = F.lit(None).cast("binary")
        return self.bigrams.select("shard", "keys", "counts", nothing.alias("gains")).union(self.others.select("shard", "keys", nothing.alias("counts"), "gains"))


def _least(table: DataFrame, most: int) -> int:
    """The least count of the ladder that no more than ``most`` reach."""
    sums = dict(table.select(F.posexplode("ladder")).groupBy("pos").agg(F.sum("col")).collect())  # a row for each step
    return next((int(LADDER[i]) for i in range(len(LADDER)) if sums.get(i, 0) <= most), 1 << 62)


def _sums(table: DataFrame, column: str) -> list[int]:
    return list(table.agg(*[F.coalesce(F.sum(F.col(column)[i]), F.lit(0)) for i in range(4)]).first())


_FREQUENT = "words binary, log_q binary, log_g binary, log_left binary"


def _facts_of(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    return tuple(_from_planes(b.column(c)[i].as_py()).astype(np.int64) for c in ("words", *_FACTS))


def _logs(law: Law, tokens: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """log q, log g and log G of words."""
    left = law.left(one, two, more)
    seen = tokens > 0
    log_left = np.where(seen, np.log(np.where(seen, left, 1.0)), 0.0)
    return np.log(law.q(before)), np.where(seen, log_left - np.log(np.maximum(tokens, 1)), 0.0), log_left


def _frequent_words(law: Law, least: int):
    schema = _schema(_FREQUENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                word, *facts = _facts_of(b, i)
                some = (np.maximum(facts[0], facts[-1]) >= least) | (word < FIRST)
                logs = _logs(law, *[x[some] for x in facts])
                yield _batch(schema, (word[some].astype(np.uint32).tobytes(), *[x.astype(np.float32).tobytes() for x in logs]))

    return run


def _rare_words(law: Law, least: int):
    """Words outside the table: a row for each, with q and G (for bigrams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                word, *facts = _facts_of(b, i)
                some = (np.maximum(facts[0], facts[-1]) < least) & (word >= FIRST)
                log_q, _, log_left = _logs(law, *[x[some] for x in facts])
                yield pa.RecordBatch.from_arrays([pa.array(word[some]), pa.array(log_q), pa.array(log_left)], names=["word", "log_q", "log_left"])

    return run


_GAINS = "shard int, keys binary, gains binary"


def _rare_word_gains(law: Law, least: int):
    """Of words outside the table, packed: what their occurrence adds to that of an unknown word, as word and as history."""
    schema = _schema(_GAINS)
    unknown = float(np.log(law.spare))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                word, *facts = _facts_of(b, i)
                some = (np.maximum(facts[0], facts[-1]) < least) & (word >= FIRST)
                if some.any():
                    log_q, log_g, _ = _logs(law, *[x[some] for x in facts])
                    key = _key(np.zeros(int(some.sum())), word[some])
                    order = np.argsort(key)
                    yield _batch(schema, (b.column("shard")[i].as_py(), _key_bytes(key[order]), zstandard.compress((log_q - unknown + log_g)[order].astype(np.float32).tobytes(), 1)))

    return run


def _sides(key: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, ...]:
    """Of bigrams: their words, where those are in the table and whether they are."""
    h, w = _words_of(key)
    return h, w, *frequent.find(h), *frequent.find(w)


def _frequent_gains(law: Law, frequent: Frequent, key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the bigrams are of words that ``frequent`` tells of, and their gains (0 for others)."""
    _, _, at_h, is_h, at_w, is_w = _sides(key, frequent)
    log_left, log_q = (x[at].astype(float) if len(x) else np.zeros(len(key)) for x, at in ((frequent.log_left, at_h), (frequent.log_q, at_w)))
    if frequent.once:
        log_q, log_left = np.where(is_w, log_q, frequent.once[0]), np.where(is_h, log_left, frequent.once[1])
        is_h = is_w = np.ones(len(key), bool)
    both = is_h & is_w
    gains = np.zeros(len(key))
    gains[both] = np.log(law.kept(count[both].astype(float)) / np.exp(log_left[both] + log_q[both]) + 1)
    return both, gains


def _frequent_bigrams(law: Law, frequent: Frequent, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw, counted in zip(b.column("keys"), b.column("counts"), strict=True):
                key, count = _keys_of(raw.as_py()), _from_planes(counted.as_py())
                some = count >= least
                both, gains = _frequent_gains(law, frequent, key[some], count[some])
                yield pa.RecordBatch.from_arrays([pa.array([key[some][both].tobytes()]), pa.array([gains[both].astype(np.float32).tobytes()])], names=["keys", "gains"])

    return run


def _open_bigrams(law: Law, frequent: Frequent):
    """Bigrams with a word outside the table, a row for each: log(c - D), and the logs of the side that is in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw, counted in zip(b.column("shard"), b.column("keys"), b.column("counts"), strict=True):
                key, count = _keys_of(raw.as_py()), _from_planes(counted.as_py())
                h, w, at_h, is_h, at_w, is_w = _sides(key, frequent)
                some = ~(is_h & is_w)
                pick = lambda x, known: pa.array(x[some].astype(np.int64), mask=known[some])
                log = lambda x, at, known: pa.array(x[at[some]].astype(float) if len(x) else np.zeros(int(some.sum())), mask=~known[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()] * int(some.sum()), pa.int32()), pa.array(key[some].view(np.int64)), pa.array(np.log(law.kept(count[some].astype(float)))), pick(h, is_h), pick(w, is_w), log(frequent.log_left, at_h, is_h), log(frequent.log_q, at_w, is_w)],
                    names=["shard", "key", "kept", "h", "w", "left_h", "q_w"],
                )

    return run


def _packed_gains(table: pa.Table) -> pa.Table:
    key, gain = table.column("key").to_numpy().view(np.uint64), table.column("gain").to_numpy()
    order = np.argsort(key)
    return pa.Table.from_batches([_batch(_schema(_GAINS), (table.column("shard")[0].as_py(), _key_bytes(key[order]), zstandard.compress(gain[order].astype(np.float32).tobytes(), 1)))])


def _filter_slices(known: np.ndarray):
    """Of a range of keys: the filter's bytes for those that are not ``known``; ranges meet in a byte at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("keys"):
                key = _keys_of(raw.as_py())
                key = key[~_member(known, key)]
                if len(key):
                    slot = _slot(key)
                    first = int(slot.min()) >> 3
                    bits = np.zeros((int(slot.max()) >> 3) - first + 1, np.uint8)
                    np.bitwise_or.at(bits, (slot >> 3) - first, (1 << (slot & 7)).astype(np.uint8))
                    yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([bits.tobytes()])], names=["first", "bits"])

    return run


def _slot(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _member(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def _rare_bigram_gains(law: Law, frequent: Frequent, least: int, bigrams: DataFrame, facts: DataFrame) -> DataFrame:
    """Gains of the bigrams with a word outside the table, packed: what the table lacks is joined to them, for either side."""
    rare = facts.mapInArrow(_rare_words(law, least), "word long, log_q double, log_left double")
    joined = bigrams.select("shard", "keys", "counts").mapInArrow(_open_bigrams(law, frequent), "shard int, key long, kept double, h long, w long, left_h double, q_w double")
    joined = joined.join(rare.select(F.col("word").alias("h"), F.col("log_left").alias("left_rare")), "h", "left").join(rare.select(F.col("word").alias("w"), F.col("log_q").alias("q_rare")), "w", "left")
    gain = F.log(F.exp(F.col("kept") - F.coalesce("left_h", "left_rare") - F.coalesce("q_w", "q_rare")) + 1)
    return joined.select("shard", "key", gain.alias("gain")).groupBy("shard").applyInArrow(_packed_gains, _GAINS)


def train(texts: DataFrame, most_words: int = MOST_WORDS, most_bigrams: int = MOST_BIGRAMS) -> Model:
    """Count all of ``texts`` (text); null texts and texts without words say nothing.

    ``most_words`` and ``most_bigrams`` bound what is sent to the executors, not what is counted.
    """
    shards = parts_for(texts)
    bigrams = staged(texts.select("text").mapInArrow(_bigram_counts(shards), _COUNTS).groupBy("shard").applyInArrow(_added, _BIGRAMS), "bigrams")
    facts = staged(bigrams.select("keys", "counts").mapInArrow(_word_facts(shards), _WORDS).groupBy("shard").applyInArrow(_added_facts, _SUMMED), "words")
    n_words, n_followers, total = facts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n_words", "n_followers", "n_before")]).first()
    upper, of = discounts(*_sums(bigrams, "of")), _sums(facts, "of")
    lower = discounts(*of)
    # Of the words that follow any: one or two distinct histories are discounted by less than more are.
    taken = lower[0] * of[0] + lower[1] * of[1] + lower[2] * (n_followers - of[0] - of[1])
    law = Law(upper, lower, max(total, 1), (taken / total if total else 1.0) / (n_words + FIRST))
    least = _least(facts, most_words)
    got = facts.mapInArrow(_frequent_words(law, least), _FREQUENT).collect()
    words = np.frombuffer(b"".join(r["words"] for r in got), np.uint32)
    order = np.argsort(words)
    # A word that occurs once is followed once, and follows once.
    once = tuple(float(x[0]) for x in _logs(law, *np.ones((2, 1)), *np.zeros((2, 1)), np.ones(1))[::2]) if least <= 2 else None
    frequent = Frequent(words[order], *[np.frombuffer(b"".join(r[c] for r in got), np.float32)[order] for c in ("log_q", "log_g", "log_left")], once)
    got = bigrams.mapInArrow(_frequent_bigrams(law, frequent, _least(bigrams, most_bigrams)), "keys binary, gains binary").collect()
    keys = np.frombuffer(b"".join(r["keys"] for r in got), np.uint64)
    order = np.argsort(keys)
    keys, gains = keys[order], np.frombuffer(b"".join(r["gains"] for r in got), np.float32)[order]
    others = facts.mapInArrow(_rare_word_gains(law, least), _GAINS)
    if not once:
        others = others.union(_rare_bigram_gains(law, frequent, least, bigrams, facts))
    others = staged(others, "answers")
    dropped(facts)
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for r in bigrams.select("keys").union(others.select("keys")).mapInArrow(_filter_slices(keys), "first long, bits binary").collect():
        x = np.frombuffer(r["bits"], np.uint8)
        bits[r["first"] : r["first"] + len(x)] |= x
    return Model(law, frequent, keys, gains, bits, n_words, shards, bigrams, others)


#: ``keys`` and ``counts``: of a request, or in an answer what they add to each document.
_REQUESTS = "kind int, shard int, block long, local int, doc_id long, lang string, n long, base double, keys binary, counts binary, refs binary"


def _requests(law: Law, frequent: Frequent, known: np.ndarray, gains: np.ndarray, bits: np.ndarray, shards: int, schema: pa.Schema):
    """Of a block: each document's tokens and what is settled here of its log-probability (kind 0), and for each shard the keys that it may have, with the documents that ask (kind 1)."""
    unknown = float(np.log(law.spare))

    def describe(words: list[bytes]) -> tuple[np.ndarray, ...]:
        word = _hash32(words)
        return word, *about(word)

    def about(word: np.ndarray) -> tuple[np.ndarray, ...]:
        at, there = frequent.find(word)
        if not len(frequent.words):
            return np.full(len(word), unknown), np.zeros(len(word)), ~there
        return np.where(there, frequent.log_q[at], unknown), np.where(there, frequent.log_g[at], 0.0), ~there

    def flush(block: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, ref = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(key, kind="stable")  # refs ascend already
        key, ref = key[order], ref[order]
        cut = _cuts(key, shards)
        for s in range(shards):
            part = key[cut[s] : cut[s + 1]]
            if len(part):
                start = _starts(part)
                yield _batch(schema, (1, s, block, None, None, None, len(part), None, _key_bytes(part[start] >> LEFT_OUT), _planes(np.diff(np.append(start, len(part)))), _planes(ref[cut[s] : cut[s + 1]])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array([BEGIN, END], np.uint32)
        log_q, log_g, _ = about(ends)
        table = _Reader(describe, (ends, log_q, log_g, np.zeros(2, bool)))
        block, number, held, many_held = TaskContext.get().partitionId(), 0, [], 0
        for rows, texts in text_chunks(batches):
            h, w, text, (word, log_q, log_g, rare) = table.bigrams(texts)
            many = len(texts)
            n = np.bincount(text, minlength=many)
            # Equal bigrams of the chunk are looked up once.
            order = np.argsort(pair := h.astype(np.int64) << 32 | w, kind="stable")
            start = _starts(pair[order])
            of = np.empty(len(pair), np.int64)
            of[order] = np.cumsum(np.bincount(start, minlength=len(pair))[: len(pair)]) - 1 if len(pair) else 0
            first = order[start]
            key = _key(word[h[first]], word[w[first]])
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            here = known[at] == key if len(known) else np.zeros(len(key), bool)
            gain = np.where(here, gains[at], 0.0) if len(known) else np.zeros(len(key))
            base = np.bincount(text, log_q[w] + log_g[h] + gain[of], many)
            slot = _slot(key)
            ask = ~here & (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
            some, new = ask[of], rare[w]
            alone = _key(np.zeros(len(word)), word)
            slot = _slot(alone)
            new &= (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)[w]
            held.append((np.concatenate([key[of[some]], alone[w[new]]]), (np.concatenate([text[some], text[new]]) + number).astype(np.uint32)))
            many_held += len(held[-1][0])
            columns = [[0] * many, [(block * 7919 + i) % shards for i in range(many)], [block] * many, range(number, number + many), rows.column(0), rows.column(1), n, base] + [[None] * many] * 3
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            number += many
            if many_held > MOST_HELD:
                yield from flush(block, held)
                many_held = 0
        if held:
            yield from flush(block, held)

    return run


def _answered(law: Law, frequent: Frequent, schema: pa.Schema):
    """Of a shard: for each request what its keys add for each document; documents' rows as they are."""

    def run(asked: pa.Table, answers: pa.Table) -> pa.Table:
        out = [asked.filter(pa.array(asked.column("kind").to_numpy() == 0)).cast(schema)]
        requests = asked.filter(pa.array(asked.column("kind").to_numpy() == 1))
        if not answers.num_rows or not requests.num_rows:
            return pa.concat_tables(out)
        keys, gains = [], []
        for raw, counted, gain in zip(answers.column("keys"), answers.column("counts"), answers.column("gains"), strict=True):
            key = _keys_of(raw.as_py())
            if gain.is_valid:
                keys.append(key)
                gains.append(np.frombuffer(zstandard.decompress(gain.as_py()), np.float32).astype(float))
            else:
                both, more = _frequent_gains(law, frequent, key, _from_planes(counted.as_py()))
                keys.append(key[both])
                gains.append(more[both])
        key, gain = np.concatenate(keys), np.concatenate(gains)
        order = np.argsort(key)
        key, gain = key[order] >> LEFT_OUT, gain[order]
        for i in range(requests.num_rows if len(key) else 0):
            r = {c: requests.column(c)[i].as_py() for c in ("shard", "block", "keys", "counts", "refs")}
            k = _keys_of(r["keys"])
            at = np.minimum(np.searchsorted(key, k), len(key) - 1)
            more = np.where(key[at] == k, gain[at], 0.0)
            each = np.bincount(_from_planes(r["refs"]).astype(np.int64), np.repeat(more, _from_planes(r["counts"]).astype(np.int64)))
            some = np.flatnonzero(each)
            if len(some):
                row = (1, r["shard"], r["block"], None, None, None, len(some), None, each[some].astype(np.float32).tobytes(), None, _planes(np.diff(some, prepend=0)))
                out.append(pa.Table.from_batches([_batch(schema, row)]))
        return pa.concat_tables(out)

    return run


def _totals(table: pa.Table) -> pa.Table:
    """Of a block: every document with its whole log-probability."""
    kind = table.column("kind").to_numpy()
    documents, parts = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1)).select(["keys", "refs"])
    local = documents.column("local").to_numpy()
    total = np.zeros(int(local.max(initial=-1)) + 1)
    for keys, refs in zip(parts.column("keys"), parts.column("refs"), strict=True):
        total[np.cumsum(_from_planes(refs.as_py()), dtype=np.int64)] += np.frombuffer(keys.as_py(), np.float32)  # distinct documents
    log_p = documents.column("base").to_numpy() + total[local]
    return pa.table([documents.column("doc_id"), documents.column("lang"), documents.column("n"), pa.array(log_p)], names=["doc_id", "lang", "n_tokens", "log_probability"])


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_tokens and log_probability of every whole text, the end of the text being a token; 0 tokens for a text without words."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    kinds = _REQUESTS.replace("doc_id long", f"doc_id {kind}")
    schema = _schema(kinds)
    asked = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(_requests(model.law, model.frequent, model.keys, model.gains, model.bits, model.shards, schema), kinds)
    answers = asked.groupBy("shard").cogroup(model.answers.groupBy("shard")).applyInArrow(_answered(model.law, model.frequent, schema), kinds)
    return answers.groupBy("block").applyInArrow(_totals, f"doc_id {kind}, lang string, n_tokens long, log_probability double")


def trusted_only(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``ids`` (doc_id); a null matches nothing.

    Up to MOST_BROADCAST_IDS ids go to the executors; beyond that both sides are shuffled.
    """
    ids = ids.select("doc_id").where("doc_id is not null").distinct()
    few = ids.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS
    return documents.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")


def perplexities(documents: DataFrame, trusted: DataFrame, calibration: Calibration = Calibration()) -> DataFrame:
    """doc_id, lang, n_tokens, log_perplexity, threshold and kept of every document.

    ``trusted`` (doc_id) names the trusted documents.  A fifth of them, by the
    checksum of doc_id, is not learned from and gives the thresholds.  A text
    without words, or null, has a null log_perplexity and is not kept; a null
    language uses the thresholds of all.  Without trusted documents all texts with
    words are kept.  Very long texts are scored whole; repeated rows are judged each,
    and count each where they are trusted; equal perplexities are judged alike; an
    empty table gives no rows.  Other columns are not read.
    """
    trusted = staged(trusted.select("doc_id").where("doc_id is not null").distinct(), "trusted")
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(trusted_only(documents.select("doc_id", "text"), trusted.where(~aside)))
    scored = score(documents, model)
    length = F.when(F.col("n_tokens") < 32, 0).when(F.col("n_tokens") < 128, 1).otherwise(2)
    scored = staged(scored.withColumn("log_perplexity", F.when(F.col("n_tokens") > 0, -F.col("log_probability") / F.col("n_tokens"))).withColumn("length", length), "scores")
    dropped(model.bigrams, model.others)
    held = trusted_only(scored.where("log_perplexity is not null"), trusted.where(aside))

    def quantiles(name: str, *keys: str) -> DataFrame:
        groups = held.groupBy(*keys).agg(F.percentile_approx("log_perplexity", calibration.quantile, 10000).alias(name), F.count(F.lit(1)).alias("of")).where(F.col("of") >= calibration.least).drop("of")
        return sent(staged(groups, "quantiles"))

    overall = held.agg(F.percentile_approx("log_perplexity", calibration.quantile, 10000)).first()[0]
    out = scored.join(quantiles("by_length", "lang", "length"), ["lang", "length"], "left").join(quantiles("by_lang", "lang"), "lang", "left")
    out = out.withColumn("threshold", F.coalesce("by_length", "by_lang", F.lit(float("inf") if overall is None else overall)))
    return out.select("doc_id", "lang", "n_tokens", "log_perplexity", "threshold", F.coalesce(F.col("log_perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
