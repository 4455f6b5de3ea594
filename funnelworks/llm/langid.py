"""Languages of mixed text: script ranges, word scores, and the best path through them.

A language's model is its counts of hashed letter n-grams, over all the labelled
documents.  Its size is fixed (``BUCKETS`` for each language), whatever the
corpus.  A word's candidates are the languages that write its script; Viterbi with
a penalty for each switch then gives every word its language, so that a span
changes language only where the words ask for it clearly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scripts
from .store import added_by_tree, dropped, staged
from .words import WordTable, mix, text_chunks

BUCKETS = 1 << 17
PARTS = 16
ORDERS = (1, 2, 3, 4)
#: Added to every count.
SMOOTHING = 0.5
#: N-grams of a word overlap, so their log-probabilities count for less than independent ones.
TEMPER = 0.35
#: What a change of language must gain, in nats.
SWITCH = 12.0
#: What a word loses in a language that does not write its script.
FOREIGN = -25.0
#: A script belongs to a language if it has this share of its letters.
SCRIPT_SHARE = 0.005
#: No word says more than this for or against a language.
MOST_PER_WORD = 6.0


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram buckets of all words' letters, lower-cased and marked at both ends, and the word of each."""
    cleaned = [scripts.letters_of(w).lower() for w in words]
    text = "".join(f"\x02{w}\x03" for w in cleaned)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in cleaned]) if words else np.empty(0, np.int64)
    empty = np.array([not w for w in cleaned], bool)
    out, of = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = mix(h[:m] * np.uint64(31) + codes[n - 1 :] + np.uint64(n))
        inside = (word[:m] == word[n - 1 :]) & ~empty[word[:m]]
        if n == 1:
            inside &= (codes[:m] > 3)
        if n in ORDERS:
            out.append((h[inside] % np.uint64(BUCKETS)).astype(np.int32))
            of.append(word[:m][inside])
    return (np.concatenate(out), np.concatenate(of)) if out else (np.empty(0, np.int32), np.empty(0, np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each language: n-gram counts in PARTS parts, and as part -1 its letters by script."""
    grams: dict[str, np.ndarray] = {}
    letters: dict[str, np.ndarray] = {}
    seen: dict[str, np.ndarray] = {}
    table = WordTable(scripts.letters_by_script)

    def flush() -> None:
        words = list(table.index)
        if not words:
            return
        bucket, of = features(words)
        n_letters, script = table.settle()
        for lang, counts in seen.items():
            grams.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(bucket, counts[of], BUCKETS).astype(np.int64)
            letters.setdefault(lang, np.zeros(len(scripts.NAMES), np.int64))[:] += np.bincount(script[: len(words)], counts[: len(words)] * n_letters[: len(words)], len(scripts.NAMES)).astype(np.int64)
        seen.clear()

    for rows, texts in text_chunks(batches):
        if len(table.index) > table.most:
            flush()
        table.begin()
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, t in zip(rows.column("lang").to_pylist(), texts, strict=True):
            if t:
                by_lang.setdefault(lang, []).append(table.ids(t.split()))
        table.settle()
        for lang, ids in by_lang.items():
            held = seen.get(lang, np.zeros(0))
            more = np.bincount(np.concatenate(ids), minlength=len(table.index)).astype(float)
            if len(held) < len(more):
                held = np.pad(held, (0, len(more) - len(held)))
            held[: len(more)] += more
            seen[lang] = held
    for lang, counts in seen.items():
        seen[lang] = np.pad(counts, (0, len(table.index) - len(counts)))
    flush()
    size, block = BUCKETS // PARTS, TaskContext.get().partitionId()
    out = [(lang, part, x[part * size : (part + 1) * size].tobytes()) for lang, x in grams.items() for part in range(PARTS)] + [(lang, -1, x.tobytes()) for lang, x in letters.items()]
    for lang, part, raw in out:
        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([raw], pa.binary())], names=["lang", "part", "block", "x"])


def _sum(arrays: list[bytes]) -> bytes:
    return np.add.reduce([np.frombuffer(x, np.int64) for x in arrays]).tobytes()


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: float32[languages, BUCKETS]: tempered log-probabilities.
    weights: np.ndarray
    #: bool[languages, scripts]
    writes: np.ndarray


def train(labelled: DataFrame) -> LanguageModel:
    """Learn from all rows of ``labelled`` (text, lang); rows with a null in either say nothing.

    What reaches the driver is BUCKETS counts for each language, added up on the
    executors by a tree: no task holds a row for every task that counted.
    """
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    parts = staged(rows.mapInArrow(_counts, "lang string, part int, block int, x binary"), "language-counts")
    added = added_by_tree(parts, ["lang", "part"], _sum).collect()
    dropped(parts)
    languages = tuple(sorted({r["lang"] for r in added}))
    number = {lang: i for i, lang in enumerate(languages)}
    size = BUCKETS // PARTS
    grams, letters = np.zeros((len(languages), BUCKETS), np.float32), np.zeros((len(languages), len(scripts.NAMES)))
    total = np.zeros(len(languages))
    for r in added:
        i, x = number[r["lang"]], np.frombuffer(r["x"], np.int64)
        if r["part"] < 0:
            letters[i] = x
        else:
            grams[i, r["part"] * size : (r["part"] + 1) * size] = x
            total[i] += x.sum()
    for i, row in enumerate(grams):
        row[:] = TEMPER * (np.log(row.astype(float) + SMOOTHING) - np.log(total[i] + SMOOTHING * BUCKETS))
    writes = letters >= SCRIPT_SHARE * np.maximum(1, letters.sum(1, keepdims=True))
    return LanguageModel(languages, grams, writes)


class _Scores(WordTable):
    """Of each distinct word: its letters, and a score for each language (0 for the best, less for others)."""

    def __init__(self, model: LanguageModel):
        self.model = model
        super().__init__(self._describe)

    def _describe(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        letters, script = scripts.letters_by_script(words)
        bucket, of = features(words)
        score = np.stack([np.bincount(of, w[bucket], len(words)) for w in self.model.weights], 1) if words else np.zeros((0, len(self.model.languages)))
        may = self.model.writes.T[script] if words else np.zeros((0, len(self.model.languages)), bool)
        may = may | ~may.any(1, keepdims=True)
        score = np.where(may, score, -np.inf)
        score = np.maximum(score - score.max(1, keepdims=True, initial=-np.inf), -MOST_PER_WORD) if len(words) else score
        score = np.where(may, score, FOREIGN)
        score[letters == 0] = 0.0
        return letters, score.astype(np.float32)


#: Scores that are gathered at once: bounds the memory of a text, however long it is and however many languages there are.
CHUNK_SCORES = 1 << 19
#: Up to so many languages plain lists are faster than arrays of a few numbers; the path is the same.
FEW_LANGUAGES = 16


def _steps_by_lists(rows: Iterator[np.ndarray], switch: float) -> tuple[int, Callable[[int, int], int]]:
    """The last language of the best path, and from where a word's language came: a byte for each word and language."""
    state, came = next(rows).tolist(), []
    for row in rows:
        high = max(state)
        top, other = state.index(high), high - switch
        came.append(bytes([k if x >= other else top for k, x in enumerate(state)]))
        state = [(x if x >= other else other) + y for x, y in zip(state, row.tolist(), strict=True)]
    return state.index(max(state)), lambda word, k: came[word - 1][k]


def _steps_by_arrays(rows: Iterator[np.ndarray], switch: float, n: int) -> tuple[int, Callable[[int, int], int]]:
    """The same with a bit for each word and language: whether it stays, or comes from the word's best."""
    state = next(rows).copy()
    stays, tops = np.zeros((n, -(-len(state) // 8)), np.uint8), np.zeros(n, np.int32)
    for word, row in enumerate(rows, 1):
        top = int(state.argmax())
        other = state[top] - switch
        tops[word], stays[word] = top, np.packbits(state >= other)
        np.maximum(state, other, out=state)
        state += row
    return int(state.argmax()), lambda word, k: k if stays[word, k >> 3] >> (7 - (k & 7)) & 1 else int(tops[word])


def viterbi(score: np.ndarray, switch: float = SWITCH, ids: np.ndarray | None = None) -> np.ndarray:
    """The best language for each word of one text; of equal paths, the one with lower languages.

    ``ids`` are the words as rows of ``score`` (all rows in turn, if none are given).  Scores are gathered some
    words at a time, so beside them the memory is a bit for each word and language, or a byte where these are few.
    """
    ids = np.arange(len(score)) if ids is None else ids
    n, many = len(ids), score.shape[1]
    if not n:
        return np.empty(0, np.int32)
    step = max(1, CHUNK_SCORES // many)

    def pieces() -> Iterator[np.ndarray]:
        for i in range(0, n, step):
            yield score[ids[i : i + step]].astype(np.float64)

    best = int(sum(p.sum(0) for p in pieces()).argmax())
    # If no stretch of words gains a switch against the best single language, that language is the best path.
    gain, least, most = np.zeros(many), np.zeros(many), 0.0
    for p in pieces():
        run = np.concatenate([gain[None], gain + np.cumsum(p - p[:, best : best + 1], 0)])
        run_least = np.minimum(least, np.minimum.accumulate(run, 0))
        gain, least, most = run[-1], run_least[-1], max(most, float((run - run_least).max()))
        if most > switch:
            break
    if most <= switch:
        return np.full(n, best, np.int32)
    rows = (row for p in pieces() for row in p)
    k, came = _steps_by_lists(rows, switch) if many <= FEW_LANGUAGES else _steps_by_arrays(rows, switch, n)
    path = np.empty(n, np.int32)
    path[n - 1] = k
    for word in range(n - 1, 0, -1):
        path[word - 1] = k = came(word, k)
    return path


def _label(model: LanguageModel, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Scores(model)
        for rows, texts in text_chunks(batches):
            table.begin()
            words = [table.ids(t.split()) if t and model.languages else np.empty(0, np.int32) for t in texts]
            letters, score = table.settle() if model.languages else (None, None)
            spans, langs, shares = [], [], []
            for ids in words:
                if not len(ids) or not letters[ids].any():
                    spans.append([])
                    langs.append("und")
                    shares.append(0.0)
                    continue
                path = viterbi(score, ids=ids)
                starts = np.concatenate([[0], np.flatnonzero(path[1:] != path[:-1]) + 1])
                ends = np.append(starts[1:], len(path))
                spans.append([{"start": int(a), "end": int(b), "lang": model.languages[path[a]]} for a, b in zip(starts, ends, strict=True)])
                by = np.bincount(path, letters[ids], len(model.languages))
                langs.append(model.languages[int(by.argmax())])
                shares.append(float(by.max() / by.sum()))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, schema.field(1).type), pa.array(langs, pa.string()), pa.array(shares, pa.float64())], schema=schema)

    return run


def label_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, spans (start and end word, language), lang_pred and score of every whole text.

    ``lang_pred`` has most letters, and ``score`` is its share of them; ``und`` and 0
    for a text that is null or has no letter, or if nothing was learned; of
    languages with as many letters the first by name.  Very long texts are labelled
    whole, by one task each; repeated rows are labelled each; an empty table gives
    no rows.  Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = documents.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))), ("lang_pred", pa.string()), ("score", pa.float64())])
    return documents.select("doc_id", "text").mapInArrow(_label(model, schema), f"doc_id {kind.simpleString()}, spans array<struct<start int, end int, lang string>>, lang_pred string, score double")
