"""Quality rules from how public vocabularies cut a text.

Prose of a language gives about the same number of characters per token, the same
share of tokens that fall back to single bytes, and a token distribution whose
entropy follows the text's length.  Junk does not.  The bands are medians of a
language with a width from the median deviation of its documents, both over the
whole table; of its script where the language is not known or has too few
documents, and of all documents where the script has too few as well.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scripts
from .store import staged
from .words import WordTable, hash_words, lean_after, spread, text_chunks, window_hashes

#: Symbols that the base rules count.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
#: Languages and scripts are few; so many bands at most are sent to all executors, more are joined by a shuffle.
MOST_BANDS = 10_000


@dataclass(frozen=True)
class FertilityRules:
    """Widths of the bands.

    A measure x of a document with n tokens is rejected when it is further from
    its group's median m than ``width * s / sqrt(n) + slack * m``; s is the median
    of ``|x - m| * sqrt(n)`` over the group.  Short texts have wide
    bands by that.  A group of under ``least_documents`` is judged by the next wider.
    """

    width: float = 6.0
    slack: float = 0.02
    byte_share_slack: float = 0.02
    least_documents: int = 20


class _Vocabularies(WordTable):
    """Of each distinct word: code points, symbols, letters, script, hash, and its tokens in both vocabularies."""

    def __init__(self, piece_path: str, rank_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        super().__init__(self._describe)

    def _restart(self) -> None:
        super()._restart()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0

    def _describe(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        texts = [w.decode() for w in words]
        cut = self.pieces.encode(texts, num_threads=1) if texts else []
        counts = np.fromiter(map(len, cut), np.int32, len(cut))
        ids = np.fromiter((i for x in cut for i in x), np.int32, int(counts.sum()))
        if self.used + len(ids) > len(self.flat):
            grown = np.empty(max(2 * len(self.flat), self.used + len(ids)), np.int32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.used += len(ids)
        byte_counts = np.bincount(np.repeat(np.arange(len(words)), counts), self.is_byte[ids], len(words)).astype(np.int32) if words else np.empty(0, np.int32)
        rank_counts = np.fromiter((len(self.ranks.encode_ordinary(" " + t)) for t in texts), np.int32, len(texts))
        letters, script = scripts.letters_by_script(words)
        symbols = np.fromiter((len(w) - len(w.translate(None, SYMBOLS)) for w in words), np.int32, len(words))
        return np.fromiter(map(len, texts), np.int32, len(texts)), symbols, letters, script, hash_words(words), starts, counts, byte_counts, rank_counts


def repeated_words(hashes: np.ndarray, lengths: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each text (its words' hashes follow those of the one before): words in windows of ``size`` found twice or more in it."""
    out = np.zeros(len(lengths), np.int64)
    windows = window_hashes(hashes, size)
    if not len(windows):
        return out
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = text[: len(windows)] == text[size - 1 :]
    keys = windows ^ (text[: len(windows)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(keys[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    found = np.flatnonzero((twice[at] == keys) & inside)
    change = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(change, found, 1)
    np.add.at(change, found + size, -1)
    covered = np.cumsum(change[:-1]) > 0
    return np.bincount(text, covered, len(lengths)).astype(np.int64)


_BLANK = re.compile(rb"[\x20\x09-\x0D]*\Z")


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if not _BLANK.match(x)]
    return len(lines) - len(set(lines))


def _entropies(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """Bits per token of each text's own token distribution; 0 for a text without tokens."""
    text = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    keys = np.sort(text * vocabulary + ids)
    ends = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate([[-1], ends])).astype(float)
    total = np.bincount(keys[ends] // vocabulary, counts * np.log2(counts), len(lengths)) if len(keys) else np.zeros(len(lengths))
    n = np.maximum(lengths, 1)
    return np.log2(n) - total / n


def _measures(piece_path: str, rank_path: str, schema: pa.Schema, others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Vocabularies(piece_path, rank_path)
        for rows, texts in text_chunks(batches):
            table.begin()
            words = [table.ids(t.split()) if t else np.empty(0, np.int32) for t in texts]
            chars, symbols, letters, script, hashes, starts, counts, byte_counts, rank_counts = table.settle()
            every = np.concatenate(words) if words else np.empty(0, np.int32)
            n = np.array([len(w) for w in words], np.int64)
            text = np.repeat(np.arange(len(n)), n)
            total = lambda x: np.bincount(text, x[every], len(n)).astype(np.int64)
            tokens = total(counts)
            by_script = np.bincount(text * len(scripts.NAMES) + script[every], letters[every], len(n) * len(scripts.NAMES)).reshape(len(n), -1)
            main = np.array([*scripts.NAMES, None], object)[np.where(by_script.sum(1) > 0, by_script.argmax(1), len(scripts.NAMES))]
            made = [n, total(chars), total(symbols), [duplicate_lines(t) if t else 0 for t in texts], repeated_words(hashes[every], n), tokens, total(byte_counts), total(rank_counts), _entropies(table.flat[spread(starts[every], counts[every].astype(np.int64))], tokens, len(table.is_byte)), main]
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(others))] + [pa.array(x, f.type) for x, f in zip(made, list(schema)[len(others) :], strict=True)], schema=schema)

    return lean_after(run)


_MADE = (("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"), ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"), ("n_tokens", pa.int64(), "long"), ("n_byte_tokens", pa.int64(), "long"), ("n_rank_tokens", pa.int64(), "long"), ("token_entropy", pa.float64(), "double"), ("script", pa.string(), "string"))


OTHERS = ["doc_id", "lang", "content"]


def measure(documents: DataFrame, piece_path: str, rank_path: str) -> DataFrame:
    """doc_id, lang and content (a hash of lang and text) with the base counts and the tokenizers' measures of every whole text.

    Tokens are those of the text's words, each with one space before it.  A null
    text has no words.  ``script`` is that of most letters; null without letters.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kept = documents.select("doc_id", "lang", F.xxhash64("lang", "text").alias("content"), "text")
    schema = pa.schema([(x, to_arrow_type(kept.schema[x].dataType)) for x in OTHERS] + [(name, kind) for name, kind, _ in _MADE])
    kinds = ", ".join([f"{x} {kept.schema[x].dataType.simpleString()}" for x in OTHERS] + [f"{name} {kind}" for name, _, kind in _MADE])
    return kept.mapInArrow(_measures(piece_path, rank_path, schema, OTHERS), kinds)


def _small(bands: DataFrame) -> DataFrame:
    """A row for each band, sent to all executors if they are as few as they should be."""
    bands = staged(bands, "bands")
    return F.broadcast(bands) if bands.limit(MOST_BANDS + 1).count() <= MOST_BANDS else bands


def _bands(used: DataFrame, level: str, keys: list[str], names: tuple[str, ...], rules: FertilityRules) -> DataFrame:
    """For each group by ``keys``, as a struct named ``level``: the measures' medians, and those of how far documents are off, times sqrt(tokens).

    Groups of too few documents have no row; all documents together have one always.
    """
    rows = used.dropna(subset=keys) if keys else used
    middle = _small(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), *[F.percentile_approx(x, 0.5, 10000).alias(f"{x}_mid") for x in names]).where(F.col("documents") >= (rules.least_documents if keys else 0)))
    placed = rows.join(middle, keys) if keys else rows.crossJoin(F.broadcast(middle))
    off = lambda x: F.abs(F.col(x) - F.col(f"{x}_mid")) * F.sqrt("n_tokens")
    spreads = placed.groupBy(*keys).agg(*[F.first(f"{x}_mid").alias(f"{x}_mid") for x in names], *[F.percentile_approx(off(x), 0.5, 10000).alias(f"{x}_dev") for x in names])
    return _small(spreads.select(*keys, F.struct(*[f"{x}_{y}" for x in names for y in ("mid", "dev")]).alias(level)))


def judge(measured: DataFrame, rules: FertilityRules = FertilityRules()) -> DataFrame:
    """``measured`` with chars_per_token, chars_per_rank_token, byte_share, entropy_ratio, base_failed, out_of_band and kept.

    ``measured`` is read several times, so it should be a written table.  The bands
    are a few numbers for each language or script.  Documents that fail the base
    rules have no part in them.
    """
    n = F.greatest(F.col("n_tokens"), F.lit(1))
    measured = (
        measured.withColumn("chars_per_token", F.col("word_chars") / n)
        .withColumn("chars_per_rank_token", F.col("word_chars") / F.greatest(F.col("n_rank_tokens"), F.lit(1)))
        .withColumn("byte_share", F.col("n_byte_tokens") / n)
        # Of a short text the entropy is near log2(n); of a long one it is that of the language.
        .withColumn("entropy_ratio", F.col("token_entropy") / F.log2(F.least(n, F.lit(1024)) + 1))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    )
    names = ("chars_per_token", "chars_per_rank_token", "byte_share", "entropy_ratio")
    used = measured.where(~F.col("base_failed"))
    judged = measured
    levels = (("by_lang", ["lang"]), ("by_script", ["script"]), ("by_all", []))
    for level, keys in levels:
        judged = judged.join(_bands(used, level, keys, names, rules), keys, "left") if keys else judged.crossJoin(F.broadcast(_bands(used, level, keys, names, rules)))
    judged = judged.withColumn("band", F.coalesce(*[level for level, _ in levels]))
    outside = F.lit(False)
    for x in names:
        mid, dev = F.col(f"band.{x}_mid"), F.col(f"band.{x}_dev")
        slack = F.lit(rules.byte_share_slack) if x == "byte_share" else F.lit(rules.slack) * mid
        off = F.col(x) - mid if x == "byte_share" else F.abs(F.col(x) - mid)
        outside = outside | (off > rules.width * dev / F.sqrt(n) + slack)
    judged = judged.withColumn("out_of_band", F.coalesce(outside, F.lit(False))).drop("band", *[level for level, _ in levels])
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("out_of_band"))


def quality_rules(documents: DataFrame, piece_path: str, rank_path: str, rules: FertilityRules = FertilityRules()) -> DataFrame:
    """Every document with its measures and verdict; see ``measure`` and ``judge``.

    Null languages are judged by script; very long texts are measured whole, by one
    task each; equal texts of a language are judged alike, repeated rows each; an
    empty table gives no rows.  Other columns of ``documents`` are not read.
    """
    return judge(staged(measure(documents, piece_path, rank_path), "fertility"), rules)
