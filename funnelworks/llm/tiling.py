"""Benchmark decontamination by greedy string tiling.

A test item has leaked into a document if tiles (runs of tokens equal in both,
no token used twice) cover enough of it.  Tiles may lie anywhere in the document,
so an item whose sentences were reordered or spread is found as well as a verbatim
copy.  Shared seeds, runs of the least tile length, name the pairs to look at:
the seeds are joined, and only pairs with as many common seeds as the coverage
needs are tiled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import FILTER_BITS, bit_filter, staged
from .words import WordTable, hash_words, lean_after, text_chunks, window_hashes


@dataclass(frozen=True)
class Tiling:
    """The least tile, and the share of an item's tokens that tiles must cover.  An item of fewer tokens than a tile matches texts of the same tokens alone."""

    least: int = 4
    coverage: float = 0.6


def _tokens_of(words: list[bytes]) -> tuple[np.ndarray]:
    """A hash of each word's letters and digits, lower-cased; 0 for a word without any."""
    clean = ["".join(c for c in w.decode().lower() if c.isalnum()).encode() for w in words]
    out = hash_words(clean) | np.uint64(1)
    out[[not c for c in clean]] = 0
    return (out,)


class _Reader:
    """Token hashes of whole texts."""

    def __init__(self):
        self.table = WordTable(_tokens_of)

    def read(self, texts: list[bytes | None]) -> list[np.ndarray]:
        self.table.begin()
        words = [self.table.ids(t.split()) if t else np.empty(0, np.int32) for t in texts]
        (hashes,) = self.table.settle()
        found = [hashes[w] for w in words]
        return [x[x != 0] for x in found]


def _slots(seeds: np.ndarray) -> np.ndarray:
    return (seeds >> np.uint64(40)).astype(np.int64) % FILTER_BITS  # the filter spares the join most seeds of clean documents


def _seeds(tokens: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the runs of ``least`` tokens; of all tokens if they are fewer, which no run can equal."""
    if 0 < len(tokens) < least:
        return window_hashes(tokens ^ np.uint64(len(tokens)), len(tokens))
    return window_hashes(tokens, least)


def _items(tiling: Tiling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for rows, texts in text_chunks(batches):
            tokens = reader.read(texts)
            seeds = [_seeds(t, tiling.least).astype(np.int64) for t in tokens]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([t.tobytes() for t in tokens], pa.binary()), pa.array([len(t) for t in tokens], pa.int64()), pa.array([s.tolist() for s in seeds], pa.list_(pa.int64()))], names=["item_id", "item_tokens", "n_tokens", "seeds"])

    return run


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """One bit for each hash slot that holds a seed; FILTER_BITS in all."""
    return bit_filter(seeds.select(F.shiftrightunsigned("seed", 40).alias("slot")))


def _hits(bits: np.ndarray, tiling: Tiling, schema: pa.Schema):
    """Documents with a run of tokens that may be a seed: their tokens, and those runs' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, block, number = _Reader(), TaskContext.get().partitionId(), 0
        for rows, texts in text_chunks(batches):
            tokens = reader.read(texts)
            # The texts end to end; a run over a boundary belongs to no text.
            lengths = np.array([len(t) for t in tokens], np.int64)
            every = np.concatenate(tokens) if tokens else np.empty(0, np.uint64)
            runs = window_hashes(every, tiling.least)
            slot = _slots(runs)
            at = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
            ends = np.cumsum(lengths)
            text = np.searchsorted(ends, at, "right")
            inside = at + tiling.least <= ends[text] if len(at) else np.empty(0, bool)
            at, text = at[inside], text[inside]
            own = {int(i): _seeds(tokens[i], tiling.least) for i in np.flatnonzero((lengths > 0) & (lengths < tiling.least))}
            own = {i: x for i, x in own.items() if bits[int(_slots(x)[0]) >> 3] >> (int(_slots(x)[0]) & 7) & 1}
            cut = dict(zip(*(x.tolist() for x in np.unique(text, return_index=True)), strict=True))
            end = np.searchsorted(text, np.arange(len(tokens)), "right")
            found = np.array(sorted({*cut, *own}), np.int64)
            seeds = [np.unique(own[i] if i in own else runs[at[cut[i] : end[i]]]).astype(np.int64).tolist() for i in found.tolist()]
            keys = [block << 40 | number + int(i) for i in found]
            number += len(texts)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(found)), pa.array(keys, pa.int64()), pa.array([tokens[i].tobytes() for i in found], pa.binary()), pa.array(seeds, pa.list_(pa.int64()))], schema=schema)

    return lean_after(run)


def _free_runs(used: np.ndarray, size: int) -> np.ndarray:
    """Starts of the runs of ``size`` without a used entry, as a mask over all starts."""
    upto = np.concatenate([[0], np.cumsum(used)])
    return upto[size:] == upto[:-size]


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, 0x9E3779B97F4A7C15, np.uint64)]))


def _rolling(tokens: np.ndarray, powers: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of ``size``: the polynomial of each run, shifted to one common power."""
    n = len(tokens)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * powers[:n], dtype=np.uint64)])
        return (sums[size:] - sums[:-size]) * powers[n - size :: -1][: n - size + 1]


#: Pairs of equal runs, for each token of both, up to which they are written out.
MOST_PAIRS = 8


def _expanded(h_i: np.ndarray, h_t: np.ndarray, at_i: np.ndarray, at_t: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Maximal matches, longest first, from all pairs of equal runs, which are joined along their diagonals."""
    order = np.argsort(h_i[at_i], kind="stable")
    keys, by = h_i[at_i][order], at_i[order]
    low, high = np.searchsorted(keys, h_t[at_t], "left"), np.searchsorted(keys, h_t[at_t], "right")
    many = high - low
    t = np.repeat(at_t, many)
    i = by[np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)]
    order = np.lexsort((i, t - i))
    i, t = i[order], t[order]
    start = np.flatnonzero(np.concatenate([[True], (np.diff(t - i) != 0) | (np.diff(i) != 1)]))
    length = np.diff(np.append(start, len(i))) + size - 1
    first_i, first_t = i[start], t[start]
    for k in np.lexsort((first_t, first_i, -length)):
        yield int(first_i[k]), int(first_t[k]), int(length[k])


def _walked(h_i: np.ndarray, h_t: np.ndarray, at_i: np.ndarray, at_t: np.ndarray, size: int, used_i: np.ndarray, used_t: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Matches of exactly ``size``, where there are no longer ones: for each run of the item the first free one of the text; marks are looked at as they are made.

    A run of the text that is not free any more is passed once, so no pairs are written out.
    """
    order = np.argsort(h_t[at_t], kind="stable")
    keys, by = h_t[at_t][order], at_t[order].tolist()
    low, high = np.searchsorted(keys, h_i[at_i], "left").tolist(), np.searchsorted(keys, h_i[at_i], "right").tolist()
    upto: dict[int, int] = {}
    for i, a, b in zip(at_i.tolist(), low, high, strict=True):
        if used_i[i] or used_i[i + size - 1]:  # marks are no shorter than a run
            continue
        k = upto.get(a, a)
        while k < b and (used_t[by[k]] or used_t[by[k] + size - 1]):
            k += 1
        upto[a] = k
        if k < b:
            yield i, by[k], size


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in text, length), longest first; of equals the one first in item, then in text.

    The length sought starts at the whole item and is halved down to ``least``.
    At each length Karp-Rabin hashes of unused runs give the matches; those are
    joined along their diagonals into maximal ones, and marked while still free.
    What a mark cuts short is found again at the same length or a lower one.  Where
    equal runs make too many pairs (texts that repeat a phrase), the longest length
    that has a match is sought by bisection and its matches are walked through, so
    memory stays in proportion to the two texts.
    """
    out: list[tuple[int, int, int]] = []
    if min(len(item), len(text)) < least:
        return [(0, 0, len(item))] if len(item) and np.array_equal(item, text) else out
    if least < 1:
        return out
    used_i, used_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    common = np.isin(item, text)  # no tile is longer than a run of tokens that the text has
    edges = np.flatnonzero(np.diff(np.concatenate([[0], common.astype(np.int8), [0]])))
    size = max(least, min(len(text), int((edges[1::2] - edges[::2]).max(initial=0))))
    n = max(len(item), len(text))
    powers = _powers(n)
    a, b = (np.concatenate([x, np.zeros(n - len(x), np.uint64)]) for x in (item, text))  # to one length, so hashes compare

    def runs(size: int) -> tuple[np.ndarray, ...]:
        """Hashes of both, and where free runs start that the other has too."""
        h_i, h_t = _rolling(a, powers, size)[: len(item) - size + 1], _rolling(b, powers, size)[: len(text) - size + 1]
        at_i, at_t = np.flatnonzero(_free_runs(used_i, size)), np.flatnonzero(_free_runs(used_t, size))
        at_t = at_t[np.isin(h_t[at_t], h_i[at_i])]
        at_i = at_i[np.isin(h_i[at_i], h_t[at_t])]
        return h_i, h_t, at_i, at_t

    def mark(x: int, y: int, m: int) -> bool:
        if used_i[x : x + m].any() or used_t[y : y + m].any() or not np.array_equal(item[x : x + m], text[y : y + m]):
            return False
        used_i[x : x + m] = used_t[y : y + m] = True
        out.append((x, y, m))
        return True

    upper = size  # no match is longer
    while True:
        h_i, h_t, at_i, at_t = runs(size)
        marked = False
        if len(at_i):
            distinct, many_t = np.unique(h_t[at_t], return_counts=True)
            pairs = int(many_t[np.searchsorted(distinct, h_i[at_i])].sum())
            if pairs <= MOST_PAIRS * (len(item) + len(text)):
                for found in _expanded(h_i, h_t, at_i, at_t, size):
                    marked |= mark(*found)
            else:
                low, high = size, upper
                while low < high:
                    middle = (low + high + 1) // 2
                    low, high = (middle, high) if len(runs(middle)[2]) else (low, middle - 1)
                for found in _walked(*runs(low), low, used_i, used_t):
                    mark(*found)
                marked, upper = low > size, low - 1
        if not marked:  # else runs cut short by a mark may still be this long
            if size == least:
                return out
            upper = size - 1
            size = max(least, size // 2)


def _tiled(tiling: Tiling, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            covered, tiles = [], []
            for x, y in zip(batch.column("item_tokens"), batch.column("tokens"), strict=True):
                item = np.frombuffer(x.as_buffer(), np.uint64)
                found = tile(item, np.frombuffer(y.as_buffer(), np.uint64), tiling.least)
                covered.append(sum(m for *_, m in found))
                tiles.append([{"item_start": a, "text_start": b, "length": m} for a, b, m in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("item_id"), batch.column("n_tokens"), pa.array(covered, pa.int64()), pa.array(tiles, schema.field("tiles").type)], schema=schema)

    return run


def leaks(documents: DataFrame, benchmark: DataFrame, tiling: Tiling = Tiling()) -> DataFrame:
    """Pairs of a document and a test item whose tiles cover at least ``tiling.coverage`` of the item.

    Columns: doc_id, key (one for each row of ``documents``), item_id, n_tokens (of
    the item), covered, tiles.  Tokens are words' letters and digits, lower-cased.
    Null or empty texts, on either side, are in no pair; an item shorter than a tile
    is in a document of just its tokens; very long texts are tiled whole, in memory
    in proportion to them; repeated rows are paired each; an empty table gives no
    rows.  Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    item_kind, doc_kind = benchmark.schema["item_id"].dataType, documents.schema["doc_id"].dataType
    items = staged(benchmark.select("item_id", "text").mapInArrow(_items(tiling), f"item_id {item_kind.simpleString()}, item_tokens binary, n_tokens long, seeds array<long>").withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = items.select("item", F.explode("seeds").alias("seed")).groupBy("seed", "item").agg(F.count(F.lit(1)).alias("places"))
    bits = seed_filter(seeds)
    schema = pa.schema([("doc_id", to_arrow_type(doc_kind)), ("key", pa.int64()), ("tokens", pa.binary()), ("seeds", pa.list_(pa.int64()))])
    hits = staged(documents.select("doc_id", "text").mapInArrow(_hits(bits, tiling, schema), f"doc_id {doc_kind.simpleString()}, key long, tokens binary, seeds array<long>"), "hits")
    common = hits.select("key", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("key", "item").agg(F.sum("places").alias("places"))
    # Tiles of ``least`` tokens have the fewest seeds for what they cover: one each.
    enough = F.col("places") * F.least(F.lit(tiling.least), F.col("n_tokens")) >= F.col("n_tokens") * tiling.coverage
    pairs = common.join(items.select("item", "item_id", "item_tokens", "n_tokens"), "item").where(enough)
    out = pa.schema([("doc_id", to_arrow_type(doc_kind)), ("key", pa.int64()), ("item_id", to_arrow_type(item_kind)), ("n_tokens", pa.int64()), ("covered", pa.int64()), ("tiles", pa.list_(pa.struct([("item_start", pa.int64()), ("text_start", pa.int64()), ("length", pa.int64())])))])
    kinds = f"doc_id {doc_kind.simpleString()}, key long, item_id {item_kind.simpleString()}, n_tokens long, covered long, tiles array<struct<item_start long, text_start long, length long>>"
    tiled = pairs.join(hits.select("doc_id", "key", "tokens"), "key").select("doc_id", "key", "item_id", "n_tokens", "item_tokens", "tokens").mapInArrow(_tiled(tiling, out), kinds)
    return tiled.where(F.col("covered") >= F.col("n_tokens") * tiling.coverage)
