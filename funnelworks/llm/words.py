"""Words of whole texts as arrays, shared by the operators that read texts in Python.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; that is what
``bytes.split()`` gives, and it equals the runs of ``[^\\x20\\x09-\\x0D]+`` in the
text, since UTF-8 uses those byte values for nothing else.

Texts repeat their words, so everything that depends on one word alone (its hash,
its tokens, its score) is computed once for a distinct word of a task and then
gathered by index.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once: bounds the temporary arrays of a task.
CHUNK_BYTES = 1 << 21
#: Distinct words that a task remembers before it starts again: bounds its memory.
MOST_WORDS = 250_000


def text_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; none for null.  Lone surrogates cannot occur in Arrow strings."""
    return text.encode() if text else b""


def _kept() -> dict[tuple, WordTable]:
    """Of this worker process."""
    return sys.modules.setdefault("_funnelworks_worker", types.ModuleType("_funnelworks_worker")).__dict__.setdefault("tables", {})


#: glibc's mallopt: arrays from this size on have pages of their own, and go back to the system when they are freed.
_M_MMAP_THRESHOLD, _OWN_PAGES = -3, 1 << 20


def lean() -> None:
    """Give back what earlier tasks of this worker process have freed: Spark keeps workers, and their free memory counts."""
    _kept().clear()  # a worker that goes on to another operator holds no table of the one before
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_M_MMAP_THRESHOLD, _OWN_PAGES)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean_after(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which a worker that waits for its next task holds nothing of this one: an executor has more workers than cores."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        lean()

    return whole


class WordTable:
    """Numbers the distinct words of a task and keeps arrays of what ``describe`` says of each.

    ``describe(words)`` returns one array for each column, a row for each word.
    """

    def __init__(self, describe: Callable[[list[bytes]], tuple[np.ndarray, ...]], most: int = MOST_WORDS):
        lean()
        self.describe, self.most = describe, most
        self._restart()

    def _restart(self) -> None:
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.known = 0
        self.columns: list[np.ndarray] | None = None

    def begin(self) -> None:
        """Call before a chunk of texts: ids are stable until the next call."""
        if len(self.index) > self.most:
            self._restart()

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int32, len(words))

    def settle(self) -> list[np.ndarray]:
        """Describe the words seen since the last call; the columns for all ids."""
        new = list(islice(self.index, self.known, None))
        if new or self.columns is None:
            made = self.describe(new)
            if self.columns is None:
                self.columns = [np.array(x) for x in made]
            else:
                for i, x in enumerate(made):
                    held = self.columns[i]
                    if len(held) < self.known + len(x):
                        grown = np.empty((max(2 * len(held), self.known + len(x)), *held.shape[1:]), held.dtype)
                        grown[: self.known] = held[: self.known]
                        held = self.columns[i] = grown
                    held[self.known : self.known + len(x)] = x
            self.known = len(self.index)
        return self.columns


def kept_in_worker(key: tuple, make: Callable[[], WordTable]) -> WordTable:
    """A table that outlives the task: Spark gives a Python worker one task after another, and their texts share words.

    What a table says of a word depends on ``key`` alone, so results do not depend on which worker runs a task.
    """
    if key not in _kept():
        table = make()  # drops the table that was kept: the memory of a worker stays that of one
        _kept()[key] = table
    return _kept()[key]


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes that are the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` consecutive entries of ``hashes``; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def chunks(batch_lengths: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose texts have about ``most`` bytes in all; a longer text is alone."""
    start, held = 0, 0
    for i, n in enumerate(batch_lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(batch_lengths):
        yield start, len(batch_lengths)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Row ranges of Arrow batches with their texts as bytes (None for null), about CHUNK_BYTES at once."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        lengths = np.diff(np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)) if len(column) else np.empty(0, np.int64)
        for a, b in chunks(lengths):
            yield batch.slice(a, b - a), column.slice(a, b - a).to_pylist()


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
