"""Packing documents into token sequences of one capacity.

The pieces of all documents are tokenised once and staged.  How they are packed
depends on their lengths alone, and there are at most ``capacity`` lengths, so
the plan is made on the histogram of lengths: its size is bounded by the
capacity whatever the corpus, and a pattern (a multiset of lengths) stands for
all sequences that hold it.  Next fit gives a first plan, with about a sixth more
sequences than needed; ``local_search`` empties those by swaps.  Executors turn
the plan into places: the r-th piece of a length takes the r-th place of that
length.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import staged
from .words import WordTable, kept_in_worker, spread, text_chunks

SEQUENCE_TOKENS = 2048
#: Ends every document.
END_ID = 0

#: Distinct runs of marks that a table remembers, about, at most.
MOST_MARKS = 100_000

#: Fewer tokenizer calls: ASCII case does not matter to the vocabulary, and a full stop or comma after a letter is a token of its own.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|$)")
#: The same, mark by mark: a pattern that begins with its mark is searched for several times as fast.
_STOPS = [(b" " + x, re.compile(re.escape(x) + rb"(?=[ \n]|$)(?<=[a-z]" + re.escape(x) + b")")) for x in (b".", b",")]

#: What the tokenizer neither changes nor cuts before its merges: small letters of one code point.  It cuts between a letter and the marks after it.
_LETTERS = re.compile(r"([a-zà-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def _stops_apart(text: bytes) -> bytes:
    """A lower-case text with a space before each such mark."""
    for apart, mark in _STOPS:
        text = apart.join(mark.split(text))
    return text


class TokenTable(WordTable):
    """Token ids of distinct words.  The tokenizer never joins over white space, so a text's ids are its words' ids in order.

    A text in which a special token is written out is encoded as a whole (``whole``), since that token may stand anywhere in a word.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.encode_special_tokens = True  # what only lower-casing makes of a word is no special token
        self.model, self.marks = self.tokenizer.model, {"": []}
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.as_bytes = {x: level.pre_tokenize_str(chr(x))[0][0] for x in range(0xE0, 0x100)}  # how the vocabulary writes those beyond ASCII
        super().__init__(self._tokens, most=500_000)

    def _restart(self) -> None:
        super()._restart()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def whole(self, text: bytes | None) -> np.ndarray | None:
        """The ids of a text with a special token in it; None for other texts."""
        if text and any(x in text for x in self.special):
            self.tokenizer.encode_special_tokens = False
            ids = np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
            self.tokenizer.encode_special_tokens = True
            return ids
        return None

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """The ids of each word, by the whole tokenizer."""
        if not words:
            return []
        got = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
        ids, of = got.ids, np.array(got.word_ids, np.int64)
        upto = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        return [ids[a:b] for a, b in pairwise(upto)]

    def _tokens(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lower = [w.decode().lower() for w in words]
        plain = [m and m.groups() for m in map(_LETTERS.fullmatch, lower)]
        other = iter(self._encoded([w.decode() for w, p in zip(words, plain, strict=True) if p is None]))
        if len(self.marks) > MOST_MARKS:
            self.marks = {"": []}
        marks = list({p[1] for p in plain if p is not None} - self.marks.keys())
        self.marks |= zip(marks, self._encoded(marks), strict=True)
        # Letters go to the tokenizer's model at once.
        merged, marks_of, as_bytes = self.model.tokenize, self.marks, self.as_bytes
        each = [next(other) if p is None else [t.id for t in merged(p[0] if p[0].isascii() else p[0].translate(as_bytes))] + marks_of[p[1]] for p in plain]
        counts = np.fromiter(map(len, each), np.int32, len(each))
        ids = np.fromiter(chain.from_iterable(each), np.uint32, int(counts.sum()))
        if self.used + len(ids) > len(self.flat):
            grown = np.empty(max(2 * len(self.flat), self.used + len(ids)), np.uint32)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        return starts.astype(np.int64), counts


def _pieces(tokenizer_path: str, capacity: int, with_ids: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, block = kept_in_worker(("tokens", tokenizer_path), lambda: TokenTable(tokenizer_path)), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far: gives a piece its number among them
        for rows, texts in text_chunks(batches):
            table.begin()
            apart = [table.whole(t) for t in texts]
            words = [table.ids(_stops_apart(t.lower()).split()) if t and x is None else np.empty(0, np.int32) for t, x in zip(texts, apart, strict=True)]
            starts, counts = table.settle()
            every = np.concatenate(words) if words else np.empty(0, np.int32)
            tokens = table.flat[spread(starts[every], counts[every].astype(np.int64))]
            upto = np.concatenate([[0], np.cumsum(counts[every], dtype=np.int64)])[np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)]
            out: list[tuple] = []
            for i in range(len(texts)):
                ids = np.append(tokens[upto[i] : upto[i + 1]] if apart[i] is None else apart[i], np.uint32(END_ID)).astype("<u4", copy=False)
                for k, at in enumerate(range(0, len(ids), capacity)):
                    raw = ids[at : at + capacity].tobytes()
                    n = len(raw) // 4
                    out.append((i, k, at, n, zlib.crc32(raw), seen[n], raw if with_ids else None))
                    seen[n] += 1
            which, piece, start, length, crc, number, raws = zip(*out, strict=True) if out else ([],) * 7
            columns = [rows.column(0).take(pa.array(which, pa.int64())), piece, start, length, crc, [block] * len(out), number]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns + [raws] * with_ids, schema, strict=True)], schema=schema)

    return run


def tokenise(documents: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of every whole text, each document ended by END_ID.

    A null text is as an empty one: a document of END_ID alone.  Null or repeated
    doc_ids are kept as they are; other columns are not read.
    ``ids`` has the tokens as unsigned little-endian 32-bit integers.
    """
    ids = documents.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(ids)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int32()), ("number", pa.int64())] + [("ids", pa.binary())] * with_ids)
    kinds = f"doc_id {ids.simpleString()}, piece int, start long, length long, ids_crc32 long, block int, number long" + ", ids binary" * with_ids
    return documents.select("doc_id", "text").mapInArrow(_pieces(tokenizer_path, capacity, with_ids, schema), kinds)


def next_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """A first plan of a histogram of lengths, longest first: a piece goes into the open sequence or opens the next one.

    Patterns and how many sequences have each; at most two patterns for each length.
    """
    plan: Counter[Pattern] = Counter()
    held: list[tuple[int, int]] = []
    room = capacity
    for size in sorted(counts, reverse=True):
        left = counts[size]
        if not 0 < size <= capacity:
            raise ValueError(f"length {size} does not fit in {capacity}")
        if room // size:
            some = min(room // size, left)
            held.append((size, some))
            room, left = room - some * size, left - some
        if left:
            plan[tuple(held)] += 1
            each = capacity // size
            plan[((size, each),)] += (left - 1) // each
            left = (left - 1) % each + 1
            held, room = [(size, left)], capacity - left * size
    plan[tuple(held)] += 1
    return Counter({p: n for p, n in plan.items() if p and n})


@lru_cache(maxsize=1 << 17)
def _fill(pattern: Pattern) -> int:
    return sum(size * n for size, n in pattern)


def _singles(pattern: Pattern) -> dict[int, tuple[int, ...]]:
    return {size: (size,) for size, _ in pattern}


@lru_cache(maxsize=1 << 17)
def _pairs(pattern: Pattern) -> dict[int, tuple[int, ...]]:
    """Two pieces of a bin by their total length."""
    out: dict[int, tuple[int, ...]] = {}
    for i, (a, n) in enumerate(pattern):
        for b, _ in pattern[i if n > 1 else i + 1 :]:
            out.setdefault(a + b, (a, b))
    return out


def _changed(pattern: Pattern, without: tuple[int, ...], plus: tuple[int, ...]) -> Pattern:
    held = dict(pattern)
    for size in without:
        held[size] -= 1
    for size in plus:
        held[size] = held.get(size, 0) + 1
    return tuple(sorted(((s, n) for s, n in held.items() if n), reverse=True))


class _Index:
    """Which patterns can give up a length, by that length and the room that they have."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.base = capacity + 1
        self.keys = np.empty(0, np.int64)  # length * base + room, in order
        self.lengths = np.empty(0, np.int64)
        self.held: dict[int, dict[Pattern, None]] = {}
        self.touched: set[int] = set()

    def add(self, length: int, room: int, pattern: Pattern) -> None:
        self.held.setdefault(length * self.base + room, {})[pattern] = None
        self.touched.add(length * self.base + room)

    def drop(self, length: int, room: int, pattern: Pattern) -> None:
        del self.held[length * self.base + room][pattern]
        self.touched.add(length * self.base + room)

    def settle(self) -> None:
        if not self.touched:
            return
        keys = np.array(sorted(self.touched), np.int64)
        self.touched.clear()
        some = np.array([bool(self.held[k]) for k in keys.tolist()])
        for k in keys[~some].tolist():
            del self.held[k]
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        out = np.delete(self.keys, at[there & ~some])
        fresh = keys[some & ~there]
        self.keys = np.insert(out, np.searchsorted(out, fresh), fresh)
        length = self.keys // self.base
        self.lengths = length[np.append(True, length[1:] != length[:-1])] if len(length) else length

    def best(self, taken: int, fill: int) -> tuple[int, int, int]:
        """How much half the sum of squares can rise if a bin of ``fill`` gives up ``taken``: that, and the length given for it by a bin of which room.

        Of the bins that have a length and the room, the fullest is best.
        """
        given = self.lengths[: np.searchsorted(self.lengths, taken)]
        if not len(given):
            return 0, 0, 0
        more = taken - given
        at = np.searchsorted(self.keys, given * self.base + more)
        room = self.keys[np.minimum(at, len(self.keys) - 1)] - given * self.base
        gain = np.where((at < len(self.keys)) & (room < self.base), more * (self.capacity - room - fill + more), 0)
        i = int(gain.argmax())
        return int(gain[i]), int(given[i]), int(room[i])


class _Bins:
    """A plan under exchange."""

    def __init__(self, plan: Counter[Pattern], capacity: int):
        self.capacity = capacity
        self.count: dict[Pattern, int] = {}
        self.full: dict[int, Pattern] = {}  # full bins by what two of their pieces have in all; may be out of date
        self.one, self.two = _Index(capacity), _Index(capacity)
        self.bins = 0
        self.open: set[Pattern] = set()
        for pattern, n in plan.items():
            self.put(pattern, n)

    def _entries(self, pattern: Pattern) -> Iterator[tuple[_Index, int]]:
        if _fill(pattern) < self.capacity:
            yield self.one, 0
            for size in _singles(pattern):
                yield self.one, size
            for size in _pairs(pattern):
                yield self.two, size

    def put(self, pattern: Pattern, n: int) -> None:
        if pattern and n:
            if pattern not in self.count:
                self.show(pattern)
                if _fill(pattern) < self.capacity:
                    self.open.add(pattern)
            self.count[pattern] = self.count.get(pattern, 0) + n
            self.bins += n

    def take(self, pattern: Pattern, n: int) -> None:
        self.bins -= n
        self.count[pattern] -= n
        if not self.count[pattern]:
            del self.count[pattern]
            self.open.discard(pattern)
            self.hide(pattern)

    def show(self, pattern: Pattern) -> None:
        for index, size in self._entries(pattern):
            index.add(size, self.capacity - _fill(pattern), pattern)

    def hide(self, pattern: Pattern) -> None:
        for index, size in self._entries(pattern):
            index.drop(size, self.capacity - _fill(pattern), pattern)

    def underfull(self) -> list[tuple[int, Pattern]]:
        return sorted((_fill(p), p) for p in self.open)

    def exchange(self, emptier: Pattern) -> Pattern | None:
        """The move, one-for-one, two-for-one or one-for-two exchange of ``emptier`` with another bin that raises the sum of squared fills most; its new pattern.

        A net length d that goes to the fuller bin raises the sum by 2d(fuller -
        emptier + d).  All bins of the pattern take part, as far as both sides reach.
        """
        alone = self.count[emptier] == 1
        if alone:  # a bin does not exchange with itself
            self.hide(emptier)
        self.one.settle()
        self.two.settle()
        fill = _fill(emptier)
        best: tuple = (0,)
        for taken in _singles(emptier).values():
            best = max(best, (*self.one.best(taken[0], fill), taken, 1), (*self.two.best(taken[0], fill), taken, 2), key=lambda x: x[0])
        for size, taken in _pairs(emptier).items():
            best = max(best, (*self.one.best(size, fill), taken, 1), key=lambda x: x[0])
        if alone:
            self.show(emptier)
        if not best[0]:
            return None
        _, size, room, taken, pieces = best
        fuller = next(p for p in (self.one if pieces == 1 else self.two).held[size * (self.capacity + 1) + room] if p != emptier or not alone)
        given = _pairs(fuller)[size] if pieces == 2 else (size,) if size else ()
        n = self.count[fuller] // 2 if fuller == emptier else min(self.count[fuller], self.count[emptier])
        return self._swap(fuller, given, emptier, taken, n)

    def _swap(self, fuller: Pattern, given: tuple[int, ...], emptier: Pattern, taken: tuple[int, ...], n: int) -> Pattern:
        self.take(fuller, n)
        self.take(emptier, n)
        self.put(_changed(fuller, given, taken), n)
        left = _changed(emptier, taken, given)
        self.put(left, n)
        return left

    def split(self) -> Pattern | None:
        """Two-for-one with a full bin at equal length: the sum stays, and the emptier bin has smaller pieces to give away; its new pattern."""
        for fresh in (False, True):
            if fresh:
                self.full = {size: p for p in self.count if _fill(p) == self.capacity for size in _pairs(p)}
            for _, emptier in self.underfull():
                for size, _ in emptier:
                    fuller = self.full.get(size)
                    if fuller in self.count:
                        return self._swap(fuller, _pairs(fuller)[size], emptier, (size,), min(self.count[fuller], self.count[emptier]))
        return None


def local_search(plan: Counter[Pattern], capacity: int, splits: bool = True) -> Counter[Pattern]:
    """Exchanges between underfull bins that raise the sum of squared fills, until bins empty.

    The emptiest bins give first, and full ones are left alone.  Bins with the same pattern move together, so the
    work depends on the number of patterns and not on the number of sequences.
    Where nothing raises the sum, a piece of the emptiest bin is swapped for two of
    a full one (``splits``), which leaves the sum and makes new exchanges possible.
    It ends when the fewest possible bins are reached or no exchange is left: the sum never
    falls, and between rises the number of pieces in underfull bins grows.
    """
    bins = _Bins(plan, capacity)
    fewest = -(-sum(_fill(p) * n for p, n in plan.items()) // capacity)
    heap, moved, whole, splitting = bins.underfull(), False, True, False
    while bins.bins > fewest:
        if not heap:
            if splitting or not moved:
                fresh = bins.split() if splits else None
                splitting = fresh is not None
                if fresh:
                    heap, whole = [(_fill(fresh), fresh)], False
                    continue
                if whole and not moved:
                    break
            heap, moved, whole = bins.underfull(), False, True
            continue
        _, emptier = heapq.heappop(heap)
        if emptier in bins.count and (left := bins.exchange(emptier)) is not None:
            moved = True
            for p in {emptier, left}:
                if p in bins.count:
                    heapq.heappush(heap, (_fill(p), p))
    return Counter(bins.count)


def packed(counts: dict[int, int], capacity: int, base: int = 4) -> Counter[Pattern]:
    """A plan for a histogram of lengths: ``next_fit`` and ``local_search`` for the digits of its counts, from the highest.

    What is packed for the higher digits is had ``base`` times before the next digit
    comes in.  So the work grows with the number of digits, not with that of the pieces.
    """
    plan: Counter[Pattern] = Counter()
    power = 1
    while power * base <= max(counts.values(), default=0):
        power *= base
    while power:
        digits = {size: n // power % base for size, n in counts.items() if n // power % base}
        plan = Counter({p: n * base for p, n in plan.items()}) + next_fit(digits, capacity)
        plan = local_search(plan, capacity, splits=power == 1)
        power //= base
    return plan


def places(plan: Counter[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: the first piece number, first sequence, first offset and pieces in a sequence of each run of places."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter[int] = Counter()
    sequence = 0
    for pattern, bins in sorted(plan.items(), reverse=True):
        offset = 0
        for size, each in pattern:
            rows.setdefault(size, []).append((taken[size], sequence, offset, each))
            taken[size] += bins * each
            offset += size * each
        sequence += bins
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in rows.items()}


def _place(where: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                mine = length == size
                first, first_sequence, first_offset, each = where[int(size)]
                run_of = np.searchsorted(first, number[mine], "right") - 1
                r = number[mine] - first[run_of]
                sequence[mine] = first_sequence[run_of] + r // each[run_of]
                offset[mine] = first_offset[run_of] + r % each[run_of] * size
            kept = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in kept] + [pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return run


def pack_documents(documents: DataFrame, tokenizer_path: str, capacity: int = SEQUENCE_TOKENS, with_ids: bool = True) -> DataFrame:
    """Every document of ``documents`` (doc_id, text) as pieces with their sequence and the offset there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with
    ``with_ids``, ids.  Only documents over ``capacity`` tokens are cut, and each
    piece but a document's last is then a whole sequence; a very long text is read
    whole by one task and leaves it piece by piece.  An empty table gives no rows.
    Null texts count as empty; repeated rows are packed each; pieces of one length
    are interchangeable, and take their places in the order of blocks.  Other
    columns are not read.
    """
    pieces = staged(tokenise(documents, tokenizer_path, capacity, with_ids), "pieces")
    blocks = staged(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    where = places(packed(counts, capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = blocks.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(first, ["block", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("before") + F.col("number")).alias("rank"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in ranked.drop("rank").dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(where), kinds)
