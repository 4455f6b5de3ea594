"""Jaccard join of word n-gram sets by vertical partitioning.

The global order of n-grams is cut into fragments by ranges of their hash.
Every block of documents (what one task reads) sends each fragment a packed run
of its n-grams; a fragment sees how many sets hold an n-gram, and only n-grams of
two sets or more go on: the others overlap with nothing.  A set whose shared part
is too small for the threshold ends there.

Of what is left, a set's rarest n-grams (its prefix) find the candidates: two
sets over the threshold share one of them.  Sets that share a prefix n-gram are
first compared with the least of them alone, which joins a family of near copies
by a star instead of all its pairs; only sets that are still apart are compared
after that, so no link between components is missed.  Few sets of one n-gram are compared as
pairs; many are cut into tiles of bounded size, and a task compares two tiles and
tells only which components it joins, so no table of pairs is made.  Pairs and
tiles are compared fragment by fragment: partial overlaps are counted separately
and summed for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import dealt, dropped, parts_for, reading, released, sent, staged
from .words import WordTable, hash_words, lean_after, mix, text_chunks, window_hashes

SHINGLE = 5
#: Two sets link when 100 * overlap >= PERCENT * union.
PERCENT = 75
#: N-grams are compared by this many bits of their 64-bit hash; sets are counted and named by all of them.
BITS = 48
#: N-grams that a block gathers before it sends them, about: bounds a task's arrays and the size of a row.
PART_KEYS = 1 << 20
#: N-grams of a fragment that are counted at once, about.
COUNTED_KEYS = 1 << 17
#: Parts of a set that a pair is compared by.
SEGMENTS = 4
#: Up to so many sets of one n-gram are compared as pairs, more as tiles.
FEW = 16
#: What a tile holds about, at most: sets, and n-grams of all its sets.
TILE_SETS, TILE_GRAMS = 2048, 2_000_000
#: N-grams of a tile that are counted at once.
TILE_COLUMNS = 4096
_ROWS = "kind int, fragment long, block long, doc_id long, content long, local int, n long, name_a long, name_b long, high binary, low binary, refs binary"


@dataclass(frozen=True)
class Rule:
    size: int = SHINGLE
    percent: int = PERCENT

    def least(self, n):
        """The overlap that a set of n needs with any other: ceil(t n)."""
        return -((-self.percent * n) // 100)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole sequence if it is shorter; none of no words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    if len(hashes) < size:
        return window_hashes(hashes ^ np.uint64(len(hashes)), len(hashes))
    return np.unique(window_hashes(hashes, size))


def _name(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a, b = mix(shingles).sum(dtype=np.uint64), mix(shingles ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _shuffled_out(fragments: int, rule: Rule, schema: pa.Schema):
    """Of a block: a row for each document (kind 0), and its shingles as one packed run for each fragment (kind 1), or several in large blocks."""

    def packed(block: int, many: int, keys: list[np.ndarray], refs: list[np.ndarray]) -> pa.RecordBatch:
        """The runs of what has been gathered, which is gone after."""
        key, ref = np.concatenate(keys), np.concatenate(refs)
        keys.clear()
        refs.clear()
        order = np.argsort(key)
        key, ref = key[order], ref[order]
        cut = np.searchsorted(key, [(f << BITS) // fragments for f in range(fragments + 1)])
        narrow = np.uint16 if many <= 1 << 16 else np.uint32
        out = []
        for f in np.flatnonzero(np.diff(cut)).tolist():
            k, r = key[cut[f] : cut[f + 1]], ref[cut[f] : cut[f + 1]]
            out.append((1, f, block, None, None, int(narrow == np.uint32), len(k), None, None, (k >> np.uint64(32)).astype(np.uint16).tobytes(), k.astype(np.uint32).tobytes(), r.astype(narrow).tobytes()))
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId()
        table = WordTable(lambda words: (hash_words(words),))
        sets: dict[tuple[int, int, int], int] = {}  # equal sets of a block are one
        keys, refs = [], []
        for rows, texts in text_chunks(batches):
            table.begin()
            words = [table.ids(t.lower().split()) if t else np.empty(0, np.int32) for t in texts]
            (hashes,) = table.settle()
            out = []
            for doc_id, content, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), words, strict=True):
                shingles = shingle_set(hashes[ids], rule.size)
                name = (len(shingles), *_name(shingles))
                local = sets.get(name)
                if local is None:
                    local = sets[name] = len(sets)
                    short = shingles >> np.uint64(64 - BITS)
                    keys.append(short[np.append(True, short[1:] != short[:-1])] if len(short) else short)
                    refs.append(np.full(len(keys[-1]), local, np.uint32))
                out.append((doc_id, content, local, *name))
            doc, content, local, n, a, b = zip(*out, strict=True) if out else ((),) * 6
            many = len(out)
            # They pass through any fragment, evenly.
            columns = [[0] * many, [(block * 7919 + i) % fragments for i in range(many)], [block] * many, doc, content, local, n, a, b, [None] * many, [None] * many, [None] * many]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            if sum(map(len, keys)) >= PART_KEYS:
                yield packed(block, len(sets), keys, refs)
        if keys:
            yield packed(block, len(sets), keys, refs)

    return lean_after(run)


def shared_keys(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted runs: the keys that are there more than once, in order, and how often.  Ranges of keys are counted one after another, so temporary arrays are small."""
    many = sum(map(len, runs))
    bounds = np.unique(max(runs, key=len)[:: max(1, len(max(runs, key=len)) * COUNTED_KEYS // max(1, many))][1:]) if many else []
    cuts = [np.concatenate([[0], np.searchsorted(k, bounds), [len(k)]]).astype(np.int64) for k in runs]
    shared, held_by = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
    for i in range(len(bounds) + 1):
        key = np.concatenate([np.empty(0, np.uint64), *(k[c[i] : c[i + 1]] for k, c in zip(runs, cuts, strict=True))])
        key.sort()
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        counts = np.diff(np.append(starts, len(key)))
        shared.append(key[starts[counts > 1]])
        held_by.append(counts[counts > 1].astype(np.uint32))
    return np.concatenate(shared), np.concatenate(held_by)


def _shared_only(schema: pa.Schema):
    """Of a fragment: the documents' rows as they are, and of the runs what two sets or more hold, back by block, with how many hold it."""

    def of_fragment(fragment: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        shared, held_by = shared_keys([k for _, k, _ in parts])
        if not len(shared):
            return
        for block, k, r in parts:
            at = np.minimum(np.searchsorted(shared, k), len(shared) - 1)
            some = shared[at] == k
            if some.any():
                row = [1, fragment, block, None, None, None, int(some.sum()), None, None, k[some].tobytes(), held_by[at[some]].tobytes(), r[some].astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            documents = batch.filter(pa.array(kind == 0))
            if documents.num_rows:
                yield pa.RecordBatch.from_arrays([documents.column(x) for x in schema.names], schema=schema)
            del documents
            for i in np.flatnonzero(kind == 1).tolist():  # not filtered: runs would be there twice
                r = {c: batch.column(c)[i].as_py() for c in ("fragment", "block", "local", "high", "low", "refs")}
                if r["fragment"] != current and parts:
                    yield from of_fragment(current, parts)
                    parts = []
                current = r["fragment"]
                key = np.frombuffer(r["high"], np.uint16).astype(np.uint64)
                key <<= np.uint64(32)
                key |= np.frombuffer(r["low"], np.uint32)
                parts.append((r["block"], key, np.frombuffer(r["refs"], np.uint32 if r["local"] else np.uint16)))
            del batch
        if parts:
            yield from of_fragment(current, parts)

    return lean_after(run)


def _survivors(rule: Rule):
    """Of a block: the sets whose shared part may reach the threshold, their shared n-grams from rarest to most frequent."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        documents, runs = table.filter(pa.array(kind == 0)), table.filter(pa.array(kind == 1)).select(["high", "low", "refs"]).to_pydict()
        key = np.frombuffer(b"".join(runs["high"]), np.uint64)
        held = np.frombuffer(b"".join(runs["low"]), np.uint32)
        ref = np.frombuffer(b"".join(runs["refs"]), np.uint32)
        local, first = np.unique(documents.column("local").to_numpy(), return_index=True)
        block, n, name_a, name_b = (documents.column(x).to_numpy()[first] for x in ("block", "n", "name_a", "name_b"))
        sizes = np.zeros(int(local.max(initial=-1)) + 1, np.int64)
        sizes[local] = n
        shared = np.bincount(ref, minlength=len(sizes))
        good = (sizes > 0) & (shared >= rule.least(sizes))
        keep = good[ref]
        key, held, ref = key[keep], held[keep], ref[keep]
        order = np.lexsort((key, held, ref))
        key, ref = key[order], ref[order]
        cut = np.searchsorted(ref, np.arange(len(sizes) + 1))
        some = good[local]
        grams = [key[cut[i] : cut[i + 1]].tobytes() for i in local[some]]
        return pa.table([pa.array(block[some] << 32 | local[some]), pa.array(n[some]), pa.array(name_a[some]), pa.array(name_b[some]), pa.array(grams, pa.binary())], names=["set_id", "n", "name_a", "name_b", "grams"])

    return run


def _prefixes(rule: Rule):
    """The prefix of each set: its n-grams by rarity, up to one more than it may miss.  Those held by no other set come first and find nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, raws = batch.column("set_id").to_pylist(), batch.column("n").to_pylist(), batch.column("grams").to_pylist()
            keys = []
            for n, raw in zip(sizes, raws, strict=True):
                shared = len(raw) // 8
                keys.append(np.frombuffer(raw, np.int64)[: max(0, n - rule.least(n) + 1 - (n - shared))])
            many = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)), pa.array(np.repeat(np.array(ids, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int64), many))], names=["gram", "set_id", "n"])

    return run


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set as SEGMENTS sorted runs: fragments of the hash order."""
    for batch in batches:
        ids, segment, grams = [], [], []
        for set_id, raw in zip(batch.column("set_id").to_pylist(), batch.column("grams").to_pylist(), strict=True):
            key = np.sort(np.frombuffer(raw, np.uint64))
            cut = np.searchsorted(key, [(s << BITS) // SEGMENTS for s in range(SEGMENTS + 1)])
            for s in range(SEGMENTS):
                if cut[s] < cut[s + 1]:
                    ids.append(set_id)
                    segment.append(s)
                    grams.append(key[cut[s] : cut[s + 1]].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(segment, pa.int32()), pa.array(grams, pa.binary())], names=["set_id", "segment", "grams"])


def _partial_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.empty(batch.num_rows, np.int64)
        for i, (x, y) in enumerate(zip(batch.column("grams_a"), batch.column("grams_b"), strict=True)):
            both = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)])
            both.sort()
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out)], names=["a", "b", "overlap"])


def _compared(pairs: DataFrame, segments: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) whose partial overlaps add up to the threshold."""
    left, right = (segments.select(F.col("set_id").alias(x), "segment", F.col("grams").alias(f"grams_{x}")) for x in "ab")
    partial = pairs.select("a", "b").join(left, "a").join(right, ["b", "segment"]).select("a", "b", "grams_a", "grams_b").mapInArrow(_partial_overlaps, "a long, b long, overlap long")
    summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    n = lambda x: sizes.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"))
    union = F.col("n_a") + F.col("n_b") - F.col("overlap")
    return summed.join(n("a"), "a").join(n("b"), "b").where(100 * F.col("overlap") >= rule.percent * union).select("a", "b")


def tile_links(a: list[tuple[int, int, int, bytes]], b: list[tuple[int, int, int, bytes]] | None, percent: int) -> list[tuple[int, int]]:
    """Links between sets (id, n, component, n-grams) of two tiles, or within one, that join different components.

    Enough links to join every two components that any link does; not all links.
    """
    members = a + (b or [])
    key = np.concatenate([np.frombuffer(m[3], np.uint64) for m in members])
    row = np.repeat(np.arange(len(members)), [len(m[3]) // 8 for m in members])
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    column = np.cumsum(np.append(False, key[1:] != key[:-1]))
    held = np.bincount(column)
    some = held[column] > 1
    row, column = row[some], np.cumsum(held > 1)[column[some]] - 1
    split = len(a)
    overlap = np.zeros((split, len(members) - split if b else split), np.float32)
    for first in range(0, int(column.max(initial=-1)) + 1, TILE_COLUMNS):
        part = slice(*np.searchsorted(column, [first, first + TILE_COLUMNS]))
        has = np.zeros((len(members), TILE_COLUMNS), np.float32)
        has[row[part], column[part] - first] = 1
        overlap += has[:split] @ (has[split:] if b else has).T
    n = np.array([m[1] for m in members], np.int64)
    component = np.array([m[2] for m in members], np.int64)
    n_b, of_b, others = (n[split:], component[split:], b) if b else (n, component, a)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for i in range(split):
        o = overlap[i].astype(np.int64)
        linked = (100 * o >= percent * (n[i] + n_b - o)) & (of_b != component[i])
        found, at = np.unique(of_b[linked], return_index=True)
        for other, j in zip(found.tolist(), np.flatnonzero(linked)[at].tolist(), strict=True):
            x, y = root(int(component[i])), root(other)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((a[i][0], others[j][0]))
    return out


def _tile(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        raw = table.select(["set_id", "n", "component", "grams", "side", "alone"]).to_pydict()
        sides = []
        for k in (0, 1):
            held: dict[tuple[int, int, int], list[bytes]] = {}  # a set comes in its segments
            for set_id, n, component, grams, side in zip(*(raw[x] for x in ("set_id", "n", "component", "grams", "side")), strict=True):
                if side == k:
                    held.setdefault((set_id, n, component), []).append(grams)
            sides.append([(*key, b"".join(grams)) for key, grams in held.items()])
        found = tile_links(sides[0], None, rule.percent) if raw["alone"][0] else tile_links(*sides, rule.percent) if all(sides) else []
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _between_tiles(entries: DataFrame, segments: DataFrame, rule: Rule) -> DataFrame:
    """Links between sets of different components that share an n-gram, by tiles.

    ``entries``: gram, set_id, n, component.  N-grams of one family are shared by
    the same sets, so the sets that a chain of n-grams connects are dealt with
    once, as one cluster, and not for each n-gram.  Sets of a cluster's largest
    component are not compared with each other, only with the rest, and the rest
    among themselves.  A set falls into a tile by its hash.
    """
    hub = staged(entries.groupBy("gram").agg(F.min("set_id").alias("a")), "hubs")
    of = staged(components(entries.join(sent(hub), "gram").select("a", F.col("set_id").alias("b"))), "clusters")
    placed = staged(entries.select("set_id", "n", "component").distinct().join(of.select(F.col("node").alias("set_id"), F.col("component").alias("cluster")), "set_id"), "clustered")
    weight = F.sum(F.lit(1.0) / TILE_SETS + F.col("n") / TILE_GRAMS)
    by_component = placed.groupBy("cluster", "component").agg(weight.alias("weight"))
    shape = by_component.groupBy("cluster").agg(F.max(F.struct("weight", "component")).alias("top"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("many")).where("many > 1")
    shape = shape.select("cluster", F.col("top.component").alias("main"), F.ceil("top.weight").cast("int").alias("main_tiles"), F.greatest(F.lit(1), F.ceil(F.col("weight") - F.col("top.weight"))).cast("int").alias("rest_tiles"))
    main = F.col("component") == F.col("main")
    tiled = placed.join(shape, "cluster").withColumn("tile", F.pmod(F.xxhash64("set_id"), F.when(main, F.col("main_tiles")).otherwise(F.col("rest_tiles"))).cast("int"))
    # What a set takes part in: (kind, tile, other tile, its side); kind 0: rest with rest, 1: rest with main.
    cells = F.expr("""
        IF(component = main,
           transform(sequence(0, rest_tiles - 1), i -> struct(1 AS kind, i AS x, tile AS y, 1 AS side)),
           concat(transform(sequence(0, rest_tiles - 1), i -> struct(0 AS kind, least(i, tile) AS x, greatest(i, tile) AS y, IF(tile <= i, 0, 1) AS side)),
                  transform(sequence(0, main_tiles - 1), i -> struct(1 AS kind, tile AS x, i AS y, 0 AS side))))""")
    dealt = tiled.select("cluster", "set_id", "n", "component", F.explode(cells).alias("cell")).select("cluster", "set_id", "n", "component", "cell.*").withColumn("alone", (F.col("kind") == 0) & (F.col("x") == F.col("y")))
    links = dealt.join(segments.select("set_id", "grams"), "set_id").groupBy("cluster", "kind", "x", "y").applyInArrow(_tile(rule), "a long, b long")
    return reading(links, hub, of, placed)


def near_duplicates(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, content (hash of the text), n_shingles, component_id and stays of every document (doc_id long, text).

    ``stays`` is true for the rows with the least (doc_id, content) of their component.

    Words are runs of non-white characters, A-Z in lower case.  ``component_id`` is
    the least doc_id that a chain of links reaches; a document without words, or
    with a null text, has an empty set, no link, and its own doc_id.  Rows with a
    null doc_id are kept; they link, but never name a component unless all of it
    is null.  Repeated rows each have their row.  Very long texts have one set like
    others.  N-grams of one 48-bit hash are one to a pair; sets are counted and told
    apart by 64 and 128 bits.  An empty table gives no rows.  Other columns are not read.
    """
    fragments = parts_for(documents)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(_ROWS))
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInArrow(_shuffled_out(fragments, rule, schema), _ROWS)
    found = staged(dealt(out, fragments).mapInArrow(_shared_only(schema), _ROWS), "fragments")
    released(documents.sparkSession)
    # Each of the following is made of the one before, which then goes with its shuffle: the n-grams are there once, not four times.
    rows = staged(found.where("kind = 0").select("doc_id", "content", F.col("n").alias("n_shingles"), F.expr("block * 4294967296 + local").alias("set_id")), "rows")
    sets = staged(found.groupBy("block").applyInArrow(_survivors(rule), "set_id long, n long, name_a long, name_b long, grams binary"), "sets")
    dropped(found)
    # Sets that are equal in different blocks are one from here on.
    names = staged(sets.select("set_id", "n", "name_a", "name_b"), "names")
    named = names.groupBy("n", "name_a", "name_b").agg(F.min("set_id").alias("set_id"))
    kept = staged(sets.join(named.select("set_id"), "set_id", "left_semi").select("set_id", "n", "grams"), "distinct")
    dropped(sets)
    sizes, prefix = names.select("set_id", "n"), staged(kept.mapInArrow(_prefixes(rule), "gram long, set_id long, n long"), "prefixes")
    segments = staged(kept.select("set_id", "grams").mapInArrow(_segments, "set_id long, segment int, grams binary"), "segments")
    dropped(kept, collect=False)

    # Small tables are sent to where the n-grams lie: no shuffle gathers the many sets of one n-gram.
    least = staged(prefix.groupBy("gram").agg(F.min("set_id").alias("a"), F.count(F.lit(1)).alias("many")).where("many > 1"), "least")
    member = prefix.join(sent(least), "gram").where(F.col("set_id") != F.col("a")).select("a", F.col("set_id").alias("b"), "n").distinct()
    near = member.join(sizes.select(F.col("set_id").alias("a"), F.col("n").alias("n_a")), "a").where(100 * F.least("n", "n_a") >= rule.percent * F.greatest("n", "n_a"))
    star = staged(near.select("a", "b"), "star")
    links = staged(_compared(star, segments, sizes, rule), "links")
    released(documents.sparkSession)  # the n-grams of all pairs have moved
    of = staged(components(links), "components")

    # Sets that share a prefix n-gram and are not joined yet: all of them are compared, whatever their number.
    placed = prefix.join(of.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    shares = placed.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("m")).groupBy("gram").agg(F.sum("m").alias("many"), F.max(F.struct("m", "component")).alias("top")).where("many > top.m")
    shares = staged(shares.select("gram", "many"), "shares")
    open_ = staged(placed.join(sent(shares), "gram"), "apart")
    few, many = open_.where(F.col("many") <= FEW), open_.where(F.col("many") > FEW)
    x, y = few.select("gram", F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("component").alias("of_a")), few.select("gram", F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("of_b"))
    rest = x.join(y, "gram").where("a < b and of_a <> of_b").where(100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")).select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    tiled = _between_tiles(many.drop("many"), segments, rule)
    more = staged(_compared(rest, segments, sizes, rule).union(tiled), "links")
    dropped(prefix, segments, least, star, shares, open_, links, *tiled._reads)
    if not more.isEmpty():
        # The components so far are stars: only what the new links join is worked on.
        before, of = of, staged(components(more.union(of.select(F.col("node").alias("a"), F.col("component").alias("b")))), "components")
        dropped(before, collect=False)
    dropped(more)

    member_of = names.join(named.withColumnRenamed("set_id", "node"), ["n", "name_a", "name_b"]).select("set_id", "node")
    member_of = member_of.join(of, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    members = rows.join(member_of, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    # Nulls last: a document without an id names a component only if all of it has none.
    first = members.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("first"))
    linked = members.where("n_shingles > 0").join(first, "component")
    stays = linked["doc_id"].eqNullSafe(F.col("first.doc_id")) & (linked["content"] == F.col("first.content"))
    linked = linked.select("doc_id", "content", "n_shingles", F.col("first.doc_id").alias("component_id"), stays.alias("stays"))
    # A document without words is joined with nothing, though others of its block have the same (empty) set.
    own = rows.where("n_shingles = 0").select("doc_id", "content", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return reading(linked.union(own), rows, names, of)
