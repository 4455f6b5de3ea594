"""URL filters: a sorted array of 64-bit digests, memory-mapped on every executor.

A list of rules (host, path, verdict) becomes entries: one for each host, which says
how long the paths of its rules are, and one for each rule.  The entries are sorted
by the xxHash of their text and cut into slices by ranges of it.  A slice is one row
of a table in the shared folder; Spark hands its file to each executor, where it is
laid out as plain arrays once and memory-mapped by all workers, so only the pages
that are probed take memory and the list never goes through the driver.

A batch of urls probes its distinct host suffixes first, by one binary search of all
of them, and then, for hosts that have rules, the prefixes of the lengths that occur.
Equal digests are not enough: the stored text has to be the same, and entries that
share a digest are looked at one after another.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import reading, staged

#: Entries of a slice, about.
SLICE = 1 << 20
#: Spark's seed of xxHash.
_SEED = 42
#: Kinds of entries.
_HOST, _RULE = 0, 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    parts = r"://([^/?#]*)([^?#]*)"
    host, path = (F.coalesce(F.regexp_extract(url, parts, i), F.lit("")) for i in (1, 2))
    return F.translate(host, _UPPER, _LOWER), path


def _digest(text: bytes, mask: int) -> int:
    x = xxhash.xxh64_intdigest(text, _SEED) & mask
    return x - (1 << 64) if x >> 63 else x


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of a partition, sorted by digest, as one row of packed arrays."""
    held = pa.Table.from_batches(batches)
    if not len(held):
        return
    digests = held.column("digest").to_numpy()
    texts = held.column("text").cast(pa.large_binary()).to_pylist()
    payloads = held.column("payload").to_pylist()
    cells = {
        "low": pa.array(digests[:1]),
        "digests": pa.array([digests.astype(np.int64).tobytes()], pa.binary()),
        "text_ends": pa.array([np.cumsum([0, *map(len, texts)]).astype(np.int64).tobytes()], pa.binary()),
        "texts": pa.array([b"".join(texts)], pa.binary()),
        "payload_ends": pa.array([np.cumsum([0, *map(len, payloads)]).astype(np.int64).tobytes()], pa.binary()),
        "payloads": pa.array([np.array([x for p in payloads for x in p], np.int32).tobytes()], pa.binary()),
    }
    yield pa.RecordBatch.from_arrays(list(cells.values()), names=list(cells))


_ARRAYS = {"digests": np.int64, "text_ends": np.int64, "texts": np.uint8, "payload_ends": np.int64, "payloads": np.int32}


class Slice:
    """The arrays of a slice, in a file of this executor that all its workers map."""

    def __init__(self, table_file: str):
        laid_out = f"{table_file}.arrays"
        if not os.path.exists(laid_out):
            self._lay_out(table_file, laid_out)
        at = 8 * len(_ARRAYS)
        for size, (name, kind) in zip(np.fromfile(laid_out, np.int64, len(_ARRAYS)).tolist(), _ARRAYS.items(), strict=True):
            setattr(self, name, np.memmap(laid_out, kind, "r", at, (size // np.dtype(kind).itemsize,)) if size else np.empty(0, kind))
            at += -(-size // 8) * 8
        self.low = int(self.digests[0])

    @staticmethod
    def _lay_out(table_file: str, laid_out: str) -> None:
        row = pq.read_table(table_file, columns=list(_ARRAYS)).to_pylist()[0]
        own = f"{laid_out}.{os.getpid()}"
        with open(own, "wb") as out:
            out.write(np.array([len(row[name]) for name in _ARRAYS], np.int64).tobytes())
            for name in _ARRAYS:
                out.write(row[name] + bytes(-len(row[name]) % 8))
        os.replace(own, laid_out)  # whoever is last: the contents are the same

    def text(self, i: int) -> bytes:
        return self.texts[self.text_ends[i] : self.text_ends[i + 1]].tobytes()

    def payload(self, i: int) -> list[int]:
        return self.payloads[self.payload_ends[i] : self.payload_ends[i + 1]].tolist()


class DigestArray:
    """All slices, as one sorted array."""

    def __init__(self, files: list[str], mask: int):
        self.slices = sorted((Slice(f) for f in files), key=lambda s: s.low)
        self.lows = np.array([s.low for s in self.slices], np.int64)
        self.mask = mask

    def find(self, texts: list[bytes], kind: int) -> list[list[int] | None]:
        """What the list holds for each text, None if it is not there."""
        out: list[list[int] | None] = [None] * len(texts)
        if not texts or not self.slices:
            return out
        wanted = np.fromiter((_digest(t, self.mask) for t in texts), np.int64, len(texts))
        of = np.searchsorted(self.lows, wanted, "right") - 1
        for j in np.unique(of[of >= 0]).tolist():
            s, mine = self.slices[j], np.flatnonzero(of == j)
            left, right = np.searchsorted(s.digests, wanted[mine], "left"), np.searchsorted(s.digests, wanted[mine], "right")
            for i in np.flatnonzero(right > left).tolist():
                asked = texts[mine[i]]
                for at in range(left[i], right[i]):
                    payload = s.payload(at)
                    if payload[0] == kind and s.text(at) == asked:
                        out[mine[i]] = payload[1:]
                        break
        return out


def _suffixes(host: bytes) -> list[bytes]:
    """The host and every domain above it."""
    labels = host.split(b".")
    return [x for x in (b".".join(labels[i:]) for i in range(len(labels))) if x]


def judged(hosts: list[bytes], paths: list[bytes], array: DigestArray) -> list[tuple[bytes, bool] | None]:
    """For each url the longest rule that fits (host and path together; of two as long, the one with the longer host), and whether it blocks."""
    suffixes = {h: _suffixes(h) for h in dict.fromkeys(hosts)}
    distinct = list(dict.fromkeys(s for found in suffixes.values() for s in found))
    lengths = {s: x for s, x in zip(distinct, array.find(distinct, _HOST), strict=True) if x}
    ruled = {h: [(s, lengths[s]) for s in found if s in lengths] for h, found in suffixes.items()}
    asked = [[(s, p[:n]) for s, ns in ruled[h] for n in ns if n <= len(p)] for h, p in zip(hosts, paths, strict=True)]
    keys = list(dict.fromkeys(s + p for found in asked for s, p in found))
    rules = dict(zip(keys, array.find(keys, _RULE), strict=True))
    out: list[tuple[bytes, bool] | None] = []
    for found in asked:
        fits = [(len(s) + len(p), len(s), s + p) for s, p in found if rules[s + p] is not None]
        best = max(fits, default=None)
        out.append(best and (best[2], bool(rules[best[2]][0])))
    return out


@dataclass(frozen=True)
class UrlList:
    """A list of rules as executors find it: the names of its slices' files, and the table that they are of."""

    files: tuple[str, ...]
    mask: int
    table: DataFrame | None = None


def build_list(rules: DataFrame, slice_entries: int = SLICE, digest_bits: int = 64) -> UrlList:
    """Rules (host, path, verdict) as a sorted digest array on all executors.

    Hosts are lower-cased (A-Z).  A null path is empty and fits every url of the host;
    a rule without a host fits none.  Of a rule that is there twice the blocking one
    counts.  A verdict other than ``allow`` and ``block`` is a ValueError.  Fewer
    ``digest_bits`` make collisions, for tests.
    """
    if odd := rules.where(~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))).select("verdict").limit(1).collect():
        raise ValueError(f"a verdict is {odd[0]['verdict']!r}; it can be allow or block")
    clean = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("verdict") == "block").alias("block")).where("host <> ''")
    one = clean.groupBy("host", "path").agg(F.max("block").alias("block"))
    by_host = one.groupBy("host").agg(F.sort_array(F.collect_set(F.octet_length("path"))).alias("lengths"))
    entries = one.select(F.concat("host", "path").alias("text"), F.array(F.lit(_RULE), F.col("block").cast("int")).alias("payload"))
    entries = entries.union(by_host.select("host", F.concat(F.array(F.lit(_HOST)), "lengths")))
    mask = (1 << digest_bits) - 1
    digest = F.xxhash64("text") if digest_bits == 64 else F.xxhash64("text").bitwiseAND(F.lit(mask))
    entries = staged(entries.select(digest.alias("digest"), "text", "payload"), "rules")
    slices = -(-entries.count() // slice_entries)
    if not slices:
        return UrlList((), mask, entries)
    spread = entries.repartitionByRange(slices, "digest").sortWithinPartitions("digest", "text")
    table = staged(spread.mapInArrow(_sliced, "low long, digests binary, text_ends binary, texts binary, payload_ends binary, payloads binary"), "digests")
    files = [str(f) for f in table.inputFiles()]
    for f in files:
        rules.sparkSession.sparkContext.addFile(f)
    return UrlList(tuple(f.rsplit("/", 1)[-1] for f in files), mask, table)


def judge_urls(pages: DataFrame, rules: UrlList, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    ``pages`` has page_id and url; other columns are not read.  A rule fits its host and
    all subdomains if the url's path starts with the rule's, byte for byte; the longest
    wins (host and path together, then the longer host).  ``rule`` is its text,
    null where none fits, and then the verdict is ``default``: what is not in the list.  A
    null url, or one without ``://``, has an empty host and path and fits no rule.
    Repeated rows are judged each; no pages, no rows.
    """
    files, mask = list(rules.files), rules.mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray([SparkFiles.get(f) for f in files], mask)
        for b in batches:
            hosts, paths = (b.column(name).cast(pa.large_binary()).to_pylist() for name in ("host", "path"))
            found = judged(hosts, paths, array)
            rule = pa.array([f and f[0].decode() for f in found], pa.string())
            verdict = pa.array([("block" if f[1] else "allow") if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("page_id", "host", "path")), rule, verdict], names=["page_id", "host", "path", "rule", "verdict"])

    host, path = host_and_path(F.col("url"))
    kind = pages.schema["page_id"].dataType.simpleString()
    judged_pages = pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
    return judged_pages if rules.table is None else reading(judged_pages, rules.table)
