"""Jaccard join, components, tiling and chaining."""

import random
import re
import time
import tracemalloc

import numpy as np
import pytest

from funnelworks.llm import tiling
from funnelworks.llm.chaining import Chaining, Fenwick, _chainable, _common, aligned_parts, chain, cut_words, minimizers, repeated_passages, without_repeats
from funnelworks.llm.components import components
from funnelworks.llm.jaccard import Rule, near_duplicates, tile_links
from funnelworks.llm.tiling import Tiling, leaks, tile
from funnelworks.llm.words import window_hashes


class Union:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        while self.parent.get(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1030)] + [(5000, 5000 + i) for i in range(200)]
    u = Union()
    for a, b in links:
        u.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: u.root(x) for ab in links for x in ab if ab[0] != ab[1] or x in got}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, u = [shingles(t) for _, t in rows], Union()
    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 75 * (len(sets[i]) + len(sets[j]) - o):
                u.join(i, j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(u.root(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[u.root(i)]) for i in range(len(rows))), key=str)


def family(rng, words, copies, edits):
    out = []
    for _ in range(copies):
        w = list(words)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few", [16, 2])
def test_near_duplicates_against_brute_force(spark, few, monkeypatch):
    import funnelworks.llm.jaccard as jaccard

    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)
    rng = random.Random(3)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts = family(rng, [word() for _ in range(80)], 70, 6) + family(rng, [word() for _ in range(30)], 20, 1)
    line = " ".join(word() for _ in range(25))
    texts += [line + " " + " ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    texts += ["Same Text here and there", "same text HERE and there", "a b", "a  b", "É b", "é b", "", None, " \n", "x " * 300, "x " * 299, "a\x1cb c d e f", "one two three four five"] + [texts[0]] * 9
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(None, texts[0]), (None, "alone with no id"), (rows[0][0], rows[0][1]), (rows[1][0], rows[1][1])]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = near_duplicates(docs).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows)
    stays = [r for r in got if r["stays"] and r["n_shingles"] > 0]
    assert {(r["component_id"], r["n_shingles"] > 0) for r in got if r["n_shingles"] > 0} == {(r["component_id"], True) for r in stays}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_tiles_against_pairs():
    rng = np.random.default_rng(2)
    make = lambda k: [(k + i, 0, k + i, np.unique(rng.integers(0, 60, 25)).astype(np.uint64)) for i in range(12)]
    for alone in (True, False):
        a, b = make(0), None if alone else make(100)
        with_n = lambda t: [(i, len(g), c, g.tobytes()) for i, _, c, g in t]
        u, v = Union(), Union()
        for x in a:
            for y in a if alone else b:
                o = len(np.intersect1d(x[3], y[3]))
                if x[0] != y[0] and 100 * o >= 40 * (len(x[3]) + len(y[3]) - o):
                    u.join(x[0], y[0])
        for x, y in tile_links(with_n(a), None if alone else with_n(b), 40):
            v.join(x, y)
        ids = [x[0] for x in a + (b or [])]
        assert [u.root(i) for i in ids] == [v.root(i) for i in ids]


def test_rule():
    assert [Rule().least(n) for n in (1, 2, 3, 4, 5, 100)] == [1, 2, 3, 3, 4, 75]


def naive_tiles(item, text, least):
    used_i, used_t, out = set(), set(), []
    while True:
        best = max(
            ((n, -i, -t) for i in range(len(item)) for t in range(len(text)) for n in [next((k for k in range(min(len(item) - i, len(text) - t) + 1) if k == min(len(item) - i, len(text) - t) or item[i + k] != text[t + k] or i + k in used_i or t + k in used_t))]),
            default=(0, 0, 0),
        )
        if best[0] < least:
            return out
        n, i, t = best[0], -best[1], -best[2]
        used_i |= set(range(i, i + n))
        used_t |= set(range(t, t + n))
        out.append((i, t, n))


@pytest.mark.parametrize("pairs", [8, 0])
def test_tiles_against_naive_greedy(monkeypatch, pairs):
    """With all pairs of equal runs written out, and walked through."""
    monkeypatch.setattr(tiling, "MOST_PAIRS", pairs)
    rng = np.random.default_rng(5)
    for k in range(60):
        item, text = (rng.integers(1, 4 if k % 2 else 9, n).astype(np.uint64) for n in (rng.integers(2, 20), rng.integers(2, 40)))
        got, want = tile(item, text, 3), naive_tiles(item.tolist(), text.tolist(), 3)
        for i, t, n in got:
            assert item[i : i + n].tolist() == text[t : t + n].tolist()
        for side in (0, 1):
            places = [p for g in got for p in range(g[side], g[side] + g[2])]
            assert len(places) == len(set(places))
        assert not naive_tiles([-1 if any(i <= p < i + n for i, _, n in got) else x for p, x in enumerate(item.tolist())], [-2 if any(t <= p < t + n for _, t, n in got) else x for p, x in enumerate(text.tolist())], 3)
        assert (got[0][2] if got else 0) == (want[0][2] if want else 0)
        if k % 2 == 0:
            assert sorted(n for *_, n in got) == sorted(n for *_, n in want)


def test_tiles_of_long_repetitive_texts():
    rng = np.random.default_rng(6)
    phrases = [rng.integers(1, 1 << 40, 5).astype(np.uint64) for _ in range(4)]
    item, text = (np.concatenate([phrases[k] for k in rng.integers(0, 4, n)]) for n in (600, 6000))
    began = time.time()
    tracemalloc.start()
    found = tile(item, text, 4)
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 40e6
    tracemalloc.stop()
    assert sum(n for *_, n in found) >= 0.95 * len(item)
    assert tile(np.ones(3000, np.uint64), np.ones(30_000, np.uint64), 4) == [(0, 0, 3000)]
    assert tile(item[:3], item[:3], 4) == [(0, 0, 3)] and tile(item[:3], item[:4], 4) == []


def test_leaks_are_found_whole_and_reordered(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"p{rng.randint(0, 10**6)}" for _ in range(n))
    item = [f"q{i}" for i in range(30)]
    joined = " ".join(item)
    parts = [item[20:], item[:8], item[8:20]]
    texts = {
        1: prose(50) + " " + joined + " " + prose(50),
        2: prose(20) + " " + f" {prose(9)} ".join(" ".join(p) for p in parts),
        3: prose(30) + " " + joined.upper().replace(" ", ",  ") + "!",
        4: prose(30) + " " + " ".join(item[:17]) + " " + prose(5),
        5: prose(100),
        6: None,
        7: "",
        8: " ".join(item[::-1]),
        9: "q0 " * 400,
        10: "Too, SHORT!",
        11: "it is too short",
        12: "x " * 50_000 + joined,
    }
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, joined, "x"), (1, texts[1], "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(100, joined, 1), (101, "too short", 1), (102, None, 1), (103, "", 1), (104, prose(20), 1)], "item_id int, text string, doc_id int")
    got = leaks(docs, bench).collect()
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in got) == [("1", 100), ("1", 100), ("10", 101), ("12", 100), ("2", 100), ("3", 100), ("None", 100)]
    assert {r["covered"] for r in got if r["doc_id"] != 10} == {30}
    assert {len(r["tiles"]) for r in got if r["doc_id"] == 2} == {3}
    assert {r["doc_id"] for r in leaks(docs, bench, Tiling(coverage=0.5)).collect()} == {1, 2, 3, 4, 10, 12, None}
    assert leaks(docs.limit(0), bench).count() == 0 and leaks(docs, bench.limit(0)).count() == 0


def test_minimizers_guarantee_a_seed():
    rng = np.random.default_rng(1)
    rule = Chaining()
    base = rng.integers(1, 50, 200).astype(np.uint64)
    seeds = window_hashes(base, rule.seed)
    at = minimizers(base, rule)
    assert np.diff(at).max() <= rule.window and at.min() < rule.window and at.max() >= len(seeds) - rule.window
    for start in range(0, 180, 7):
        part = base[start : start + rule.seed + rule.window - 1]
        assert set(minimizers(part, rule) + start) <= set(at)
    assert len(minimizers(base[:3], rule)) == 0


def best_chain(anchors, rule):
    order, tail = sorted(anchors), lambda n: max(0, n - rule.seed)
    score = []
    for i, (x, y, n) in enumerate(order):
        before = [score[j] + rule.gap_cost * (a + b + 2 * m) - rule.gap_cost * (x + y) for j, (a, b, m) in enumerate(order[:i]) if a + tail(m) < x and b + tail(m) < y]
        score.append(n + max([0.0, *before]))
    return max(score, default=0.0)


def test_chains_against_quadratic_search():
    rng, rule = random.Random(4), Chaining()
    for _ in range(80):
        anchors = list({(rng.randint(0, 60), rng.randint(0, 60), rng.randint(6, 12)) for _ in range(rng.randint(1, 14))})
        found = chain(anchors, rule)
        first = found[0]
        score = sum(n for *_, n in first) - rule.gap_cost * sum((b[0] - a[0] - a[2]) + (b[1] - a[1] - a[2]) for a, b in zip(first, first[1:], strict=False))
        assert score == pytest.approx(best_chain(anchors, rule))
        assert sorted(a for c in found for a in c) == sorted(anchors)


def test_fenwick():
    tree, rng, put = Fenwick(20), random.Random(1), []
    for i in range(50):
        at, value = rng.randrange(20), rng.random()
        tree.put(at, value, i)
        put.append((at, value, i))
        k = rng.randrange(20)
        assert tree.upto(k) == max(((v, j) for p, v, j in put if p <= k), default=(float("-inf"), -1))


def passages(spark):
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    one, two = prose(60), prose(55)
    fuzzy = list(one)
    for i in (9, 25, 41):
        fuzzy[i] = "changed"
    fuzzy[30:30] = ["put", "in"]
    del fuzzy[50]
    texts = {
        1: prose(40) + one + prose(30),
        2: prose(5) + one + prose(70),
        3: prose(33) + fuzzy + prose(8),
        4: prose(12) + two[:30] + prose(50),
        5: two[:30] + prose(200),
        6: prose(90),
        7: prose(25) + one,
        8: [],
    }
    rows = [(i, "  ".join(w), "s") for i, w in texts.items()] + [(9, None, "s"), (10, " ".join(prose(70)), "s")]
    rows += [(20 + i, rows[-1][1], "s") for i in range(5)] + [(None, "  ".join(prose(3) + one), "s"), (6, rows[5][1], "s")]
    return rows, one, fuzzy


def test_repeated_passages(spark):
    rows, one, fuzzy = passages(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").coalesce(1)
    got = repeated_passages(docs).collect()
    text = {i: t.split() for i, t, _ in rows if t}
    spans = {}
    for r in got:
        spans.setdefault(r["doc_id"], []).append(r)
    assert set(spans) == {2, 3, 7, None, *range(20, 25)}
    for i in (2, 7):
        assert any(text[i][r["start"] : r["end"]] == one and r["identity"] == 1 for r in spans[i])
    for r in spans[3]:
        a, b = " ".join(text[3][r["start"] : r["end"]]), " ".join(fuzzy)
        assert a == b or len(set(a.split()) ^ set(b.split())) <= 4
    assert all(r["start"] == 0 and r["end"] == 70 for i in range(20, 25) for r in spans[i])
    assert repeated_passages(docs.limit(0)).count() == 0


def test_parts_of_a_chain_that_does_not_align(spark):
    rng, rule = random.Random(21), Chaining()
    prose = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    rows, want = [], {}
    for k, (gap, n) in enumerate([(30, 60), (65, 60), (120, 60), (250, 60), (65, 200), (200, 200), (30, 200)]):
        one, two = prose(n), prose(n)
        rows += [(2 * k, " ".join(one + prose(gap) + two)), (2 * k + 1, " ".join(one + prose(gap) + two))]
        want[2 * k + 1] = [*range(n), *range(n + gap, 2 * n + gap)]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rule).collect()
    for i, words in want.items():
        mine = [r for r in got if r["doc_id"] == i]
        assert set(words) <= {w for r in mine for w in range(r["start"], r["end"])} and all(r["identity"] >= 0.8 for r in mine)
    # 30 + 10 + 30 words are a passage; the gap within it costs more than those of the tail, at which no part is one.
    a, b, anchors, at = [], [], [], 0
    for n, gap in [(30, 10), (30, 9)] + [(6, 9)] * 12:
        same = [rng.randint(0, 10**9) for _ in range(n)]
        a += same + [rng.randint(0, 10**9) for _ in range(gap)]
        b += same + [rng.randint(0, 10**9) for _ in range(gap)]
        anchors.append((at, at, n))
        at += n + gap
    ((s, e, *_, identity),) = aligned_parts(np.array(a), np.array(b), np.array(anchors), rule)
    assert s == 0 and e >= 70 and identity >= 0.8
    # The same, found as one anchor.
    ((s, e, *_),) = aligned_parts(np.array(a), np.array(b), np.array([(0, 0, len(a))]), rule)
    assert s == 0 and e >= 70
    assert not aligned_parts(np.array(a[80:]), np.array(b[80:]), np.array([(0, 0, len(a) - 80)]), rule)


def covered(rows, doc_id):
    return {w for r in rows if r["doc_id"] == doc_id for w in range(r["start"], r["end"])}


def test_passages_whose_parts_lie_elsewhere(spark):
    """No partner of a seed has the whole passage: the halves occur apart before, between and after."""
    rng = random.Random(31)
    prose = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    whole, ten = prose(80), [prose(10) for _ in range(6)]
    pieces = lambda a, b: prose(20) + a + prose(60) + b + prose(9)
    texts = [pieces(whole[:40], []), pieces([], whole[40:]), prose(30) + whole + prose(20)] + [pieces(whole[:40], whole[40:]) for _ in range(4)] + [prose(7) + whole + prose(3)]
    texts += [pieces(ten[i], ten[j]) for i in range(6) for j in range(6)] + [sum(ten, prose(5))] + [pieces(ten[i], ten[j]) for i in range(6) for j in range(6)] + [sum(ten, prose(11))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = repeated_passages(docs).collect()
    # Document 8 of the order shares all 80 words with the third alone, which is the partner of none of its seeds.
    assert covered(got, 7) >= set(range(7, 87)) and any((r["start"], r["end"], r["other_doc_id"]) == (7, 87, 2) for r in got)
    last = len(texts) - 1
    assert covered(got, last) == set(range(11, 71)) and last - 37 in {r["other_doc_id"] for r in got if r["doc_id"] == last}
    assert not {0, 1, 2, 3, 8, last - 37} & {r["doc_id"] for r in got}


def test_fuzzy_passages_of_texts_that_are_no_partner_of_a_seed(spark):
    """What a passage's copy has unchanged occurs elsewhere piece by piece, first and just before; only one text has it whole."""
    rng = random.Random(41)
    prose = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    whole, own = prose(90), prose(90)
    changed, own_changed = ([w if i % 15 != 7 else f"new{i}" for i, w in enumerate(x)] for x in (whole, own))
    cuts = [0, *range(7, 90, 15), 90]
    pieces = lambda x: [x[a + (a > 0) : b] for a, b in zip(cuts, cuts[1:])]
    apart = lambda: [prose(9) + x + prose(50) for x in pieces(whole)]
    texts = apart() + [prose(20) + whole + prose(20)] + apart() + [prose(5) + changed + prose(3)]
    # In one document: the first places of the seeds are those of the pieces, and only the second ones are a passage.
    texts += [sum((x + prose(50) for x in pieces(own)), []) + own + prose(60) + own_changed]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = repeated_passages(docs).collect()
    last = len(texts) - 2
    assert covered(got, last) >= set(range(10, 90)) and {r["other_doc_id"] for r in got if r["doc_id"] == last} == {7}
    n = len(texts[-1])
    assert covered(got, last + 1) >= set(range(n - 85, n - 5)) and min(covered(got, last + 1)) >= n - 90
    assert all(r["identity"] >= 0.8 and r["end"] - r["start"] >= 50 for r in got) and {r["doc_id"] for r in got} == {last, last + 1}


def test_stretches_that_no_chain_goes_beyond():
    rng, rule = random.Random(42), Chaining()
    for _ in range(300):
        x = sorted(rng.sample(range(rng.choice((60, 200, 600))), rng.randint(1, 25)))
        anchors = [(a, a + rng.choice((0, 0, 0, 3, -2)) + 100, rule.seed) for a in x if rng.random() < 0.8]
        stretches = _chainable(np.zeros(len(x), np.int64), np.array(x, np.int64), rule)
        for path in chain(anchors, rule):
            first, end = path[0][0], path[-1][0]
            if end + rule.seed - first >= rule.chain_words:
                assert any(a <= first and end <= b for _, a, b in stretches)


def test_null_and_repeated_ids_and_repeats_in_one_document(spark):
    rng = random.Random(32)
    prose = lambda n: [f"w{rng.randint(0, 10**7)}" for _ in range(n)]
    one, two = prose(70), prose(60)
    changed = [w if i % 17 else "other" for i, w in enumerate(two)]
    rows = [(i, " ".join(one)) for i in (None, 2, 3, 3, None)] + [(10, " ".join(prose(8) + two + prose(30) + two + prose(5))), (11, " ".join(["and"] * 300)), (12, " ".join(prose(20) + ["and"] * 90)), (13, " ".join(prose(20) + changed + prose(3))), (14, "x " * 60_000 + "y")]
    for parts in (1, 4):
        got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        copies = {(r["doc_id"], r["other_doc_id"]) for r in got if r["doc_id"] in (None, 2, 3)}
        assert len(copies) == 2 and len({b for _, b in copies}) == 1 and {a for a, _ in copies} | {b for _, b in copies} == {None, 2, 3}
        inside = [r for r in got if r["doc_id"] == r["other_doc_id"] == 10]
        assert (98, 158) in {(r["start"], r["end"]) for r in inside} and all(r["other_end"] <= r["start"] for r in inside)
        ands = covered(got, 11), covered(got, 12)
        assert ands in ((set(range(50, 300)), set(range(20, 110))), (set(range(300)), set(range(70, 110))))
        assert covered(got, 14) == set(range(50, 60_000)) and sum(r["doc_id"] == 14 for r in got) < 3000
        assert (len(covered(got, 13)) >= 56) or len(covered(got, 10)) >= 112


def test_common_words_of_long_stretches():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 30, 90)
    b = np.concatenate([a[:40], rng.integers(30, 60, 3), a[40:]])
    assert _common(a, b) == 90
    for _ in range(20):
        x, y = rng.integers(0, 5, rng.integers(0, 80)), rng.integers(0, 5, rng.integers(0, 80))
        table = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                table[i + 1, j + 1] = table[i, j] + 1 if x[i] == y[j] else max(table[i, j + 1], table[i + 1, j])
        assert _common(x, y) == table[-1, -1]


def exact_repeats(texts, size):
    """Words of each text in runs that an earlier text has, or itself before without overlap; by looking at all runs."""
    seen, out = {}, []
    for d, words in enumerate(texts):
        mine = set()
        for i in range(len(words) - size + 1):
            first = seen.setdefault(tuple(words[i : i + size]), (d, i))
            if first[0] != d or i - first[1] >= size:
                mine |= set(range(i, i + size))
        out.append(mine)
    return out


def test_every_exact_repeat_of_a_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    rows = docs.select("doc_id", "text").collect()
    got = {}
    for r in repeated_passages(docs).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    want = exact_repeats([re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "") for r in rows], 50)
    assert sum(map(bool, want)) > 50
    for r, words in zip(rows, want, strict=True):
        assert words <= got.get(r["doc_id"], set()), r["doc_id"]


def test_cuts(spark):
    assert cut_words(b"a b  c\nd e", [(1, 3)]) == b"a \nd e"
    assert cut_words(b" a b ", [(0, 2)]) == b"  "
    assert cut_words(b"a b c", [(0, 2), (1, 3)]) == b""
    assert cut_words(b"a b c", [(2, 9), (0, 1)]) == b" b "
    rows, one, _ = passages(spark)
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t, _ in rows], "doc_id long, text string, n_chars long").coalesce(1)
    left = without_repeats(docs)
    assert left.columns == ["doc_id", "text", "n_chars"]
    kept = [(r["doc_id"], r["text"], r["n_chars"]) for r in left.collect()]
    assert sorted(str(i) for i, *_ in kept) == sorted(str(i) for i, *_ in rows if i not in range(20, 25))
    assert all(n == len(t) for _, t, n in kept if t is not None)
    whole = " ".join(one)
    assert [i for i, t, _ in kept if whole in " ".join((t or "").split())] == [1]


class _Block:
    def partitionId(self):
        return 3


def _sent_by_a_block(monkeypatch, module, run_of, columns, most):
    """Rows of runs that one block sends, with no more than about ``most`` keys gathered."""
    import pyarrow as pa

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in module._ROWS.split(", "))])
    monkeypatch.setattr(module.TaskContext, "get", classmethod(lambda cls: _Block()))
    monkeypatch.setattr(module, "PART_KEYS", most, raising=False)
    monkeypatch.setattr("funnelworks.llm.words.CHUNK_BYTES", 1 << 12)
    monkeypatch.setattr("funnelworks.llm.words.chunks.__defaults__", (1 << 12,))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "content", "text"])
    return [r for b in run_of(schema)([batch]) for r in b.to_pylist() if r["kind"] == 1]


@pytest.mark.parametrize("name", ["jaccard", "chaining"])
def test_a_large_block_sends_its_keys_in_bounded_runs(monkeypatch, name):
    from funnelworks.llm import chaining, jaccard

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 120))) for _ in range(400)]
    columns = [list(range(400)), [hash(t) for t in texts], texts]
    module, run_of = {"jaccard": (jaccard, lambda s: jaccard._shuffled_out(4, Rule(), s)), "chaining": (chaining, lambda s: chaining._seeds(4, Chaining(), s))}[name]
    keys = {}
    for most in (1 << 30, 2000):
        rows = _sent_by_a_block(monkeypatch, module, run_of, columns, most)
        keys[most] = sorted((r["fragment"], h, x, ref) for r in rows for h, x, ref in zip(np.frombuffer(r["high"], np.uint16).tolist(), np.frombuffer(r["low"], np.uint32).tolist(), np.frombuffer(r["refs"], np.uint16).tolist(), strict=True))
    assert keys[2000] == keys[1 << 30] and len(rows) > 8
    assert max(r["n" if name == "jaccard" else "n_words"] for r in rows) < 2000


def test_a_worker_holds_nothing_of_a_task_that_is_done():
    from funnelworks.llm.words import _kept, lean_after

    def run(batches):
        for b in batches:
            _kept()["table"] = b
            yield b

    assert list(lean_after(run)([1, 2])) == [1, 2] and not _kept()


def test_seeds_of_many_texts_are_those_of_each():
    from funnelworks.llm.chaining import seed_keys, seeds_of

    rng, rule = np.random.default_rng(2), Chaining()
    for _ in range(100):
        texts = [rng.integers(0, rng.integers(1, 50), rng.integers(0, rng.choice([1, 8, 12, 80]))).astype(np.uint64) for _ in range(rng.integers(0, 12))]
        text, at, key = seeds_of(np.concatenate([np.empty(0, np.uint64), *texts]), np.array([len(t) for t in texts], np.int64), rule)
        want = [(i, x, k) for i, t in enumerate(texts) for x, k in zip(*(v.tolist() for v in seed_keys(t, rule)), strict=True)]
        assert list(zip(text.tolist(), at.tolist(), key.tolist(), strict=True)) == want


def test_no_pair_with_a_passage_is_ruled_out():
    from funnelworks.llm.chaining import _pair_chains, may_align

    rng, rule, passages, out = np.random.default_rng(3), Chaining(), 0, 0
    for _ in range(300):
        a = rng.integers(0, 300, rng.integers(20, 150)).astype(np.uint64)
        b = np.concatenate([rng.integers(300, 600, 20).astype(np.uint64), np.where(rng.random(len(a)) < rng.uniform(0, 0.3), rng.integers(0, 900, len(a)), a).astype(np.uint64)])
        found = [p for c in _pair_chains(a, b, 0, len(a), False, rule) for p in aligned_parts(a, b, c, rule) if p[1] - p[0] >= rule.words and p[4] >= rule.identity]
        passages, out = passages + bool(found), out + (not may_align(a, b, rule))
        assert may_align(a, b, rule) or not found
    assert passages > 20 and out > 20


def test_pairs_that_may_reach_are_those_that_may_chain():
    from funnelworks.llm.chaining import may_chain, may_reach

    rng, rule, some, exact = np.random.default_rng(7), Chaining(), 0, 0
    for _ in range(60):
        pairs = []
        for _ in range(rng.integers(1, 12)):
            at = np.unique(rng.integers(0, rng.choice([20, 60, 400]), rng.integers(1, 40)))
            low = np.where(rng.random(len(at)) < 0.7, at + rng.integers(0, 30), rng.integers(0, 400, len(at)))
            pairs.append((at, low, low + rng.choice([0, 1]) * rng.integers(0, 9, len(at)), rng.random(len(at)) < 0.2))
        number = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
        got = may_reach(number, *(np.concatenate(x) for x in zip(*pairs, strict=True)), rule)
        for i, p in enumerate(pairs):
            want = may_chain(*p, rule)
            some, exact = some + want, exact + (p[1] != p[2]).any()
            assert (i in got) == want if (p[1] != p[2]).any() else (i in got or not want)
    assert some > 50 and exact > 50


@pytest.mark.parametrize("cells", [(1 << 17, 1 << 16), (40, 7)])
def test_no_table_has_a_row_for_each_seed_of_each_pair(spark, monkeypatch, cells):
    """Texts of one word over and over in another order each share their seeds, all with all."""
    from funnelworks.llm import chaining

    rng, rows, staged = random.Random(6), {}, chaining.staged

    def counted(table, name):
        out = staged(table, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(chaining, "staged", counted)
    monkeypatch.setattr(chaining, "CELL_SEEDS", cells[0], raising=False)
    monkeypatch.setattr(chaining, "CELL_TEXTS", cells[1], raising=False)
    texts = [" ".join(w for w in rng.sample("abcdefghijkl", 8) for _ in range(rng.randint(8, 14))) for _ in range(40)]
    texts += [" ".join([*"x" * 25, *"y" * 25, *"z" * 5]), " ".join([*"q" * 9, *"x" * 22, *"y" * 28])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = repeated_passages(docs).collect()
    assert any((r["doc_id"], r["other_doc_id"]) == (41, 40) and r["end"] - r["start"] >= 47 for r in got)
    assert 40 <= rows["open"] and rows["open-seeds"] <= rows["open"]
    assert max(rows[x] for x in rows if x.startswith("open")) < sum(len(t.split()) for t in texts)


@pytest.mark.parametrize("name", ["measures", "hits"])
def test_workers_of_the_other_stages_hold_nothing_after_a_task(monkeypatch, name):
    import public_tokenizers
    import pyarrow as pa

    from funnelworks.llm import fertility, tiling
    from funnelworks.llm.words import _kept

    def batches():
        yield pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["en"]), pa.array([5]), pa.array(["one two three four five six seven eight"])], names=["doc_id", "lang", "content", "text"])
        _kept()["table"] = "of this task"

    if name == "measures":
        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("content", pa.int64())] + [(x, kind) for x, kind, _ in fertility._MADE])
        run = fertility._measures(public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), schema, fertility.OTHERS)
    else:
        monkeypatch.setattr(tiling.TaskContext, "get", classmethod(lambda cls: _Block()))
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("tokens", pa.binary()), ("seeds", pa.list_(pa.int64()))])
        run = tiling._hits(np.full(tiling.FILTER_BITS // 8, 255, np.uint8), tiling.Tiling(), schema)
    assert sum(b.num_rows for b in run(batches())) == 1 and not _kept()


def test_a_line_of_many_texts_makes_no_pairs_alone(spark, monkeypatch):
    """Rows of the joins by seed grow with the texts that share a line, not with their square."""
    from funnelworks.llm import chaining

    monkeypatch.setattr(chaining, "CELL_SEEDS", 8)
    frame, most = type(spark.range(0)), []
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how) if how else join(self, other, on)
        if on == "seed":
            most.append(out.count())
        return out

    monkeypatch.setattr(frame, "join", counted)
    rng, rows = random.Random(5), []
    for n in (30, 90):
        words = (f"w{i}" for i in range(10**6))
        some = lambda k, words=words: [next(words) for _ in range(k)]
        line, texts = some(12), []
        for _ in range(n // 2):  # two texts share the line and another; words between differ
            other = some(12)
            texts += [some(30) + line + some(8) + other + some(30) for _ in range(2)]
        rng.shuffle(texts)
        most.clear()
        repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).count()
        rows.append(max(most))
    assert 0 < rows[1] <= 4 * rows[0]


def test_classes_lose_no_chain_that_goes_by_an_open_seed():
    from funnelworks.llm.chaining import _anchors, _ends_meet, _passable, beginnings, runs_may_chain, runs_of_stretch, runs_of_text

    rng, rule, chained = random.Random(4), Chaining(), 0
    for _ in range(1500):
        kinds, n = rng.randint(3, 14), rng.randint(2, 12)
        at = np.cumsum([rng.choice([1, 3, 5, 9, 14, 30]) for _ in range(n)])
        key, out = np.array([rng.randrange(kinds) for _ in range(n)]), np.array([rng.random() < 0.3 for _ in range(n)])
        shift, places = rng.randint(0, 40), {}
        for x, k in zip(at.tolist(), key.tolist(), strict=True):
            if rng.random() < 0.8:
                y = shift + x + rng.choice([0, 0, 0, 1, 4])
                low, high = places.get(k, (y, y))
                places[k] = (min(low, y), max(high, y)) if rng.random() < 0.2 else (low, high)
        if not places:
            continue
        seed = np.array(sorted(places))
        low, high = (np.array([places[k][i] for k in sorted(places)]) for i in range(2))
        x, y = np.array([(a, places[k][i]) for a, k in zip(at.tolist(), key.tolist(), strict=True) if k in places for i in range(2)]).T
        order = np.lexsort((x, x - y))
        chains = list(_passable(*_anchors(np.zeros(len(x), np.int64), x[order], y[order], rule)[1:], rule))
        if any(out[(at >= c[0][0]) & (at <= c[-1][0] + c[-1][2] - rule.seed)].any() for c in chains):
            chained += 1
            pairs = [(a, b) for a in runs_of_stretch(at, key, out, rule) for b in runs_of_text(seed, low, high, bool((low < high).any()), rule)]
            # A chain of a text that repeats seeds need not go by the first and last place of each alone.
            assert any(list(_ends_meet([a], [b], s, rule)) for a, b in pairs for s in a["seed"][beginnings(a, rule)].tolist())
            assert (low < high).any() or any(runs_may_chain(a, b, rule) for a, b in pairs)
    assert chained > 100


def test_classes_meet_once_whatever_seeds_they_share():
    """Over all seeds, each pair of classes that may chain is told exactly once."""
    import pyarrow as pa

    from funnelworks.llm.chaining import _ends_meet, _runs_chained, beginnings, runs_may_chain, runs_of_stretch, runs_of_text

    rng, rule = random.Random(11), Chaining()
    stretches, texts = [], []
    for _ in range(60):
        n = rng.randint(6, 12)
        at = np.cumsum([rng.choice([1, 3, 5, 9]) for _ in range(n)])
        key = np.array(sorted(rng.sample(range(14), n)))
        stretches += list(runs_of_stretch(at, key, np.array([rng.random() < 0.4 for _ in range(n)]), rule))
        high = at + (rng.random() < 0.3) * rng.choice([0, 60])
        texts += list(runs_of_text(key, at, high, bool((high > at).any()), rule))
    want, met = set(), 0
    for i, a in enumerate(stretches):
        for j, b in enumerate(texts):
            seeds = [s for s in beginnings(a, rule).nonzero()[0].tolist() if next(_ends_meet([a], [b], int(a["seed"][s]), rule), None) is not None]
            met += len(seeds) * runs_may_chain(a, b, rule)
            if seeds and runs_may_chain(a, b, rule):
                want.add((i, j))

    def of(runs, name, seed, some):
        mine = [i for i, r in enumerate(runs) if some(r, seed)]
        return pa.table([pa.array([seed] * len(mine), pa.int64()), pa.array(mine, pa.int64()), pa.array([runs[i].tobytes() for i in mine], pa.binary())], names=["seed", name, "run"])

    got = []
    for seed in range(14):
        a = of(stretches, "a", seed, lambda r, s: s in r["seed"][beginnings(r, rule)].tolist())
        b = of(texts, "b", seed, lambda r, s: s in r["seed"].tolist())
        got += [(r["a"], r["b"]) for r in _runs_chained(rule)(a, b).to_pylist()]
    assert sorted(got) == sorted(want) and len(want) > 100 and met > 2 * len(want)


@pytest.mark.parametrize("size", [12, 30, 45])
def test_texts_of_one_line_grow_no_table_with_their_square(spark, monkeypatch, size):
    """Random words and a line that all texts share, shorter than a passage; a pair has an edited passage around the line, and it alone is found."""
    from funnelworks.llm import chaining

    staged, rows = chaining.staged, {}

    def counted(table, name):
        out = staged(table, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(chaining, "staged", counted)
    most = []
    for n in (200, 400):
        rng = random.Random(size)
        some = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
        line, beside = some(size), some(60)
        texts = [some(20) + line + some(20) for _ in range(n)]
        # Beyond the line, the words of the pair are unequal, then equal again.
        texts[50] = some(20) + line + some(1) + beside[:4] + some(1) + beside[4:13] + some(60)
        texts[150] = some(9) + line + some(1) + beside[:4] + some(1) + beside[4:13] + some(9)
        docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
        rows.clear()
        got = {(r["doc_id"], r["other_doc_id"]) for r in repeated_passages(docs).collect()}
        assert got == ({(150, 50)} if size + 15 >= 50 else set())
        most.append(dict(rows))
    assert all(most[1][x] <= 2.5 * most[0].get(x, 0) + 50 for x in most[1])


def test_contexts_are_no_rows_of_their_own(spark, monkeypatch):
    """Words beside a chain: a row for each place, and a row for each part that a task has keys for, whatever number of texts has the line."""
    from funnelworks.llm import chaining

    staged, dealt, rows = chaining.staged, chaining._keys_by_part, {}

    def counted(table, name):
        rows[name] = (out := staged(table, name)).count()
        return out

    monkeypatch.setattr(chaining, "staged", counted)
    monkeypatch.setattr(chaining, "_keys_by_part", lambda parts, kinds: rows.setdefault("parts", parts) and dealt(parts, kinds))
    rng = random.Random(45)
    some = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    line = some(45)
    texts = [some(20) + line + some(20) for _ in range(100)]
    repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)).count()
    assert 100 <= rows["contexts"] == rows["chain-places"] and rows["parts"] < 100


def test_texts_meet_by_a_key_in_common(monkeypatch):
    """Keys packed by part and met there, against sets; parts of a few keys, and a few pairs at once."""
    import pyarrow as pa

    from funnelworks.llm import chaining
    from funnelworks.llm.chaining import _MET, _keys_by_part, _keys_beside, _met_by_key

    monkeypatch.setattr(chaining, "PART_KEYS", 50)
    monkeypatch.setattr(chaining, "MEETINGS", 7)
    rng = np.random.default_rng(8)
    rows, keys = [], {}
    for doc in range(60):
        v, seed, right, least = rng.integers(0, 2, 12).astype(np.uint64), int(rng.integers(2)), bool(rng.integers(2)), int(rng.integers(1, 9))
        first = int(rng.choice([-1, 0, 5]))
        rows.append((v.tobytes(), seed, right, doc, first, least))
        key, reach = _keys_beside(v, right, seed)
        keys[doc, first] = set(key[reach >= least].tolist())
    names = ["beside", "seed", "right", "doc", "first", "least"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 20], strict=True)], names=names) for i in (0, 20, 40)]
    packed = pa.Table.from_batches(list(_keys_by_part(3, _MET)(iter(batches))))
    got = set()
    for part in range(3):
        got |= {tuple(r.values()) for r in _met_by_key(packed.filter(pa.array(packed["part"].to_numpy() == part))).to_pylist()}
    want = {(d, f, p) for (d, f), k in keys.items() for (p, g), m in keys.items() if f >= 0 > g and p < d and k & m}
    assert got == want and len(want) > 50


def test_a_passage_that_leaves_a_chain_has_a_context_in_common():
    """Against the extension itself: whatever it reaches, some key of both texts reaches as far."""
    from funnelworks.llm.chaining import _extension, context_keys

    rng, rule, far = np.random.default_rng(3), Chaining(), 0
    for i in range(3000):
        n = int(rng.integers(1, 200))
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        pattern = np.resize([False, True, True], n) if i % 5 == 0 else rng.random(n) < rng.choice([0.5, 0.7, 0.9])
        pattern[: int(rng.integers(0, 6))] = True
        b = np.where(pattern | (np.arange(n) > 120), a, a + np.uint64(1))
        reach, _ = _extension(a, b, rule.drop)
        for right in (True, False):
            x, y = (v if right else v[::-1] for v in (a, b))
            (k, r), (m, _) = (context_keys(v, 0 if right else n, right, 9, rule) for v in (x, y))
            shared = r[np.isin(k, m)]
            most = int(shared.max()) if len(shared) else 0
            assert most >= min(reach, rule.words - rule.seed)
        far += reach > 50
    assert far > 100


def test_a_lesser_seed_is_where_ends_meet():
    from funnelworks.llm.chaining import _ends_meet, _meet_before, beginnings, runs_of_stretch, runs_of_text

    rng, rule, met = random.Random(17), Chaining(), 0
    for _ in range(400):
        n, kinds = rng.randint(4, 14), rng.randint(8, 20)
        at = np.cumsum([rng.choice([1, 3, 5, 9, 20]) for _ in range(n)])
        key, out = np.array([rng.randrange(kinds) for _ in range(n)]), np.array([rng.random() < 0.3 for _ in range(n)])
        seed = np.array(sorted(rng.sample(range(kinds), rng.randint(2, 8))))
        low = np.array([rng.choice([rng.randint(0, 90), *(at[key == k] + 7)]) for k in seed])
        high = low + (rng.random() < 0.4) * np.array([rng.choice([0, 60]) for _ in seed])
        for a in runs_of_stretch(at, key, out, rule):
            for b in runs_of_text(seed, low, high, bool((high > low).any()), rule):
                for s in range(kinds + 1):
                    want = any(list(_ends_meet([a], [b], t, rule)) for t in np.unique(a["seed"][beginnings(a, rule)]).tolist() if t < s)
                    met += want
                    assert _meet_before(a, b, s, rule) == want
    assert met > 200


def test_chains_of_one_anchor_are_aligned_together_as_each_alone():
    from funnelworks.llm.chaining import _pair_chains, aligned_chains

    rng, rule, many = np.random.default_rng(41), Chaining(), 0
    for _ in range(300):
        a = rng.integers(0, int(rng.choice([2, 4, 50, 10_000])), int(rng.integers(20, 400))).astype(np.uint64)
        b = np.tile(a, int(rng.integers(1, 3)))
        changed = rng.random(len(b)) < rng.choice([0, 0.02, 0.2])
        b[changed] = rng.integers(0, 10_000, changed.sum())
        chains = list(_pair_chains(a, b, 0, len(a), False, rule))
        for n in rng.integers(6, 20, 3).tolist():  # anchors that don't hold, at any place
            chains.append(np.array([[rng.integers(0, len(a) - n + 1), rng.integers(0, len(b) - n + 1), n]], np.int32))
        assert sorted(aligned_chains(a, b, chains, rule)) == sorted(p for c in chains for p in aligned_parts(a, b, c, rule))
        many += len(chains)
    assert many > 1500
    assert aligned_chains(a, b, [], rule) == []


def test_texts_with_a_passage_have_support_in_common():
    from funnelworks.llm.chaining import _least_equal, _pair_chains, aligned_chains, support

    rule, rng, passages, apart = Chaining(), random.Random(17), 0, 0
    run = lambda: [rng.randrange(5)] * rng.choice((1, 2, 7, 14, 26, 33, 41, 47, 55))
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 400, np.uint64)
    for _ in range(1500):
        a, b = (sum((run() for _ in range(rng.randrange(2, 7))), []) for _ in range(2))
        if rng.random() < 0.4:  # the same with some words changed
            at = rng.randrange(len(a))
            b = [rng.randrange(5, 400) if rng.random() < 0.12 else w for w in a[at:] + a[:at]]
        x, y = hashes[a], hashes[b]
        chains = list(_pair_chains(x, y, 0, len(x), False, rule))
        found = [p for p in aligned_chains(x, y, chains, rule) if p[1] - p[0] >= rule.words and p[4] >= rule.identity]
        common = np.intersect1d(support(x, rule.words, rule), support(y, _least_equal(rule), rule))
        passages, apart = passages + bool(found), apart + (not len(common))
        assert len(common) or not found
    assert passages > 200 and apart > 200
    assert not len(support(hashes[:0], rule.words, rule)) and support(np.tile(hashes[:2], 300), rule.words, rule) is None


def test_texts_of_words_over_and_over_meet_by_what_a_passage_has(spark, monkeypatch):
    from funnelworks.llm import chaining

    rng, sizes, whole = random.Random(23), {}, chaining.staged
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [[w for x in rng.sample(vocabulary, 7) for w in [x] * 40] for _ in range(60)]
    for t in texts:
        at = rng.randrange(8) * 40
        t[at:at] = ["all"] * 40  # all have this one
    texts[50] = texts[10][:120] + texts[50][120:]
    texts[51] = [w for x in texts[11] for w in [x]][: len(texts[11])]
    texts[51][60:63] = ["other", "words", "here"]

    def counted(df, name):
        out = whole(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(chaining, "staged", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["other_doc_id"]) for r in repeated_passages(docs).collect()}
    assert {(50, 10), (51, 11)} <= got
    # By the one word alone every two of them met.
    assert sizes["class-pairs"] < 300


def test_no_word_is_kept_after_its_text():
    import pyarrow as pa

    from funnelworks.llm.chaining import _word_hashes
    from funnelworks.llm.words import hash_words

    texts = lambda i: [" ".join(f"w{i}x{k}x{j}" for j in range(200)) for k in range(100)]
    batch = lambda i: pa.record_batch([pa.array(texts(i) + [None, ""])], names=["text"])
    rows, words = next(_word_hashes(iter([batch(0)]), np.uint64))
    assert rows.num_rows == 102 and [len(w) for w in words] == [200] * 100 + [0, 0]
    assert words[7].tolist() == hash_words(texts(0)[7].encode().split()).tolist()
    tracemalloc.start()
    try:
        assert sum(len(w) for i in range(10) for _, hashes in _word_hashes(iter([batch(i)])) for w in hashes) == 200_000
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        assert sum(len(w) for _, hashes in _word_hashes(map(batch, range(10))) for w in hashes) == 200_000
        assert tracemalloc.get_traced_memory()[1] - held < 10 << 20
    finally:
        tracemalloc.stop()


def test_each_fragment_has_a_task_of_its_own(spark):
    """By a hash of its number three and four met in one task, and in the memory of its workers."""
    from pyspark.sql import functions as F

    from funnelworks.llm.store import dealt

    rows = spark.range(510).select((F.col("id") % 51).alias("fragment"), "id")
    found = dealt(rows, 51).groupBy(F.spark_partition_id().alias("task")).agg(F.min("fragment").alias("a"), F.max("fragment").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    assert sorted((r.task, r.a, r.b, r.n) for r in found) == [(i, i, i, 10) for i in range(51)]


@pytest.mark.parametrize("most", [1, 50, 1 << 17])
def test_shared_keys_are_counted_range_by_range(monkeypatch, most):
    from funnelworks.llm import jaccard

    rng = np.random.default_rng(8)
    monkeypatch.setattr(jaccard, "COUNTED_KEYS", most)
    for sizes in ([0, 0], [1, 0], [300, 40, 0, 900], [5, 5, 5]):
        runs = [np.sort(rng.integers(0, 400, n).astype(np.uint64)) for n in sizes]
        keys, counts = np.unique(np.concatenate(runs), return_counts=True)
        shared, held = jaccard.shared_keys(runs)
        assert shared.tolist() == keys[counts > 1].tolist() and held.tolist() == counts[counts > 1].tolist()


def test_covering_passages_have_every_word_of_all():
    from funnelworks.llm.chaining import covering

    rng = random.Random(9)
    assert covering([]) == [] and covering([(7, 60, 1), (8, 61, 1), (7, 87, 2), (9, 87, 0)]) == [(7, 87, 2)]
    for _ in range(400):
        spans = [(a, a + rng.randint(3, 12), rng.randint(0, 3)) for a in (rng.randint(0, 60) for _ in range(rng.randint(1, 30)))]
        words = lambda x: {w for a, b, _ in x for w in range(a, b)}
        kept = covering(spans)
        assert set(kept) <= set(spans) and words(kept) == words(spans)
        assert all(x[1] < z[0] for x, z in zip(kept, kept[2:], strict=False)) and all(words(kept) != words([y for y in kept if y != x]) for x in kept)


def test_passages_of_words_over_and_over_are_no_row_for_each_shift():
    import pyarrow as pa

    from funnelworks.llm import chaining

    rng, rule = np.random.default_rng(12), Chaining()
    one, other = (np.concatenate([np.repeat(x, n) for x, n in zip(rng.permutation(4), rng.integers(50, 90, 4))]).astype(np.uint64) + np.uint64(7) for _ in range(2))
    kinds = {"long": pa.int64(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in f"doc long, partner long, {chaining._SPAN}".split(", "))])
    words = pa.table({"content": [1, 2], "words": [one.tobytes(), other.tobytes()]})
    pairs = pa.table({"doc": [2], "first": [0], "last": [len(other)], "content": [2], "partner": [1], "other_content": [1]})
    rows = chaining._pairs_aligned(rule, schema)(pairs, words).to_pylist()
    assert 0 < len(rows) <= 2 * len(other) / rule.words
