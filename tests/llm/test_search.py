"""URL filters, ranked search and clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelworks.llm import clustering, search, urlfilter

# --- URL filters -------------------------------------------------------------------------------------------------------


def rules_table(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def plain_verdict(url, rules, default="allow"):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = [(len((h + p).encode()), len(h.encode()), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("müller.de", "/ü", "block"), ("b.c", "/", "block"), ("c", "/xy", "allow"), ("x.net", "", "block")]
URLS = [
    None, "", "no scheme/at all", "http://", "http:///es/", "http://example.org", "http://example.org/", "HTTP://EXAMPLE.org/es/1", "http://a.b.example.org/en/12?x#y", "http://notexample.org/es/", "http://example.org?/es/", "http://example.org#/es/",
    "a://b://org/", "http://org/", "http://www.müller.de/über", "http://www.müller.de/u", "http://ÄRGER.org/x", "http://a.b.c/xy", "http://b.c/xyz", "http://x.net", "http://y.x.net/a\nb", "http://example.org:80/es/", "http://.org/", "http://org./", "http://u@fr.com/fr/", "http://fr.com/FR/", "http://fr.com/de/" + "z" * 100_000,
]


@pytest.mark.parametrize(("bits", "entries"), [(64, 1 << 20), (3, 4), (1, 1000)])
def test_urls_are_judged_like_by_each_rule(spark, bits, entries):
    """With few bits nearly all entries and probes collide, with few entries the array has several slices."""
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(None, "http://example.org/es/"), (1, "http://example.org/es/")], "page_id long, url string").withColumn("host", F.lit(7)).withColumn("rule", F.lit("clash"))
    listed = urlfilter.build_list(rules_table(spark, RULES), entries, bits)
    assert len(listed.files) == 1 or bits == 3
    got = sorted(urlfilter.judge_urls(pages, listed).collect(), key=str)
    want = [(i, *plain_verdict(u, RULES)) for i, u in [*enumerate(URLS), (None, "http://example.org/es/"), (1, "http://example.org/es/")]]
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(tuple_row(r)))
    assert got[0].asDict().keys() == {"page_id", "host", "path", "rule", "verdict"}


def tuple_row(r):
    from pyspark.sql import Row

    return Row(page_id=r[0], host=r[1], path=r[2], rule=r[3], verdict=r[4])


def test_long_lists_in_several_slices(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 3)))
    rules = list({(f"{word()}.{word()}", "/" + word()): rng.choice(["allow", "block"]) for _ in range(3000)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{word()}.{word()}.{word()}/{word()}{word()}" for _ in range(2000)]
    listed = urlfilter.build_list(rules_table(spark, rules), 500, 20)
    assert len(listed.files) > 4
    by_host = {}
    for h, p, v in rules:
        by_host.setdefault(h, []).append((h, p, v))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), listed, "block").collect()}
    for i, u in enumerate(urls):
        host = u.split("/")[2].split(".")
        near = [r for j in range(3) for r in by_host.get(".".join(host[j:]), [])]
        assert got[i] == plain_verdict(u, near, "block")


def test_url_lists_that_are_empty_repeat_or_are_wrong(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id int, url string")
    none = urlfilter.build_list(rules_table(spark, []))
    assert [tuple(r) for r in urlfilter.judge_urls(pages, none).collect()] == [(1, "a.b", "/c", None, "allow")]
    twice = urlfilter.build_list(rules_table(spark, [("A.b", None, "allow"), ("a.B", None, "block"), ("", "/", "block"), (None, "/", "block")]))
    assert [r.verdict for r in urlfilter.judge_urls(pages, twice).collect()] == ["block"]
    assert urlfilter.judge_urls(pages.limit(0), twice).count() == 0
    for odd in ("maybe", None):
        with pytest.raises(ValueError):
            urlfilter.build_list(rules_table(spark, [("a", "/", odd)]))


# --- Ranked search -----------------------------------------------------------------------------------------------------


def plain_search(docs, items, top=10):
    found = [[re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")] for _, text in docs]
    n, length = sum(1 for t in found if t), sum(map(len, found))
    df = Counter(t for words in found for t in set(words))
    out = []
    for item, text in set(items):
        asked = {re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")}
        scores = []
        for (doc, _), words in zip(docs, found, strict=True):
            tf, score = Counter(words), 0
            for t in asked & set(words):
                m = 10 + (90 * len(words) * n) // length
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, k + 1, d, -s) for k, (s, _, d) in enumerate(scores[:top])]
    return sorted(out, key=str)


def corpus(rng, n, words):
    vocabulary = [f"w{i}" for i in range(words)] + ["é", "ß9", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 1, 5, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize(("segment", "most"), [(50, 10**6), (10_000, 10**6), (70, 40)])
def test_search_ranks_like_a_full_scan(spark, segment, most):
    rng = random.Random(segment)
    docs = corpus(rng, 900, 120)
    items = [(i, " ".join(rng.choices([f"w{i}" for i in range(150)], k=rng.randint(1, 20)))) for i in range(25)]
    docs += [(d, items[3][1] + " and W1-w2,É") for d in (2000, 2000, None, None, 1999)] + [(3000, None), (None, ""), (3001, "w1 " * 60_000 + "w7")]
    items += [(90, None), (91, ""), (92, "nowhere"), (None, "w5 W5 w6"), (3, items[3][1]), (3, "w1"), (93, "é ß9 日本 É")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("item_id", F.lit("clash")).repartition(3, "doc_id")
    trace = []
    got = search.search(table, spark.createDataFrame(items, "item_id long, text string"), most_terms=most, segment_documents=segment, trace=trace).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_search(docs, items)


def test_some_items_are_proven_by_the_first_tier(spark):
    """Few documents have much of a rare term: the first tier proves them and the rest is not looked at."""
    docs = [(i, "rare " * (30 if i < 40 else 1) + f"filler{i % 7}") for i in range(4000)]
    trace = []
    items = [(0, "rare")]
    got = search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id int, text string"), trace=trace).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_search(docs, items)
    assert trace == [0]


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none, items).count() == 0
    assert search.search(some, items.limit(0)).count() == 0
    assert search.search(some, items).count() == 1  # one document: ln(4 / 3) is a weight above 0


def test_impacts_beyond_a_long(spark):
    big = search.Corpus(10**11, 10**13, np.zeros(0, np.int64))
    lengths, tf = np.array([10**8, 100]), np.array([3, 1])
    assert big.impacts(tf, lengths).tolist() == [(10**9 * t) // (1000 * t + 8 * (10 + 90 * n * 10**11 // 10**13)) for t, n in zip(tf.tolist(), lengths.tolist())]


# --- Clustering --------------------------------------------------------------------------------------------------------


def plain_clusters(rows, clusters, rounds, dimensions=64, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for step in range(rounds + 1):
        found = [nearest(v) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, k) in zip(kept, found) if k == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, found)], key=str)


def vectors_table(spark, rows, dimensions=64):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cluster", F.lit("clash")).repartition(3)


@pytest.mark.parametrize("spread", [1.0, 0.01, 3000.0])
def test_clusters_are_those_of_full_scans(spark, spread):
    """Small spreads make ties and equal centroids, large ones need other integers."""
    rng = np.random.default_rng(int(spread))
    centres = rng.normal(size=(9, 64)) * spread
    rows = [(i, (centres[i % 9] + rng.normal(size=64) * spread / 9).astype(np.float32).tolist()) for i in range(700)]
    rows += [(5, rows[6][1]), (6, rows[6][1]), (6, rows[6][1]), (None, rows[7][1]), (None, rows[8][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [None] + [1.0] * 63), (905, [float("nan")] * 64), (906, [float("inf")] + [0.0] * 63)]
    trace = []
    got = clustering.cluster_vectors(vectors_table(spark, rows), trace=trace).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_clusters(rows, 16, 3)
    assert len(trace) == 3
    if spread == 1.0:
        assert trace[-1] < 700 / 2  # bounds spare most vectors the full scan


def test_few_vectors_have_few_centroids(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    for clusters in (1, 2, 16):
        got = clustering.cluster_vectors(vectors_table(spark, rows), clusters).collect()
        assert sorted([tuple(r) for r in got], key=str) == plain_clusters(rows, clusters, 3)
    assert clustering.cluster_vectors(vectors_table(spark, [(1, None)])).collect() == []
    assert clustering.cluster_vectors(vectors_table(spark, [(1, [1.0] * 64)]).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_components_that_a_long_cannot_hold_are_left_out(spark):
    rows = [(1, [2.0**21 - 1] * 64), (2, [-(2.0**21) + 1] * 64), (3, [2.0**21] + [0.0] * 63), (4, [3e38] * 64)]
    got = clustering.cluster_vectors(vectors_table(spark, rows), 1).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain_clusters(rows[:2], 1, 3)
    assert all(r.distance < 1 << 63 for r in got)
