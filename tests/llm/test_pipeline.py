"""The pipeline's stages, the registered queries, and their results on the small test data."""

import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_pairs import exact_repeats

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": {"doc_id", "item_id"},
    "op2": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op3": {"doc_id", "paragraph", "family", "confirmed"},
    "op4": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op5": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op6": {"doc_id", "held_out", "score", "predicted"},
    "op7": {"doc_id", "n_shingles", "component_id"},
    "op8": {"doc_id", "log_perplexity", "kept"},
    "op9": {"doc_id", "held_out", "lang_pred", "score"},
    "op10": {"doc_id", "other_doc_id", "start", "end"},
    "op11": {"page_id", "host", "path", "rule", "verdict"},
    "op12": {"item_id", "rank", "doc_id", "score"},
    "op13": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
}


def test_every_operator_has_a_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(n.split("_")[0] for n in names) == sorted(COLUMNS)
    assert "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n.startswith("op")))
def test_query_runs_over_the_whole_table(spark, name):
    df = entry.queries()[name](spark, SMALL)
    assert COLUMNS[name.split("_")[0]] <= set(df.columns)
    n, rows = spark.read.parquet(f"{SMALL}/documents.parquet").count(), df.count()
    assert rows == n if name.split("_")[0] in ("op4", "op5", "op6", "op7", "op8", "op9") else rows >= n if name.startswith("op2") else rows > 0


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(3)
    vocabulary = [a + b for a in ("the", "an", "er", "on", "in") for b in ("", "re", "st", "ing", "tion")]
    prose = lambda n: [rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]
    base, passage, item = prose(150), prose(70), prose(30)
    near = list(base)
    near[70] = "other"
    texts = {i: prose(120) for i in range(40)}
    texts |= {100: base, 101: near, 102: base, 103: prose(60) + passage + prose(60), 104: prose(80) + passage + prose(40), 105: prose(50) + item + prose(70), 106: ["few"] * 5, 107: "one two three four five six seven eight nine".split() * 9}
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in texts.items()] + [(200, None, None, None, None), (201, "", "en", "s", 0), (None, " ".join(prose(100)), "en", "s", None), (0, " ".join(texts[0]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf_dir, at, seen = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{tmp_path}/{name.replace(' ', '')}"
        stage(spark, at, sf_dir).write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == docs.columns
        seen.append(Counter(r["doc_id"] for r in at.select("doc_id").collect()))
    rules, near_copies, passages, clean = seen
    assert not {106, 107, 200, 201} & set(rules) and set(range(40)) | {100, 101, 102, 103, 104, 105, None} <= set(rules) and rules[0] == 2
    assert {100, 101, 102} & set(near_copies) == {100} and near_copies[0] == 1 and None in near_copies
    assert passages == near_copies
    texts_left = {r["doc_id"]: r["text"] for r in at.collect()}
    assert sum(" ".join(passage) in t for t in texts_left.values()) == 1
    assert set(passages) - set(clean) == {105}
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(clean)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


@pytest.mark.parametrize("more", [[], [(7, "x y z a b c d"), (7, "x y z a b c d")]])
def test_a_row_does_not_depend_on_unrelated_rows(spark, more):
    rows = [(5, None), (5, None), (6, ""), (6, ""), (None, "p q r s t u"), (None, "p q r s t u"), (1, "a b")]
    docs = spark.createDataFrame([(*r, "en", "s") for r in rows + more], "doc_id long, text string, lang string, found_id string")
    out = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SMALL).collect())
    assert out == Counter(rows[:5] + rows[6:] + more[:1])


def test_stages_against_brute_force(spark, tmp_path):
    """What each stage leaves of a test table has nothing more of what it takes out, and misses nothing else."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at, left = spark.read.parquet(f"{SMALL}/documents.parquet").coalesce(1), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, SMALL).coalesce(1).write.parquet(f"{tmp_path}/{i}")
        at = spark.read.parquet(f"{tmp_path}/{i}").coalesce(1)
        left.append({r["doc_id"]: r["text"] for r in at.collect()})
    first = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for i, t in first.items():
        w = words(t)
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        assert (i in left[0]) <= (len(w) >= 20 and 100 * len(repeated) <= 30 * len(w))

    def grams(t):
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: grams(t) for i, t in left[0].items()}
    like = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    kept = sorted(left[1])
    assert not any(like(a, b) for n, a in enumerate(kept) for b in kept[n + 1 :])
    assert all(any(like(i, j) for j in left[0] if j != i) for i in set(left[0]) - set(left[1]))
    assert any(exact_repeats([words(t) for t in left[1].values()], 50)) and not any(exact_repeats([words(t) for t in left[2].values()], 50))
    assert set(left[2]) <= set(left[1])
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    plain = lambda t: " ".join(re.sub(r"[^a-z0-9 ]", "", w.lower()) for w in words(t))
    assert not any(plain(q) in plain(t) for q in items.values() for t in left[3].values())
    assert all(any(len(set(plain(q).split()) & set(plain(left[2][i]).split())) >= 0.5 * len(set(plain(q).split())) for q in items.values()) for i in set(left[2]) - set(left[3]))


def test_stages_on_nothing(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = entry.queries()["op6_toxicity"](spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["toxic"] for r in scored) >= 0.85 * len(scored)
    langs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = entry.queries()["op9_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(langs, "doc_id").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in found) >= 0.97 * len(found)


def test_the_drivers_free_native_memory_goes_back_with_every_table(spark, monkeypatch):
    from funnelworks.llm import store

    assert store.trimmed(spark)
    asked, whole = [], store.trimmed
    monkeypatch.setattr(store, "trimmed", lambda s: asked.append(whole(s)))
    for share in (1.0, 0.0):  # whether or not the heap is collected
        monkeypatch.setattr(store, "HEAP_SHARE", share)
        store.dropped(store.staged(spark.range(3), "few"), collect=False)
    assert asked == [True, True]
