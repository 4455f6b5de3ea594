"""Toxicity, perplexity and languages."""

import itertools
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from funnelworks.llm import kneser_ney, langid, toxicity


def test_gradients_are_right():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    vectors, real = rng.standard_normal((4, 6, 16)) * 0.5, np.ones((4, 6), bool)
    real[1, 4:] = False
    gates = net.projected(vectors.reshape(-1, 16)).reshape(4, 6, 2, -1)
    y = np.array([1.0, 0, 1, 0])

    def loss():
        logit, _ = net.forward(gates, real)
        return float(np.mean(np.logaddexp(0, logit) - y * logit))

    logit, held = net.forward(gates, real, keep=True)
    g, d_gates = net.backward((toxicity._sigmoid(logit) - y) / 4, gates, held)
    for x, d in [(net.p[k], g[k]) for k in g] + [(gates, d_gates)]:
        at = tuple(rng.integers(0, n) for n in x.shape)
        keep, e = x[at], 1e-4
        x[at] = keep + e
        up = loss()
        x[at] = keep - e
        down = loss()
        x[at] = keep
        assert (up - down) / (2 * e) == pytest.approx(d[at], abs=2e-5)


def test_windows_cover_and_overlap():
    text, start, size = toxicity.windows(np.array([0, 5, 32, 33, 100]))
    assert Counter(text.tolist()) == Counter({1: 1, 2: 1, 3: 2, 4: 6})
    for k, n in enumerate([0, 5, 32, 33, 100]):
        begin = [0, 0, 5, 37, 70][k]
        assert {i - begin for s, m in zip(start[text == k], size[text == k]) for i in range(s, s + m)} == set(range(n))


def test_words_before_a_short_text_do_not_change_its_score():
    model = toxicity.ToxicityModel(toxicity.Network(7))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_windows", pa.int64())])

    def score(texts):
        rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        return [x for b in toxicity._score(model, schema)(iter([rows])) for x in b.column("score").to_pylist()]

    short, long = "you are a bad one", " ".join(f"word{i}" for i in range(77))
    alone = score([short]) + score([long])
    for first in ("zebra", "other words", "", long):
        assert score([first, short, long])[1:] == pytest.approx(alone, abs=1e-7)


def test_windows_side_by_side_have_the_logits_of_training():
    rng = np.random.default_rng(3)
    net = toxicity.Network(3)
    words = [f"{i * 7919}x{i % 7}".encode() for i in range(900)]
    vectors = net.vectors(*toxicity.inputs(words))
    _, start, size = toxicity.windows(np.array([5, 0, 32, 33, 700, 1, 20_000]))
    ids = rng.integers(0, len(words), 20_771)
    assert len(start) > 2 * toxicity.TOGETHER
    grid, real = toxicity._grid(ids, start, size)
    want = net.forward(net.projected(vectors)[grid], real)[0]
    assert toxicity.window_logits(net, vectors, ids, start, size) == pytest.approx(want, abs=1e-5)


def test_inputs_are_those_of_each_word_alone():
    words = [w.encode() for w in "Hello, WORLD ΟΔΟΣ ΣΑΣ straße İstanbul 'quoted' ... idiot! a 日本語 \x85q d\x1cx".split(" ")]
    word, grams, of = toxicity.inputs(words)
    for i, w in enumerate(words):
        alone = toxicity.inputs([w])
        assert alone[0][0] == word[i] and alone[1].tolist() == grams[of == i].tolist()
    assert [len(x) for x in toxicity.inputs([])] == [0, 0, 0]


def test_toxicity_finds_words_and_their_forms(spark):
    rng = random.Random(1)
    stem = lambda: "".join(rng.choice(["the", "an", "er", "on", "lo", "ti"]) for _ in range(rng.randint(1, 3)))
    bad = lambda: rng.choice(["vexgrom" + rng.choice("aeiou") + stem(), "idiot"])
    rows = []
    for i in range(1500):
        words, toxic = [stem() for _ in range(rng.randint(5, 120))], i % 3 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randint(0, len(words)), bad())
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows + [(9000, None, None), (9001, "", None), (None, "some idiot here", None)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, t) for i, _, t in rows if i < 1200] + [(None, 1), (9001, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == 1503 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(t, got[i]["score"] >= 0.3) for i, _, t in rows if i >= 1200]
    assert sum(t == p for t, p in held) >= 0.95 * len(held)
    assert got[9000]["score"] == got[9001]["score"] == model.floor and got[None]["score"] > 0.5
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_a_labelled_id_that_is_repeated_is_learned_once(spark, monkeypatch):
    rows = [(1, "bad words here"), (2, "good words here")] + [(1, f"copy {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels, bounds: seen.append((texts, labels)))
    toxicity.train(docs, spark.createDataFrame([(1, 1), (2, 0), (1, 1), (None, 1)], "doc_id long, toxic int"))
    assert seen == [([b"bad words here", b"good words here"], [1, 0])]


def test_toxicity_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert 0 <= toxicity.score_toxicity(docs, model).first()["score"] < 0.5
    empty = toxicity.train(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= toxicity.score_toxicity(docs, empty).first()["score"] <= 1


def brute_perplexity(train, texts):
    keep = {w for t in train for w in t.split()}
    seq = lambda t: ["<s>", *[w if w in keep else "<unk>" for w in t.split()], "</s>"]
    c = Counter(p for t in train if t.split() for p in itertools.pairwise(seq(t)))
    size = len(keep) + 3
    of = Counter(c.values())
    before = Counter(w for _, w in c)
    d = kneser_ney.discounts(*(of[k] for k in (1, 2, 3, 4)))
    low = kneser_ney.discounts(*(Counter(before.values())[k] for k in (1, 2, 3, 4)))
    dis = lambda n, ds: ds[min(n, 3) - 1] if n else 0.0
    total, after = sum(before.values()), defaultdict(list)
    for (h, _), n in c.items():
        after[h].append(n)
    spare = sum(dis(n, low) for n in before.values()) / max(total, 1) if before else 1.0
    q = lambda w: (before[w] - dis(before[w], low)) / max(total, 1) + spare / size

    def p(h, w):
        if h not in after:
            return q(w)
        g = sum(dis(n, d) for n in after[h]) / sum(after[h])
        n = c[(h, w)]
        return max(n - dis(n, d), 0) / sum(after[h]) + g * q(w)

    for h in list(after)[:5] + ["never"]:
        assert sum(p(h, w) for w in [*keep, "<unk>", "<s>", "</s>"]) == pytest.approx(1, abs=1e-9)
    return [sum(math.log(p(h, w)) for h, w in itertools.pairwise(seq(t))) if t and t.split() else 0.0 for t in texts]


@pytest.mark.parametrize(("words", "bigrams"), [(1 << 20, 1 << 21), (42, 30), (15, 40), (0, 0)])
def test_perplexity_against_brute_force(spark, words, bigrams):
    """What is sent to the executors (all, some or nothing) does not matter to the result."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(40)], k=rng.randint(1, 60)))
    train, texts = [text() + f" once{i}" * (i % 5 == 0) for i in range(60)], [text() + f" once{i}" * (i % 2) + " new word" * (i % 3) for i in range(30)] + ["", None, "w0", "w3 w1 new " * 20_000]
    docs = spark.createDataFrame([(i, t, "en", 0.5) for i, t in enumerate(texts)] + [(None, "w1 w2", None, 0.5)], "doc_id long, text string, lang string, base double")
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train] + [(None,), ("",)], "text string").repartition(3), words, bigrams)
    got = {r["doc_id"]: r for r in kneser_ney.score(docs, model).collect()}
    want = brute_perplexity(train, texts)
    assert len(got) == len(texts) + 1
    for i, x in enumerate(want):
        assert got[i]["log_probability"] == pytest.approx(x, rel=1e-5, abs=1e-5)
        assert got[i]["n_tokens"] == (len(texts[i].split()) + 1 if texts[i] and texts[i].split() else 0)


def test_all_trusted_words_count(spark):
    words = [f"w{i}" for i in range(70_000)]
    train = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in train], "text string"))
    assert len(words) - 5 <= model.n_words <= len(words)  # words of one 32-bit hash are one
    texts = ["w50 w51", "w69950 w69951", "w50 w52", "w50 other"]
    got = {r["doc_id"]: r["log_probability"] for r in kneser_ney.score(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), model).collect()}
    assert got[0] == pytest.approx(got[1]) and got[0] > got[2] > got[3]


def test_keys_are_a_bijection_and_counts_do_not_wrap():
    rng = np.random.default_rng(4)
    h, w = rng.integers(0, 1 << 32, 1000, np.uint64), rng.integers(0, 1 << 32, 1000, np.uint64)
    back = kneser_ney._words_of(kneser_ney._key(h, w))
    assert (back[0] == h).all() and (back[1] == w).all()
    many = np.array([1, 5_000_000_000, 1 << 60])
    assert kneser_ney._from_planes(kneser_ney._planes(many)).tolist() == many.tolist()
    keys = np.sort(kneser_ney._key(h, w))
    assert (kneser_ney._keys_of(kneser_ney._key_bytes(keys)) == keys).all()


def test_planes_are_compressed_each_by_itself():
    rng = np.random.default_rng(5)
    refs = rng.integers(0, 8000, 30_000)
    assert len(kneser_ney._planes(refs)) < 52_000
    for x in (refs, refs[:1], refs[:0], np.array([0, 2**64 - 1, 5], np.uint64), np.zeros(9, np.int64)):
        assert (kneser_ney._from_planes(kneser_ney._planes(x)) == x.astype(np.uint64)).all()


def test_perplexity_thresholds(spark):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat"], k=40))
    rows = [(i, good(), "en") for i in range(200)] + [(1000, " ".join(f"z{rng.random()}" for _ in range(40)), "en"), (1001, None, "en"), (1002, good(), None)]
    docs, trusted = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i,) for i in range(150)] + [(None,)], "doc_id long")
    got = {r["doc_id"]: r for r in kneser_ney.perplexities(docs, trusted, kneser_ney.Calibration(least=5)).collect()}
    assert sum(got[i]["kept"] for i in range(200)) >= 190
    assert not got[1000]["kept"] and not got[1001]["kept"] and got[1001]["log_perplexity"] is None and got[1002]["kept"]
    none = kneser_ney.perplexities(docs, trusted.limit(0)).collect()
    assert len(none) == 203 and sum(r["kept"] for r in none) == 202
    assert kneser_ney.perplexities(docs.limit(0), trusted).count() == 0


@pytest.mark.parametrize(("few", "chunk"), [(16, 1 << 19), (0, 1 << 19), (16, 6), (0, 3)])
def test_viterbi_against_all_paths(monkeypatch, few, chunk):
    """By lists and by arrays, all words at once and one or two at a time."""
    monkeypatch.setattr(langid, "FEW_LANGUAGES", few)
    monkeypatch.setattr(langid, "CHUNK_SCORES", chunk)
    rng = np.random.default_rng(3)
    for _ in range(30):
        score = -np.abs(rng.standard_normal((6, 3))) * 3
        best = max(itertools.product(range(3), repeat=6), key=lambda p: sum(score[t, k] for t, k in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p)))
        assert tuple(langid.viterbi(score.astype(np.float32), 2.0).tolist()) == best
        ids = rng.integers(0, 6, 40)
        assert langid.viterbi(score, 2.0, ids).tolist() == langid.viterbi(score[ids], 2.0).tolist()


def test_viterbi_of_a_very_long_text_in_many_languages():
    """A million words and 200 languages in under 300 MB, three quarters of which would be the words' scores alone."""
    rng = np.random.default_rng(4)
    score = -np.abs(rng.standard_normal((3000, 200))).astype(np.float32) * 3
    ids = rng.integers(0, 3000, 1_000_000)
    tracemalloc.start()
    path = langid.viterbi(score, 4.0, ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6 and len(path) == len(ids) and len(np.unique(path)) > 1


def test_languages_of_long_repeated_and_equal_texts(spark):
    """Equal languages tie by name; a text of a million words is labelled whole; repeated rows each."""
    rows = [("aba bab", "b"), ("aba bab", "a"), ("xyx yxy", "c")] * 20
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    docs = spark.createDataFrame([(1, "aba bab aba"), (1, "aba bab aba"), (2, "xyx yxy " * 250_000 + "aba bab " * 250_000), (2, None)], "doc_id long, text string").withColumn("lang_pred", F.lit("clash"))
    got = langid.label_languages(docs, model).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got[:2]] == [(1, "a")] * 2 and got[3]["lang_pred"] == "und"
    assert [(s["start"], s["end"], s["lang"]) for s in got[2]["spans"]] == [(0, 500_000, "c"), (500_000, 1_000_000, "a")]


def test_languages_and_spans(spark):
    rng = random.Random(2)
    syllables = {"en": ["the", "ing", "ough", "wh"], "de": ["sch", "ung", "keit", "ü"], "ru": ["ка", "про", "ени", "ст"], "zh": ["中", "文", "字", "的"]}
    text = lambda g, n: " ".join("".join(rng.choices(syllables[g], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(g, 30), g) for i, g in enumerate(itertools.islice(itertools.cycle(syllables), 80))]
    model = langid.train(spark.createDataFrame(rows + [(0, None, "en"), (0, "x", None)], "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en", "ru", "zh")
    mixed = text("en", 30) + " " + text("de", 40)
    docs = spark.createDataFrame([(i, text(g, 20), 1.0) for i, g in enumerate(syllables)] + [(10, mixed, 1.0), (11, None, 1.0), (12, "123 !?", 1.0), (13, "", 1.0), (None, text("ru", 9), 1.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in langid.label_languages(docs, model).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == list(syllables)
    assert [(s["start"], s["end"], s["lang"]) for s in got[10]["spans"]] == [(0, 30, "en"), (30, 70, "de")]
    assert got[10]["lang_pred"] == "de" and 0.4 < got[10]["score"] < 0.8
    assert [got[i]["lang_pred"] for i in (11, 12, 13)] == ["und"] * 3 and got[None]["lang_pred"] == "ru"
    nothing = langid.train(docs.selectExpr("text", "CAST(NULL AS STRING) AS lang"))
    assert langid.label_languages(docs, nothing).where("lang_pred <> 'und'").count() == 0
    assert langid.label_languages(docs.limit(0), model).count() == 0


def test_three_hundred_languages_over_many_tasks(spark):
    """Counts of many tasks go up a tree, and there is no limit of 128 languages."""
    rng = random.Random(12)
    words = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for i in range(300)}
    rows = [(i, " ".join(words[lang] * 3), lang) for i, lang in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(9)
    model = langid.train(docs)
    assert len(model.languages) == 300
    got = {r["doc_id"]: r["lang_pred"] for r in langid.label_languages(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 290
    mixed = spark.createDataFrame([(1, " ".join(words["l290"] * 9 + words["l005"] * 9))], "doc_id long, text string")
    assert [s["lang"] for s in langid.label_languages(mixed, model).first()["spans"]] == ["l290", "l005"]


def test_tree_of_sums(spark):
    from funnelworks.llm.store import added_by_tree

    parts = spark.createDataFrame([("a" if b % 3 else "b", b, np.array([b, 1], np.int64).tobytes()) for b in range(200)], "k string, block int, x binary")
    got = {r["k"]: np.frombuffer(r["x"], np.int64).tolist() for r in added_by_tree(parts, ["k"], langid._sum, fan=4).collect()}
    assert got == {k: [sum(b for b in range(200) if (b % 3 > 0) == (k == "a")), sum((b % 3 > 0) == (k == "a") for b in range(200))] for k in "ab"}
