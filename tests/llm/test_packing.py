import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from funnelworks.llm.packing import _STOP, TokenTable, _Bins, _fill, local_search, next_fit, pack_documents, packed, places, tokenise

PATH = public_tokenizers.path("word_bpe_49k.json")
TABLE = TokenTable(PATH)
UNTOUCHED = Tokenizer.from_file(PATH)


def pieces_of(plan):
    return Counter({s: sum(n * bins for p, bins in plan.items() for size, n in p if size == s) for s in {size for p in plan for size, _ in p}})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_next_fit_and_search_place_every_piece(lengths):
    plan = next_fit(Counter(lengths), 40)
    assert pieces_of(plan) == Counter(lengths)
    assert all(_fill(p) <= 40 for p in plan)
    after = local_search(plan, 40)
    assert pieces_of(after) == pieces_of(packed(Counter(lengths), 40, 2)) == Counter(lengths)
    assert all(0 < _fill(p) <= 40 for p in after)
    assert sum(after.values()) <= sum(plan.values())
    assert sum(n * _fill(p) ** 2 for p, n in after.items()) >= sum(n * _fill(p) ** 2 for p, n in plan.items())


def fewest_bins(lengths, capacity):
    """By trying everything."""
    best = [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_search_is_at_most_one_above_the_optimum():
    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted((rng.randint(1, 20) for _ in range(rng.randint(0, 11))), reverse=True)
        got = sum(packed(Counter(lengths), 20).values())
        assert fewest_bins(lengths, 20) <= got <= fewest_bins(lengths, 20) + 1, lengths


def test_local_search_empties_bins():
    # Three bins, which two exchanges turn into two full ones and an empty one.
    plan = Counter({((6, 1), (2, 1)): 1, ((5, 1), (3, 1)): 1, ((2, 2),): 1})
    assert sum(local_search(plan, 10).values()) == 2
    # A two-for-one with a full bin leaves the sum as it is and lets the last bin empty.
    assert sum(local_search(Counter({((6, 1), (2, 2)): 1, ((4, 1),): 1, ((8, 1),): 2}), 10).values()) == 3


def exchanged(fuller, emptier):
    bins = _Bins(Counter({fuller: 1, emptier: 1}), 10)
    return None if bins.exchange(emptier) is None else set(bins.count)


def test_exchange_takes_one_for_one_and_two_for_one():
    assert exchanged(((6, 1), (3, 1)), ((4, 1),)) == {((6, 1), (4, 1)), ((3, 1),)}
    assert exchanged(((6, 1), (3, 1)), ((2, 2),)) == {((6, 1), (2, 2)), ((3, 1),)}
    assert exchanged(((4, 1), (3, 1), (2, 1)), ((6, 1),)) == {((6, 1), (4, 1)), ((3, 1), (2, 1))}
    assert exchanged(((9, 1),), ((1, 1),)) == {((9, 1), (1, 1))}
    assert exchanged(((10, 1),), ((5, 1),)) is None


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_search_empties_bins_on_the_lengths_of_a_table(spark, sf):
    lengths = tokenise(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"), PATH, with_ids=False)
    counts = {r["length"]: r["count"] for r in lengths.groupBy("length").count().collect()}
    first = next_fit(counts, 2048)
    last = packed(counts, 2048)
    fewest = -(-sum(size * n for size, n in counts.items()) // 2048)
    assert pieces_of(last) == pieces_of(first) == Counter(counts)
    assert fewest <= sum(last.values()) <= fewest + 1 < 0.9 * sum(first.values())


def test_places_are_gapless():
    plan = local_search(next_fit(Counter(random.Random(1).choices(range(1, 30), k=200)), 30), 30)
    where, taken = places(plan), []
    for size, n in pieces_of(plan).items():
        first, sequence, offset, each = where[size]
        for r in range(n):
            k = int(np.searchsorted(first, r, "right")) - 1
            taken.append((int(sequence[k] + (r - first[k]) // each[k]), int(offset[k] + (r - first[k]) % each[k] * size), size))
    end = {}
    for seq, off, size in sorted(taken):
        assert off == end.get(seq, 0)
        end[seq] = off + size
    assert len(end) == sum(plan.values()) and max(end.values()) <= 30


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abAB.,'sdtÉßİΣ́   \n\t\x1c\x85!<|endoftext|>12３中🙂"), max_size=40))
def test_tokens_of_words_are_tokens_of_the_text(text):
    ids = TABLE.ids(_STOP.sub(rb" \1", text.encode().lower()).split())
    starts, counts = TABLE.settle()
    got = [int(x) for w in ids for x in TABLE.flat[starts[w] : starts[w] + counts[w]]]
    if TABLE.whole(text.encode()) is not None:
        got = TABLE.whole(text.encode()).tolist()
    assert got == UNTOUCHED.encode(text, add_special_tokens=False).ids


def test_pack_documents_round_trip(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["The", "of", "thanon", "éa.", "x|y", "1234"]) for _ in range(rng.choice([1, 5, 40, 300]))) for _ in range(60)]
    texts += ["hello <|endoftext|> world", "x<|startoftext|>y <|EndOfText|>", "word, " * 30_000]
    rows = [(i, t, "z") for i, t in enumerate(texts)] + [(100, None, "z"), (101, "", "z"), (None, "no id", "z"), (5, texts[5], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    out = pack_documents(docs, PATH, capacity=64).collect()
    by_doc = Counter()
    want = Counter()
    for doc_id, text, _ in rows:
        ids = np.array([*UNTOUCHED.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 64)):
            raw = ids[at : at + 64].tobytes()
            want[(doc_id, k, at, len(raw) // 4, zlib.crc32(raw), raw)] += 1
    for r in out:
        by_doc[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"]))] += 1
    assert by_doc == want
    end = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == end.get(r["sequence_id"], 0)
        end[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(end.values()) <= 64
    assert len(end) <= -(-sum(r["length"] for r in out) // 64) + 2
    assert pack_documents(docs.limit(0), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.,  \n1\té", max_size=30))
def test_stops_are_split_off_mark_by_mark(text):
    from funnelworks.llm.packing import _stops_apart

    raw = text.encode()
    assert _stops_apart(raw) == _STOP.sub(rb" \1", raw)


def test_stops_are_split_off_fast():
    from funnelworks.llm.packing import _stops_apart

    text = b"some words of a text, and more. " * 40_000
    took = []
    for split in (lambda: _STOP.sub(rb" \1", text), lambda: _stops_apart(text)):
        began = time.process_time()
        split()
        took.append(time.process_time() - began)
    assert took[1] < 0.6 * took[0]


def test_letters_go_to_the_model_at_once_with_the_ids_of_the_whole_tokenizer():
    from funnelworks.llm.packing import _stops_apart

    table, rng, seen = TokenTable(PATH), random.Random(1), []

    class Watched:
        def encode(self, words, **options):
            seen.extend(words)
            return UNTOUCHED.encode(words, **options)

    letters = ["abstrahiert", "Élan", "ouèon!!", "ñandú", "word.$$$", "façade'", "ÿ"]
    mixed = list("abcdestABT059!#$&'()-.<=>_|~ ") + ["'s", "'re", "é", "é", "à", "í", "÷", "Ñ", "Þ", "ª", "ß", "̸", "日", "İ", "Σ", "\x85"]
    texts = [" ".join(letters)] + [" ".join("".join(rng.choice(mixed) for _ in range(rng.randint(1, 8))) for _ in range(30)) for _ in range(300)]
    table.tokenizer = Watched()
    table.begin()
    words = [table.ids(_stops_apart(t.encode().lower()).split()) for t in texts[:1]]
    table.settle()
    assert set(seen) == {"!!", ".$$$", "'"}
    words += [table.ids(_stops_apart(t.encode().lower()).split()) for t in texts[1:]]
    starts, counts = table.settle()
    for text, ids in zip(texts, words, strict=True):
        got = [x for i in ids for x in table.flat[starts[i] : starts[i] + counts[i]].tolist()]
        assert got == UNTOUCHED.encode(text, add_special_tokens=False).ids
