"""Best-fit packing against plain encoding and exhaustive search."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from orbitframe.llm import packing as P
from orbitframe.llm.bin_completion import Search, best_fit, bins_of, lower_bound, pack_lengths

ODD = [
    "", "  ", "\n\n\t", "a  b\n c", "<|endoftext|> x<|startoftext|>y", "don't DON'T it's", "é é é ́x", " wide spaces　here", "x" * 300, "日本語 テキスト", "a\x00b \x85 c d", "Σίσυφος ΣΑΣ", "▁mark", "12 345 6,7", "\U0001f600\U0001f600 ok",
]


def fewest(items, capacity):
    """Least number of bins, by trying everything."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b for b in bins if b + items[i] <= capacity}:
            k = bins.index(room)
            go(i + 1, [*bins[:k], room + items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_search_is_exact_on_small_tables():
    rng, mended = random.Random(3), 0
    for _ in range(300):
        capacity = rng.choice([10, 13, 20, 30, 100])
        items = [rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(max(1, capacity // 5), capacity // 2) for _ in range(rng.randint(1, 10))]
        counts = np.bincount(items, minlength=capacity + 1)
        found = pack_lengths(counts, capacity)
        again = np.zeros(capacity + 1, int)
        for times, filling in found:
            assert sum(length * n for length, n in filling) <= capacity
            for length, n in filling:
                again[length] += times * n
        assert (again == counts).all()
        least = fewest(items, capacity)
        assert lower_bound(counts, capacity) <= least == bins_of(found)
        mended += bins_of(best_fit(counts, capacity)) > least
    assert mended  # the search does better than its first incumbent


def test_search_stops_after_its_steps():
    counts = np.bincount(np.random.default_rng(1).integers(1300, 2100, 3000), minlength=4097)
    search = Search(counts, 4096, steps=200)
    assert bins_of(search.run()) <= bins_of(best_fit(counts, 4096))


def test_words_are_encoded_as_whole_texts_are(spark):
    path = P.default_tokenizer()
    tokenizer, encoder = Tokenizer.from_file(path), P.encoder_of(path)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice(["a", "B", "'s", "Word", ".", ",", "!", " ", "  ", "\n", "1", ".", "é", "́", "<|endoftext|>", " ", "漢", "\t"]) for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_table_of_words_keeps_the_early_half(monkeypatch):
    monkeypatch.setattr(P, "WORDS_KEPT", 10)
    encoder = P.WordEncoder(P.default_tokenizer())
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    text = " ".join(f"W{chr(97 + i % 26)}ord{chr(97 + i // 26)}, ABC." for i in range(100))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder) <= 10 and "abc" in encoder


@pytest.mark.parametrize("capacity", [8, 4096])
def test_packing(spark, capacity):
    rng = random.Random(7)
    texts = [None, *ODD, *(" ".join(rng.choice(["some", "words", "of", "texts", "longerish"]) for _ in range(rng.randint(0, 60))) for _ in range(80)), *["the same text again"] * 30]
    rows = [(i if i % 11 else None, text, "x", "y", 1) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, sequence_id string, nth int").repartition(5)
    tokenizer = Tokenizer.from_file(P.default_tokenizer())
    got = P.pack(df, P.default_tokenizer(), capacity, keep_ids=True)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    out = got.collect()
    want = []
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(i, k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in out), key=key) == sorted(want, key=key)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in places.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    counts = np.bincount([w[3] for w in want], minlength=capacity + 1)
    assert len(places) == bins_of(pack_lengths(counts, capacity)) == lower_bound(counts, capacity)
    whole = {r.sequence_id: (bytes(r.ids), r.starts) for r in P.sequences(got).collect()}
    assert whole == {s: (b"".join(p[2] for p in sorted(parts)), [p[0] for p in sorted(parts)]) for s, parts in places.items()}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert P.pack(df, P.default_tokenizer()).collect() == []
