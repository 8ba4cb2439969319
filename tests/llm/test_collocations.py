"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from orbitframe.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=2000):
    """lang, rank, phrase, a, l, r, n, score."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for width in (1, 2, 3):
                for i in range(len(words) - width + 1):
                    f[lang][tuple(words[i : i + width])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def some_rows():
    rng = random.Random(4)
    vocabulary = ["the", "The", "of", "a", "new", "york", "times", "straße", "É", "é", "x\x1cy", "\xa0", "don't", "rare1", "日本", "\U0001f600"]
    texts = [" ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".", "\n", "\r\n", "\t", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(250)]
    texts += ["New York Times  new york times"] * 15 + [" ".join(f"once{i}" for i in range(50)), "", None, "the " * 3000, "\n\n ,,", "a\x0bb\x0cc " * 12]
    return [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts]


@pytest.mark.parametrize("parts", [1, 64])
def test_collocations(spark, monkeypatch, parts):
    monkeypatch.setattr(C, "LEAST_PARTS", parts)
    rows = some_rows()
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 7, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, lang string, text string, word string, chunk int").repartition(3)
    got = C.collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert sorted(map(tuple, C.collocations(df, least=3, top=7).collect())) == plain(rows, 3, 7)


def test_empty_table_and_nothing_frequent(spark):
    assert C.collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).collect() == []
    assert C.collocations(spark.createDataFrame([(1, "en", "a b c"), (2, None, None)], "doc_id long, lang string, text string")).collect() == []


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(999_999_999_999, 10**12, 10**12 + 7), (3, 3, 3), (10, 9_999, 77)], "a long, l long, r long")
    assert [r.s for r in df.select(C.score(df.a, df.l, df.r).alias("s")).collect()] == [1000000 * a * a // (left * r) for a, left, r in ((999_999_999_999, 10**12, 10**12 + 7), (3, 3, 3), (10, 9_999, 77))]


def test_radix_order():
    rng = np.random.default_rng(1)
    high, low = rng.integers(0, 1 << 40, 5000).astype(np.uint64) >> np.uint64(25), rng.integers(0, 70000, 5000).astype(np.uint64)
    order = C.radix_order(high, low)
    assert (order == np.lexsort((low, high))).all()


def test_ranges_follow_the_order_of_keys():
    count = np.array([5, 1000, 1, 30])
    below = np.append(0, np.cumsum(count)[:-1])
    keys = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]
    at = np.array(keys).T
    where = C.Ranges(int(count.sum()), 100).of([count[x] for x in at], [below[x] for x in at])
    assert (np.diff(where) >= 0).all() and where.max() < 100 and len(set(where)) > 4
