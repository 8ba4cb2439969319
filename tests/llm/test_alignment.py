"""Cross-tokenizer alignment against plain encoding of whole texts and pairing of all tokens."""

import hashlib
import random
from collections import Counter

import pytest

from orbitframe.llm import alignment as A

ODD = [
    None, "", " ", "a ", " a", "  two  spaces ", "line\nend \n next\n\n", "tab\t x", "don't they're", "has ▁ mark", "<|endoftext|> </s> <s> <0x0A>", "日本語 テキスト です", "\U0001f600\U0001f600 x", "a\x00b\x1c c\x85 d", "1234567 89", "x" * 5000, "é é  wide　", "....!!! ??",
]


def plain(rows):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    both = A.Tokenizers(*A.default_tokenizers())
    found, counts = [], Counter()
    for i, text in rows:
        a = both.a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = both.b.encode(text or "")
        want = (" " + (text or "")).encode()
        if b"".join(both.a_bytes[x] for x in a) != want or b"".join(both.b_bytes[x] for x in b) != want:
            a, b = [], []
        spans = []
        for ids, size in ((a, both.a_bytes), (b, both.b_bytes)):
            at, out = 0, []
            for x in ids:
                out.append((at, at + len(size[x]), x))
                at += len(size[x])
            spans.append(out)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(x) for s, e, x in side if before <= s and e <= cut) for side in spans))
            before = cut
        links = [(x, y) for s, e, x in spans[0] for s2, e2, y in spans[1] if s < e2 and s2 < e]
        counts.update(links)
        found.append((i, len(a), len(b), groups, links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(i, a, b, len(g), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for i, a, b, g, k in found]


def some_rows():
    rng = random.Random(11)
    parts = [" ", "  ", "a", "the", "'s", "\n", "\t", "1", "99", ".", "!?", "é", " ", "漢", "\U0001f600", "́", "<|endoftext|>", "X", " \n ", "straße", "▁"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 15))) for _ in range(150)] + ["the same words again, and again"] * 20
    return [(i if i % 13 else None, t) for i, t in enumerate(texts)]


def test_words_join_to_the_tokens_of_whole_texts():
    both, rng = A.Tokenizers(*A.default_tokenizers()), random.Random(2)
    parts = [" ", "  ", "a", "the", "'s", "\n", "\t", "1", ".", "é", " ", " ", "\x1c", "\x85", "漢", "́", "﻿", "X", " \n ", "​"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        a, b = both.encode(A.words_of(text))
        assert sum(a, []) == both.a.encode(" " + text, add_special_tokens=False).ids
        assert sum(b, []) == both.b.encode(text)


@pytest.mark.parametrize("parts", [3, 64])
def test_alignment(spark, monkeypatch, parts):
    monkeypatch.setattr(A, "LEAST_PARTS", parts)
    rows = some_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, chunk string, n_a int, key int").repartition(4)
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = A.align(df, *A.default_tokenizers())
    assert got.columns == ["doc_id", *A.NUMBERS, "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows), key=key)


def test_empty_table_and_no_tokens(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert A.align(df, *A.default_tokenizers()).collect() == []
    df = spark.createDataFrame([(1, None), (2, ""), (2, "▁")], "doc_id int, text string")
    assert sorted(map(tuple, A.align(df, *A.default_tokenizers()).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_setting_is_put_back(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    with A.dealt_by_word(spark):
        tokens = spark.createDataFrame([(1, b"x", 1, [1], [2], [3], [2])], "word long, key binary, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>")
        plan = A.links_of(tokens)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(word") == plan.count("Exchange") == 3  # both sides, and the links; none by end
    assert spark.conf.get(name) == before
