"""Texts whose polynomial hashes are equal modulo 2**64 whatever the base, and many rows with null ids."""

import random

import brute as B
import numpy as np

from orbitframe.llm import byte_repeats, jaccard_join, kernels, quality_rules, suffixes, word_repeats


def morse(n, a="a", b="b"):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


X, Y = "".join(morse(1024)), "".join(morse(1024, "b", "a"))


def listed(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_such_words_are_told_apart(spark):
    head = " ".join(f"w{i}" for i in range(12))
    texts = [f"{head} {X}", f"{head} {Y}", X, Y, f"{X}\n{Y}", f"{X}\n{Y}\n{X}"]
    rows = list(enumerate(texts))
    docs = frame(spark, texts)
    assert listed(word_repeats.repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(B.word_repeats(rows), key=repr)
    assert listed(jaccard_join.linked_documents(docs), "doc_id", "n_shingles", "component_id") == sorted(B.jaccard_groups(rows), key=repr)
    assert listed(quality_rules.quality_rules(docs), "doc_id", *quality_rules.COUNTS) == sorted(((i, *B.rule_counts(t)) for i, t in rows), key=repr)
    assert listed(byte_repeats.repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(B.byte_repeats(rows), key=repr)


def test_such_sequences_of_words(spark):
    one, two = " ".join(morse(1100, "yes", "no")), " ".join(morse(1100, "no", "yes"))
    rows = list(enumerate([one, f"{one} {two}", f"{one} stop {two} stop {one}"]))
    got = quality_rules.quality_rules(frame(spark, [t for _, t in rows]))
    assert listed(got, "doc_id", "n_repeat_words", "longest_repeat") == [(i, *B.rule_counts(t)[4:]) for i, t in rows]


def test_sorting_by_ranks_where_hashes_collide():
    codes = np.array([ord(c) for c in X + "c" + Y + "c" + X], np.uint64)
    start = np.arange(len(codes))
    end = np.full(len(codes), len(codes))
    order, common = suffixes.sorted_groups(kernels.prefix_hash(codes), codes, start, end, np.array([0, len(codes)]))
    text = X + "c" + Y + "c" + X
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    for a, b, n in zip(order, order[1:], common, strict=False):
        assert text[a : a + n] == text[b : b + n] and text[a + n : a + n + 1] < text[b + n : b + n + 1]


def test_null_ids_are_spread_and_still_compared(spark):
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, f"{passage} {r.random()}") for _ in range(60)] + [(5, passage), (6, f"x {passage}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert listed(word_repeats.repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(B.word_repeats(rows), key=repr)
    assert listed(byte_repeats.repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(B.byte_repeats(rows), key=repr)


def test_fingerprints_that_share_a_short_hash():
    short = np.array([5, 5, 7, 9], np.uint64)
    checks = np.array([1, 2, 3, 4], np.uint64)
    assert word_repeats._is_marked(short, checks, np.array([5, 5, 9], np.uint64), np.array([2, 8, 5], np.uint64)).tolist() == [False, True, False, False]
