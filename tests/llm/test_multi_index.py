"""The multi-index of operator 7: recall against all windows, and parts and blocks of any number."""

import random

import brute as B
import numpy as np

from orbitframe.llm import decontamination


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        at = r.randrange(len(words))
        kind = r.random()
        if kind < 0.6:
            words[at] = f"e{r.randrange(99)}"
        elif kind < 0.8 and len(words) > 2:
            del words[at]
        else:
            words.insert(at, f"i{r.randrange(99)}")
    return words


def tables(seed):
    r = random.Random(seed)
    items = [(i, " ".join(f"w{r.randrange(120)}" for _ in range(r.choice([3, 5, 8, 20, 21, 40, 60, 90])))) for i in range(24)]
    fill = lambda: " ".join(f"f{r.randrange(400)}" for _ in range(r.choice([0, 0, 3, 40])))
    rows = [(i, f"{fill()} {' '.join(edited(r, r.choice(items)[1].split(), r.choice([0, 0, 1, 1, 2, 3])))} {fill()}") for i in range(220)]
    return rows, items


def test_recall_against_all_windows(spark, monkeypatch):
    rows, items = tables(1)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, j): c for i, j, c in B.leaks(rows, items)}
    found = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.contaminated(docs, bench).collect()}
    assert len(want) > 80 and all(want[k] == v for k, v in found.items())
    assert len(found) >= 0.99 * len(want)
    monkeypatch.setattr(decontamination, "PART_CHARS", 500)
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 5)
    again = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.contaminated(docs, bench).collect()}
    assert again == found


def test_blocks_miss_nothing_within_the_radius():
    r = np.random.default_rng(3)
    index = decontamination.Index(__import__("pyarrow").array([" ".join(f"w{i}" for i in range(30))]))
    group = index.groups[5][0]
    for flips in range(decontamination.RADIUS + 1):
        bits = np.unpackbits(group.prints[0])
        bits[r.choice(decontamination.BITS, flips, replace=False)] ^= 1
        near = np.packbits(bits)
        assert any(group.table[b, near[b], 0] for b in range(decontamination.BLOCKS))


def test_repeats_nulls_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text, "a"), (1, text, "b"), (1, text, "b"), (2, None, "c"), (3, "other", "d")], "doc_id long, text string, key string")
    bench = spark.createDataFrame([(7, text, 1), (7, text, 1), (None, text, 1)], "item_id long, text string, part int")
    got = sorted(((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()), key=repr)
    assert got == sorted([(i, j) for i in (None, 1, 1) for j in (7, 7, None)], key=repr)
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
