"""Benchmark decontamination (operator 7).

Method: windows of an item's own size get a 256-bit SimHash of their shingles, weighted by how often they occur.  A
multi-index over blocks of the fingerprints names the items within the radius: of 32 blocks of 8 bits, one differs
in a bit at most if no more than 63 bits differ, so a table from each block's values to the items one bit around them
misses no fingerprint within the radius.  The items named are verified by the exact weighted Jaccard similarity of the
shingle multisets.  At a similarity of 0.8 about 39 of the 256 bits differ, with a spread of about 6, so the radius
lies four spreads out, and fewer than one in ten thousand pairs at 0.8 lies beyond it.

Work is saved without loss: a window that is similar enough to an item shares so many shingles with it that some
number of them follow each other.  One scan of the corpus keeps the texts with such a run of shingles of any items,
told by a bit table of fixed size; only these go on.  They are dealt into parts, the items into blocks, and every part
meets every block in a task of its own, so neither the driver nor a broadcast ever holds the benchmark.

Words are runs of characters other than space and 9 to 13, lower-cased; shingles have five words, and an item of
fewer words is one shingle.  A text shorter than an item is one window.  Null or empty texts and items match nothing;
null ids are carried.  Repeated rows and items are reported each; of windows with equal similarity the first is told.
Extra columns are ignored, or carried where rows are; an empty table of texts or items finds nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from orbitframe.llm import kernels as K
from orbitframe.llm.shared import checkpointed

SHINGLE = 5
SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 256, 32, 63
#: The table that tells the items' shingles, one bit for each value of their first bits: 8 MB at any size.
TABLE_BITS = 26
#: Characters of texts in a part; items, and characters of items, in a block.
PART_CHARS, BLOCK_ITEMS, BLOCK_CHARS = 1 << 20, 2048, 8 << 20
#: Windows whose fingerprints are worked out at a time.
WINDOWS = 1024


def _signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    parts = np.stack([K.mix(grams ^ K.U64(0xA5A5A5A5A5A5A5A5 * (i + 1) % (1 << 64))) for i in range(BITS // 64)], 1)
    return np.unpackbits(parts.view(np.uint8).reshape(len(grams), BITS // 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(grams: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash, as bytes, of the windows of width shingles."""
    total = np.zeros((len(grams) + 1, BITS), np.int32)
    np.cumsum(_signs(grams), axis=0, out=total[1:])
    return np.packbits(total[starts + width] - total[starts] > 0, axis=1)


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def common_least(a: np.ndarray | int, b: int, least: float) -> np.ndarray:
    """Shingles that windows of a and b shingles have in common at least, if they are similar enough."""
    return np.ceil(least / (1 + least) * (np.asarray(a) + b) - 1e-9).astype(np.int64)


def run_least(size: int, least: float) -> int:
    """Shingles of an item of size shingles that follow each other at least in any window similar enough."""
    windows = np.arange(max(1, int(np.ceil(least * size - 1e-9))), size + 1)
    common = np.maximum(common_least(windows, size, least), 1)
    return int((-(-common // (np.maximum(windows - common, 0) + 1))).min())


def text_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, where each text's words begin) of runs of rows."""
    for lo, hi, data, at in K.chunks(pc.utf8_lower(texts)):
        starts, ends, first = K.words_of(data, at)
        yield lo, hi, (K.word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def _each_text(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, _, words, first in text_words(texts):
        yield from np.split(words, first[1:-1])


class Group(NamedTuple):
    """The items of one number of words."""

    words: int
    items: list[int]
    counts: list[Counter]
    prints: np.ndarray
    table: np.ndarray  # block, value: which items are within a bit


class Index:
    """Items of one block: their shingles, and the multi-index of each number of words."""

    def __init__(self, texts: pa.Array, radius: int = RADIUS):
        self.radius = radius
        of_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, words in enumerate(_each_text(texts)):
            if len(words):
                of_size.setdefault(len(words), []).append((i, K.gram_hashes(words, min(SHINGLE, len(words)))))
        value = np.arange(256)
        near = np.bitwise_count((value[:, None] ^ value).astype(np.uint8)) <= radius // BLOCKS
        self.groups: dict[int, list[Group]] = {}
        self.grams: dict[int, np.ndarray] = {}
        for n, items in sorted(of_size.items()):
            prints = np.concatenate([fingerprints(g, np.zeros(1, np.int64), len(g)) for _, g in items])
            table = np.stack([near[:, prints[:, b]] for b in range(BLOCKS)])
            width = min(SHINGLE, n)
            self.groups.setdefault(width, []).append(Group(n, [i for i, _ in items], [Counter(g.tolist()) for _, g in items], prints, table))
            self.grams[width] = np.unique(np.concatenate([self.grams.get(width, np.zeros(0, np.uint64)), *(g for _, g in items)]))

    def search(self, words: np.ndarray, first: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity) of the best window for each text and item."""
        best: dict[tuple[int, int], tuple[int, int, float]] = {}
        size = np.diff(first)
        for width, groups in self.groups.items():
            grams = K.gram_hashes(words, width)
            if not len(grams):
                continue
            mine = self.grams[width]
            known = np.append(0, np.cumsum(mine[np.minimum(np.searchsorted(mine, grams), len(mine) - 1)] == grams))
            for group in groups:
                span = group.words - width + 1
                full = np.flatnonzero(K.inside(first, group.words, len(words)))
                full = full[known[full + span] - known[full] >= common_least(span, span, least)]
                for at in _clusters(full, span):
                    self._look_up(best, grams, group, at, span, np.searchsorted(first, at, side="right") - 1, first, width, least)
                short = np.flatnonzero((size < group.words) & (size >= width))
                spans = size[short] - width + 1
                enough = known[first[short] + spans] - known[first[short]] >= np.maximum(common_least(spans, span, least), 1)
                for d, s in zip(short[enough].tolist(), spans[enough].tolist(), strict=True):
                    self._look_up(best, grams, group, first[d : d + 1], s, np.array([d]), first, width, least)
        return [(d, i, *found) for (d, i), found in best.items()]

    def _look_up(self, best: dict, grams: np.ndarray, group: Group, at: np.ndarray, span: int, doc: np.ndarray, first: np.ndarray, width: int, least: float) -> None:
        """Items that the multi-index names for windows close together, verified."""
        lo = int(at[0])
        prints = fingerprints(grams[lo : int(at[-1]) + span], at - lo, span)
        named = group.table[0, prints[:, 0]].copy()
        for b in range(1, BLOCKS):
            named |= group.table[b, prints[:, b]]
        window, item = np.nonzero(named)
        near = np.bitwise_count(prints[window] ^ group.prints[item]).sum(axis=1, dtype=np.int64) <= self.radius
        for w, i in zip(window[near].tolist(), item[near].tolist(), strict=True):
            a = int(at[w])
            score = weighted_jaccard(Counter(grams[a : a + span].tolist()), group.counts[i])
            key = (int(doc[w]), group.items[i])
            if score >= least and (key not in best or score > best[key][2]):
                best[key] = (a - int(first[doc[w]]), span + width - 1, score)


def _clusters(starts: np.ndarray, span: int) -> Iterator[np.ndarray]:
    """Starts in runs of a bounded number that lie close together."""
    if len(starts):
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            for lo in range(0, len(run), WINDOWS):
                yield run[lo : lo + WINDOWS]


class Screen(NamedTuple):
    """The items' shingles as a bit table, and the run of them that a text must have, by width of shingles."""

    table: np.ndarray
    runs: dict[int, int]

    def passes(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which texts may hold an item."""
        out = np.zeros(len(first) - 1, bool)
        for width, run in self.runs.items():
            grams = K.gram_hashes(words, width)
            if len(grams) < run:
                continue
            slot = grams >> K.U64(64 - TABLE_BITS)
            known = (self.table[slot >> K.U64(6)] >> (slot & K.U64(63))) & K.U64(1) > 0
            total = np.append(0, np.cumsum(known & K.inside(first, width, len(words))))
            hit = np.flatnonzero(total[run:] - total[:-run] == run)
            out[np.searchsorted(first, hit, side="right") - 1] = True
        return out


def screen_of(items: DataFrame, text_col: str, least: float) -> Screen:
    """The screen of the benchmark, summed up by Spark: its table has a fixed number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in _each_text(batch.column(0)):
                if len(words):
                    width = min(SHINGLE, len(words))
                    slot = np.unique(K.gram_hashes(words, width) >> K.U64(64 - TABLE_BITS))
                    bit = (K.U64(1) << (slot & K.U64(63))).view(np.int64)
                    n = len(slot)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, width)), pa.array(np.full(n, run_least(len(words) - width + 1, least))), pa.array((slot >> K.U64(6)).astype(np.int64)), pa.array(bit)], ["width", "run", "word", "bit"])

    bits = checkpointed(items.select(text_col).mapInArrow(run, "width long, run long, word long, bit long").groupBy("width", "word").agg(F.min("run").alias("run"), F.bit_or("bit").alias("bits")))
    runs = {r.width: r.run for r in bits.groupBy("width").agg(F.min("run").alias("run")).collect()}
    got = bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return Screen(table, runs)


def _suspects(docs: DataFrame, screen, text_col: str) -> DataFrame:
    """key, row and text of the texts that pass the screen."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, words, first in text_words(batch.column(1)):
                some = batch.slice(lo, hi - lo).filter(pa.array(screen.value.passes(words, first)))
                if some.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + some.num_rows)), *some.columns], ["key", "row", "text"])
                    key += some.num_rows

    return packed.mapInArrow(run, StructType([StructField("key", LongType()), StructField("row", docs.schema), StructField("text", StringType())]))


def _found(suspects: DataFrame, items: DataFrame, item_id: str, item_text: str, least: float, radius: int) -> DataFrame:
    """key of the text, item_id, first word and length of the best window, and similarity, by parts and blocks."""
    total = suspects.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    many = items.agg(F.count("*").alias("n"), F.sum(F.length(item_text)).alias("chars")).first()
    parts = max(1, -(-total // PART_CHARS))
    blocks = max(1, -(-many.n // BLOCK_ITEMS), -(-(many.chars or 0) // BLOCK_CHARS))
    place = lambda n, *keys: F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = suspects.select("key", "text", place(parts, "key").alias("part"), every(blocks).alias("block"))
    right = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), place(blocks, item_id, item_text).alias("block"), every(parts).alias("part"))
    kind = items.schema[item_id].dataType.simpleString()
    names = ["key", "item_id", "start_word", "n_words", "similarity"]

    def run(texts: pa.Table, block: pa.Table) -> pa.Table:
        keys, ids = texts.column("key").combine_chunks(), block.column("item_id").combine_chunks()
        rows = []
        if texts.num_rows and block.num_rows:
            index = Index(block.column("text").combine_chunks(), radius)
            for lo, _, words, first in text_words(texts.column("text").combine_chunks()):
                rows += [(lo + d, *found) for d, *found in index.search(words, first, least)]
        doc, item, start, size, score = zip(*rows, strict=True) if rows else ((), (), (), (), ())
        take = lambda values, at: values.take(pa.array(at, pa.int64()))
        return pa.table([take(keys, doc), take(ids, item), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(score, pa.float64())], names=names)

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, f"key long, item_id {kind}, start_word long, n_words long, similarity double")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per text and benchmark item in it: ids, first word and length of the best window, similarity."""
    screen = docs.sparkSession.sparkContext.broadcast(screen_of(items, item_text, least))  # of fixed size
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    suspects = checkpointed(_suspects(texts, screen, "text"))
    found = _found(suspects, items, item_id, item_text, least, radius)
    ids = suspects.select("key", F.col("row.doc_id").alias("doc_id"))
    return found.join(ids, "key").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item; those that the screen clears stay where they stand."""
    screen = docs.sparkSession.sparkContext.broadcast(screen_of(items, item_text, least))  # of fixed size
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words, first in text_words(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(~screen.value.passes(words, first)))

    clear = docs.mapInArrow(run, docs.schema)
    suspects = checkpointed(_suspects(docs, screen, text_col))
    bad = _found(suspects, items, item_id, item_text, least, radius).select("key").distinct()
    return clear.unionAll(suspects.join(bad, "key", "left_anti").select("row.*"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
