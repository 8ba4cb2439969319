"""Best-fit packing (operator 11).

Method: bin completion by branch and bound (``bin_completion.py``).  Pieces of one length are interchangeable, so the
search sees one count per length, at most ``capacity`` numbers however many pieces there are: Spark counts, the
driver searches, and what it broadcasts is a table of fillings whose size is bounded by the capacity too.  The pieces
themselves stay in Spark.  Each has a number among those of its length in its task; sums of the tasks' counts turn that
into a number among all of its length, and the table of fillings names the sequence and the place for each such number.
No group of pieces, such as those of one length or one source, meets in a task.

Texts are cut at spaces, where no token can reach over, and each worker encodes a word once while a bounded table
holds it; words that differ in the case of ASCII letters or in one mark at the end share what can be shared.  Null texts count as empty, and an empty text has the closing id only.  Rows are packed one by one:
repeated rows and null ids are packed as often as they come, extra columns are ignored, whatever their names, and an
empty table gives an empty result.  Equal input may be numbered otherwise in another run; the number of sequences is
the same.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.llm.bin_completion import STEPS, Packing, pack_lengths
from orbitframe.llm.shared import checkpointed

CAPACITY = 4096
CLOSING_ID = 1
#: Distinct words a worker keeps encoded; past that the later half, in which rare words prevail, is dropped.
WORDS_KEPT = 1_000_000
#: Marks after a word that are encoded apart from it.
ENDS = frozenset(".,;:!?")
#: Longer words are encoded each time, so that the table's memory is bounded.
WORD_KEPT = 64
#: More pieces of one length than this would need a wider key.
MOST_OF_A_LENGTH = 1 << 48
_encoders: dict[str, "WordEncoder"] = {}


class WordEncoder(dict):
    """Token ids of a word as little-endian bytes, encoded when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: No token reaches over a space if the space is dropped; a tokenizer that keeps it gets whole texts.
        self.by_letters = self._ids("Word,") == self._ids("word") + self._ids(",")  # letters end where a mark begins, in either case
        self.by_word = self._ids("a b") == self._ids("a") + self._ids("b") and not self._ids(" ")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        head, last = word[:-1], word[-1:]
        if self.by_letters and last in ENDS and head.isascii() and head.isalpha():
            ids = self[head] + self[last]
        elif self.by_letters and word.isascii() and word.isalpha() and not word.islower():
            ids = self[word.lower()]
        else:
            ids = self._ids(word)
        if len(word) <= WORD_KEPT:
            if len(self) >= WORDS_KEPT:
                for late in list(islice(reversed(self), WORDS_KEPT // 2)):
                    del self[late]
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._ids(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder_of(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece, and its task and number among the task's pieces of its length; ids as bytes if kept."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", "task", "nth", *(["ids"] if keep_ids else [])]
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids binary" * keep_ids
    closing = np.array([closing_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = encoder_of(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, length, crc, nth, kept = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + closing
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    row.append(i)
                    piece.append(number)
                    length.append(n)
                    crc.append(zlib.crc32(part))
                    nth.append(int(seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        kept.append(part)
            at = np.array(piece, np.int64) * capacity
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(at), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(nth, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(kept, pa.binary())] if keep_ids else [])], names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


class Places:
    """Sequence and offset by length and number among the pieces of that length."""

    def __init__(self, packing: Packing):
        used: dict[int, int] = {}
        rows, first = [], 0
        for times, filling in packing:
            offset = 0
            for length, each in filling:
                start = used.get(length, 0)
                rows.append((length * MOST_OF_A_LENGTH + start, start, first, each, offset))
                used[length] = start + times * each
                offset += length * each
            first += times
        self.key, self.start, self.first, self.each, self.offset = np.array(sorted(rows), np.int64).reshape(-1, 5).T.copy()

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length * MOST_OF_A_LENGTH + number, side="right") - 1
        step = number - self.start[at]
        return self.first[at] + step // self.each[at], self.offset[at] + step % self.each[at] * length


def assign(cut: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """sequence_id and offset for written pieces, whose tasks and numbers no longer change."""
    counts = np.zeros(capacity + 1, np.int64)
    for row in cut.groupBy("length").count().collect():  # a row per length, capacity rows at most
        counts[row.length] = row["count"]
    if counts.max() >= MOST_OF_A_LENGTH:
        raise ValueError("too many pieces of one length")
    places = cut.sparkSession.sparkContext.broadcast(Places(pack_lengths(counts, capacity, steps)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "task").agg(F.count("*").alias("n")).select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(base, ["length", "task"]).select(*[c for c in cut.columns if c not in ("task", "nth")], (F.col("base") + F.col("nth")).alias("number"))
    names = [*numbered.columns[:-1], "sequence_id", "offset"]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            sequence, offset = table.of(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names)

    return numbered.mapInArrow(run, ", ".join([*kinds, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing_id: int = CLOSING_ID, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, steps: int = STEPS) -> DataFrame:
    """Every piece with its sequence and its place there; ids as little-endian bytes if kept."""
    return assign(checkpointed(pieces(docs, tokenizer, capacity, closing_id, id_col, text_col, keep_ids)), capacity, steps)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, its ids as little-endian bytes, and the offsets where its pieces begin, of pieces packed with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces: capacity at most
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.expr("aggregate(parts.ids, CAST('' AS BINARY), (a, b) -> concat(a, b))").alias("ids"), F.col("parts.offset").alias("starts"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
