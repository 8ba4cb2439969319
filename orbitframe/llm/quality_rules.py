"""Quality rules (operator 8): plain counts and repetition within a text.

Method: a suffix array over a text's words.  Suffixes that share their first eight words are sorted by hash
comparison, with collisions told and undone (suffixes.py); runs of neighbours whose common prefix is long enough (the intervals of the longest-common-prefix
array) are the maximal repeated word strings.  The union of their spans gives the covered fraction, and their
longest common prefix the longest repeat.  A text is rejected when too much of it is covered or when one repeat
is too long.

Words are maximal runs of characters other than space and 9 to 13.  A null or empty text has no words, fails
for its length and is not kept.  Each row is judged alone: repeated rows, null keys and extra columns with any
names have no influence, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import kernels as K
from orbitframe.llm.suffixes import sorted_groups

WINDOW = 8
MIN_WORDS = 20
#: Base limit in per cent of words in repeated windows, and the method's own limits.
MAX_REPEAT_PERCENT = 30
MAX_COVERED_PERCENT = 25
MAX_LONGEST = 150

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat"]
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def duplicate_lines(data: np.ndarray, at: np.ndarray, prefix: np.ndarray, solid_sum: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    start = np.concatenate([at[:-1], breaks + 1])
    doc = np.searchsorted(at, breaks, side="right") - 1
    doc = np.concatenate([np.arange(len(at) - 1), doc])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.empty(len(start), np.int64)
    last = np.append(doc[1:] != doc[:-1], True)
    end[:-1] = start[1:] - 1
    end[last] = at[1:]
    full = solid_sum[np.minimum(end, n)] > solid_sum[np.minimum(start, n)]
    start, end, doc = start[full], end[full], doc[full]
    key = K.mix(K.span_hash(prefix, start, end) + (end - start).astype(np.uint64)) + K.mix(doc.astype(np.uint64))
    _, once, line = np.unique(key, return_index=True, return_inverse=True)
    lead = once[line]
    if not (K.spans_equal(data, start, end, start[lead], end[lead]) & (doc == doc[lead])).all():  # hashes collided
        seen: dict[tuple[int, bytes], int] = {}
        for i, line_key in enumerate((int(d), data[a:b].tobytes()) for d, a, b in zip(doc, start, end, strict=True)):
            seen.setdefault(line_key, i)
        once = np.array(list(seen.values()), np.int64)
    out = np.bincount(doc, minlength=len(at) - 1)
    return out - np.bincount(doc[once], minlength=len(at) - 1)


def repetition(words: np.ndarray, first: np.ndarray, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(which words lie in a repeat of least words or more, longest repeat of each text); words are numbers."""
    n, docs = len(words), len(first) - 1
    longest = np.zeros(docs, np.int64)
    mask = np.zeros(n, bool)
    if n < least:
        return mask, longest
    codes = K.mix(words.astype(np.uint64))  # still one code per word
    begin = np.flatnonzero(K.inside(first, least, n))
    doc = np.searchsorted(first, begin, side="right") - 1
    key = K.gram_hashes(codes, least)[begin] + K.mix(doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.append(False, key[1:] == key[:-1])
    member = same | np.append(same[1:], False)
    begin, doc, key = begin[order][member], doc[order][member], key[member]
    if not len(begin):
        return mask, longest
    groups = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    end = first[doc + 1]
    order, lcp = sorted_groups(K.prefix_hash(codes), codes, begin, end, groups)
    begin, doc = begin[order], doc[order]
    lcp[(lcp < least) | (doc[1:] != doc[:-1])] = 0  # only if hashes collided
    reach = np.maximum(np.append(0, lcp), np.append(lcp, 0))
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, begin + reach, -1)
    np.maximum.at(longest, doc, reach)
    return np.cumsum(step[:n]) > 0, longest


def counts_of(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The columns COUNTS for the texts of a buffer."""
    if not len(data):
        return [np.zeros(len(at) - 1, np.int64) for _ in COUNTS]
    starts, ends, first = K.words_of(data, at)
    solid = ~K.IS_SPACE[data]
    prefix = K.prefix_hash(K.BYTE_CODE[data])
    words = K.word_numbers(data, starts, ends)
    solid_sum = np.append(0, np.cumsum(solid))
    lines = duplicate_lines(data, at, prefix, solid_sum)
    mask, longest = repetition(words, first)
    return [np.diff(first), K.segment_sum(solid & ((data & 0xC0) != 0x80), at), K.segment_sum(SYMBOL[data], at), lines, K.segment_sum(mask, first), longest]


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the columns COUNTS of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(x, pa.int64()) for x in counts_of(data, at))], [id_col, *COUNTS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def judged(counts: DataFrame, max_covered: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST) -> DataFrame:
    """base_failed by the plain rules, and kept by these and the repetition limits."""
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    fine = (100 * F.col("n_repeat_words") <= max_covered * n) & (F.col("longest_repeat") <= max_longest)
    return counts.withColumns({"base_failed": failed, "kept": ~failed & fine})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row."""
    return judged(measure(docs, id_col, text_col))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is kept; the text crosses to Python with its row, so no join is needed."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in K.chunks(batch.column(at)):
                got = dict(zip(COUNTS, counts_of(data, offsets), strict=True))
                n, repeats = got["n_words"], got["n_repeat_words"]
                keep = (n >= MIN_WORDS) & (100 * repeats <= min(MAX_REPEAT_PERCENT, MAX_COVERED_PERCENT) * n) & (got["longest_repeat"] <= MAX_LONGEST)
                yield batch.slice(lo, hi - lo).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
