"""Substring dedup by fixed-block anchors (operator 9).

Method: the non-overlapping blocks of seven words of every document are the index, and every rolling window of
seven words probes it.  Thirteen consecutive words always hold one whole block, so any repeat of thirteen words
makes a hit in both places.  Hits are extended to the runs of thirteen words that hold them, each checked by its
own fingerprint and the smallest id that has it; runs of such windows are the maximal repeats.  A window's
fingerprint has 124 bits, of two hashes of its words that share nothing but the words' bytes: even 10**13 windows
hold two different ones of the same fingerprint with a chance of under 10**-11.

The index and the probes travel as sets of short hashes per chunk of documents (see exchange.py), so frequent
passages cost a chunk one entry, and only windows around hits go on to the second exchange.

A word is removed if a window of thirteen words that covers it also starts in a document with a smaller id.
Rows that share an id are no earlier than one another; null ids are the smallest.  Null and empty texts, and
those under thirteen words, lose nothing.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm import exchange as X
from orbitframe.llm import kernels as K

WINDOW = 13
CHECK_SEED = 0x1F83D9ABFB41BD6B


def block_size(window: int) -> int:
    return (window + 1) // 2


def _words(texts: pa.Array, seed: int = K.SEED) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk, and where each document's words begin."""
    hashes, first, n = [], [np.zeros(1, np.int64)], 0
    for _, _, data, at in K.chunks(texts):
        starts, ends, f = K.words_of(data, at)
        hashes.append(K.word_hashes(data, starts, ends, seed=seed) if len(starts) else np.zeros(0, np.uint64))
        first.append(f[1:] + n)
        n += len(starts)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(first)


def _grams(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs of width words within documents."""
    at = np.flatnonzero(K.inside(first, width, len(words)))
    return at, K.gram_hashes(words, width)[at] if len(at) else np.zeros(0, np.uint64)


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, word counts, removed words, and the kept words' digest of every row."""
    block = block_size(window)
    layout = X.layout_of(docs, text_col)
    rows = X.chunked(docs, layout, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def send_blocks(table: pa.Table) -> pa.Table:
        words, first = _words(X.sorted_docs(table)[1])
        at, grams = _grams(words, first, block)
        doc = np.searchsorted(first, at, side="right") - 1
        aligned = (at - first[doc]) % block == 0
        found = X.HashSet(grams, layout)
        is_block = np.zeros(len(found.distinct), bool)
        is_block[found.inverse[aligned]] = True
        chunk = table.column("chunk")[0].as_py()
        out = [(b, X.join_parts(X.pack(v), X.bit_list(is_block[lo:hi]), X.bit_list(found.count[lo:hi] > 1))) for b, lo, hi, v in found.buckets()]
        return X.binary_table(["bucket", "chunk", "payload"], [o[0] for o in out], [chunk] * len(out), [o[1] for o in out])

    def is_hit(group: np.ndarray, count: np.ndarray, flags: list[np.ndarray]) -> np.ndarray:
        block_somewhere, twice = np.zeros(len(count), bool), count > 1
        block_somewhere[group[flags[0]]] = True
        twice[group[flags[1]]] = True
        return (block_somewhere & twice)[group]

    def windows(texts: pa.Array, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, hashes and checks of the windows that hold a hit."""
        words, first = _words(texts)
        at, grams = _grams(words, first, block)
        hit = np.zeros(len(words), bool)
        hit[at[X.HashSet(grams, layout).answers(replies)]] = True
        at, grams = _grams(words, first, window)
        total = np.append(0, np.cumsum(hit))
        holds = total[at + window - block + 1] > total[at]
        at, grams = at[holds], grams[holds]
        return np.searchsorted(first, at, side="right") - 1, grams, checks_of(texts, at)

    def checks_of(texts: pa.Array, at: np.ndarray) -> np.ndarray:
        return K.gram_hashes(_words(texts, CHECK_SEED)[0], window)[at] if len(at) else np.zeros(0, np.uint64)

    def send_windows(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["bucket", "chunk", "payload"]
        if not table.num_rows or not replies.num_rows:
            return X.binary_table(names, [], [], [])
        ids, texts = X.sorted_docs(table)
        doc, grams, checks = windows(texts, replies)
        found = X.HashSet(grams, layout._replace(bits=60), checks)
        key = X.order_keys(ids)
        least = np.full(len(found.distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, found.inverse, key[doc])
        chunk = table.column("chunk")[0].as_py()
        out = [(b, X.join_parts(X.pack(v), found.checks[lo:hi].tobytes(), X.number_list(least[lo:hi]))) for b, lo, hi, v in found.buckets()]
        return X.binary_table(names, [o[0] for o in out], [chunk] * len(out), [o[1] for o in out])

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = [id_col, "n_words", "n_removed", "kept_sha256"]
        if not table.num_rows:
            return pa.table([pa.array([], table.column("doc_id").type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=names)
        ids, texts = X.sorted_docs(table)
        key = X.order_keys(ids)
        # which windows were sent is not asked again: fingerprints that came back are looked up among all windows
        words, first = _words(texts)
        at, grams = _grams(words, first, window)
        doc = np.searchsorted(first, at, side="right") - 1
        short, checks = grams >> np.uint64(4), checks_of(texts, at)
        order = np.lexsort((key[doc], checks, short))
        s, c, k = short[order], checks[order], key[doc][order]
        lead = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])) if len(s) else np.zeros(0, bool)
        least = k[np.maximum.accumulate(np.where(lead, np.arange(len(s)), 0))] if len(s) else k
        late = np.zeros(len(at), bool)
        late[order] = k > least
        late |= _is_marked(short, checks, *_marked(replies, layout._replace(bits=60)))
        gone = np.zeros(len(words) + 1, np.int64)
        np.add.at(gone, at[late], 1)
        np.add.at(gone, at[late] + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        digests, base = [], 0
        for _, _, data, offsets in K.chunks(texts):
            starts, ends, f = K.words_of(data, offsets)
            raw = data.tobytes()
            for d in range(len(offsets) - 1):
                a, b = f[d], f[d + 1]
                keep = np.flatnonzero(~gone[base + a : base + b]) + a
                digests.append(hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])).hexdigest())
            base += len(starts)
        return pa.table([ids, pa.array(np.diff(first)), pa.array(K.segment_sum(gone, first)), pa.array(digests, pa.string())], names=names)

    hits = X.shared_hashes(rows.groupBy("chunk").applyInArrow(send_blocks, X.SETS), 2, is_hit)
    sets = rows.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(send_windows, X.SETS)
    late = late_windows(sets)
    return rows.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(finish, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string")


def late_windows(sets: DataFrame) -> DataFrame:
    """The fingerprints that a smaller id has as well, back to each chunk."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        values, checks, least = [], [], []
        for payload in table.column("payload").to_pylist():
            packed, check, number = X.split_parts(payload, 3)
            values.append(X.unpack(packed))
            checks.append(np.frombuffer(check, "<u8"))
            least.append(X._flags(number, len(values[-1])))
        ends = np.cumsum([len(v) for v in values])
        value, check, number = np.concatenate(values), np.concatenate(checks), np.concatenate(least)
        order, new = X.paired_groups(value, check)
        group = np.empty(len(value), np.int64)
        group[order] = np.cumsum(new) - 1
        smallest = np.full(int(new.sum()), np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, number)
        late = number > smallest[group]
        out = [X.join_parts(X.pack(value[e - len(v) : e][m]), check[e - len(v) : e][m].tobytes()) for v, e in zip(values, ends, strict=True) for m in [late[e - len(v) : e]]]
        return X.binary_table(["chunk", "bucket", "payload"], table.column("chunk").to_pylist(), [bucket] * len(out), out)

    return sets.groupBy("bucket").applyInArrow(run, X.REPLIES)


def _marked(replies: pa.Table, layout: X.Layout) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes, sorted, and checks of the fingerprints that came back."""
    values, checks = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for b, payload in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True):
        packed, check = X.split_parts(payload, 2)
        values.append(X.unpack(packed).astype(np.uint64) * np.uint64(layout.buckets) + np.uint64(b))
        checks.append(np.frombuffer(check, "<u8"))
    value, check = np.concatenate(values), np.concatenate(checks)
    order = np.lexsort((check, value))
    return value[order], check[order]


def _is_marked(short: np.ndarray, checks: np.ndarray, marked: np.ndarray, marked_checks: np.ndarray) -> np.ndarray:
    """Which pairs are among the marked ones."""
    lo, hi = np.searchsorted(marked, short, "left"), np.searchsorted(marked, short, "right")
    out = np.zeros(len(short), bool)
    for k in range(int((hi - lo).max(initial=0))):  # one step, unless short hashes collide
        open_ = np.flatnonzero(lo + k < hi)
        out[open_] |= marked_checks[lo[open_] + k] == checks[open_]
    return out


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
