"""Suffix-array dedup (operator 1).

Method: suffixes are sorted by a merge sort whose comparisons find common extensions with prefix polynomial
hashes and a binary search.  To make the array sparse and split it over a cluster, each window of 100 bytes is
assigned to the smallest hash among its 32-byte strings (the leftmost of equals): equal windows pick the same
string at the same place.  Windows with the same pick form a group; within it the suffixes from the picked
string on are sorted, the longest-common-prefix array gives for every offset the windows whose right parts
agree, and the hash of the left part decides the rest.  Collisions are told by comparing bytes: of the sorted
neighbours, of contexts folded as copies, and of the first and last window found equal.

Only picks that occur twice in the corpus go on, told by packed hash sets per chunk (see exchange.py).  Strings
found in very many chunks are picked last, so the neighbourhood of a frequent passage does not gather in one
group, and equal contexts are folded in their chunk, so copies don't either.

A byte is removed if a string of 100 bytes that covers it also starts earlier: in a smaller id, or in the same
document further left.  Rows that share an id are ordered by text; a null id is the smallest.  Null and empty
texts and those under 100 bytes lose nothing.  Extra columns are ignored; an empty table gives an empty result.
Rows that share an id, or have none, meet in one task, as they have to be ordered; ids are taken for keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from orbitframe.llm import exchange as X
from orbitframe.llm import kernels as K
from orbitframe.llm.suffixes import sorted_groups

WINDOW, PICK = 100, 32
#: A string is picked last if it is in so many chunks; there are at most MANY_SHARE times a chunk's picks of these.
MANY_LEAST, MANY_SHARE = 32, 8


class Picks:
    """The picked strings of a chunk: place, hash, document, and first and last start of their windows."""

    def __init__(self, texts: pa.Array, window: int, width: int, many: np.ndarray, bits: int):
        self.data, self.at = K.string_parts(texts)
        base = int(self.at[0]) if len(self.at) else 0
        self.data, self.at = self.data[base : int(self.at[-1])] if len(self.at) else self.data[:0], self.at - base
        parts = [self._of(data, at, int(self.at[lo]), lo, window, width, many, np.uint64(64 - bits)) for lo, _, data, at in K.chunks(texts)]
        joined = [np.concatenate(p) for p in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64) for _ in range(5)]
        self.place, self.first, self.last, self.doc = (x.astype(np.int64) for x in (joined[0], joined[2], joined[3], joined[4]))
        self.hash = joined[1].astype(np.uint64)

    @staticmethod
    def _of(data: np.ndarray, at: np.ndarray, base: int, row: int, window: int, width: int, many: np.ndarray, shift: np.uint64) -> list[np.ndarray]:
        n, span = len(data), window - width + 1
        none = [np.zeros(0, np.int64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))]
        if n < window:
            return none
        hashes = K.rolling_hash(K.prefix_hash(K.BYTE_CODE[data]), width)
        value = hashes >> np.uint64(1)
        if len(many):
            table = np.zeros(1 << 16, bool)
            table[many >> (np.uint64(48) - shift)] = True
            may = np.flatnonzero(table[hashes >> np.uint64(48)])
            short = hashes[may] >> shift
            found = many[np.minimum(np.searchsorted(many, short), len(many) - 1)] == short
            value[may[found]] |= np.uint64(1 << 63)
        least, reach = value, 1
        while reach < span:
            step = min(reach, span - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        room = np.zeros(n + 1, np.int64)  # windows that end in their document
        size = np.diff(at)
        np.add.at(room, at[:-1][size >= window], 1)
        np.add.at(room, at[1:][size >= window] - window + 1, -1)
        good = np.cumsum(room)[: len(least)] > 0
        doc_start = np.zeros(len(least), bool)
        doc_start[at[:-1][(size >= window) & (at[:-1] < len(least))]] = True
        begin = good & (np.append(True, least[1:] != least[:-1]) | doc_start | np.append(True, ~good[:-1]))
        start = np.flatnonzero(begin)
        if not len(start):
            return none
        stops = np.flatnonzero(np.append(~good | begin, True))
        end = stops[np.searchsorted(stops, start, side="right")] - 1
        place, first, last = [], [], []
        while len(start):
            pick = np.empty(len(start), np.int64)
            for lo in range(0, len(start), 1 << 15):
                s = start[lo : lo + (1 << 15)]
                pick[lo : lo + (1 << 15)] = s + np.argmin(value[s[:, None] + np.arange(span)], axis=1)
            place.append(pick)
            first.append(start)
            last.append(np.minimum(end, pick))
            more = end > pick
            start, end = pick[more] + 1, end[more]
        place, first, last = np.concatenate(place), np.concatenate(first), np.concatenate(last)
        return [place + base, hashes[place], first + base, last + base, np.searchsorted(at, place, side="right") - 1 + row]


def fold(key: np.ndarray, rank: np.ndarray, codes: np.ndarray, start: np.ndarray, place: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(earliest of each context, its copies); a context that differs from the earliest with its key is no copy."""
    order = np.lexsort((rank, key))
    lead = np.append(True, key[order][1:] != key[order][:-1]) if len(key) else np.zeros(0, bool)
    owner = order[lead][np.cumsum(lead) - 1]
    same = (place - start)[order] == (place - start)[owner]
    same &= K.spans_equal(codes, start[order], end[order], start[owner], end[owner])
    return order[lead | ~same], order[~lead & same]


def context_key(prefix: np.ndarray, start: np.ndarray, place: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    shape = ((place - start) * 4096 + (end - start)).astype(np.uint64)
    return K.mix(K.span_hash(prefix, start, end)) + K.mix(shape) + hashes


def group_repeats(codes: np.ndarray, start: np.ndarray, place: np.ndarray, end: np.ndarray, hashes: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, smallest and largest offset of a window with an earlier equal) for contexts of several groups."""
    prefix = K.prefix_hash(K.BYTE_CODE[codes])
    order = np.argsort(hashes, kind="stable")
    cuts = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    sizes = np.diff(np.append(cuts, len(order)))
    order = order[np.repeat(sizes > 1, sizes)]
    sizes = sizes[sizes > 1]
    none = np.zeros(0, np.int64)
    if not len(order):
        return none, none, none
    first = np.append(0, np.cumsum(sizes))
    a, e = place[order], end[order]
    sort, lcp = sorted_groups(prefix, codes, a, e, first)
    order, a, e = order[sort], a[sort], e[sort]
    left, low = a - start[order], window - (e - a)
    rank, n = rank[order], len(order)
    smallest, largest = np.full(n, -1), np.full(n, -1)
    by_small, by_large = np.full(n, -1), np.full(n, -1)
    for i in range(int(low.min()), int(left.max()) + 1):
        part = np.append(0, np.cumsum(lcp < window - i))
        may = np.flatnonzero((low <= i) & (i <= left))
        may = may[np.bincount(part[may], minlength=n)[part[may]] > 1]
        if not len(may):
            continue
        key = K.mix(part[may].astype(np.uint64)) + K.span_hash(prefix, a[may] - i, a[may])
        o = np.lexsort((rank[may], key))
        lead = np.append(True, key[o][1:] != key[o][:-1])
        owner = o[lead][np.cumsum(lead) - 1]
        late, owner = may[o[~lead]], may[owner[~lead]]
        new = smallest[late] < 0
        smallest[late[new]], by_small[late[new]] = i, owner[new]
        largest[late], by_large[late] = i, owner
    hit = np.flatnonzero(smallest >= 0)
    for x in hit[~(_same(codes, a, hit, by_small[hit], smallest[hit], window) & _same(codes, a, hit, by_large[hit], largest[hit], window))]:  # hashes collided
        g = np.searchsorted(first, x, side="right") - 1
        peers = [y for y in range(first[g], first[g + 1]) if rank[y] < rank[x]]
        true = [i for i in range(low[x], left[x] + 1) if any(low[y] <= i <= left[y] and np.array_equal(codes[a[x] - i : a[x] - i + window], codes[a[y] - i : a[y] - i + window]) for y in peers)]
        smallest[x], largest[x] = (min(true), max(true)) if true else (-1, -1)
    hit = hit[smallest[hit] >= 0]
    return order[hit], smallest[hit], largest[hit]


def _same(codes: np.ndarray, a: np.ndarray, x: np.ndarray, y: np.ndarray, offset: np.ndarray, window: int) -> np.ndarray:
    same = np.ones(len(x), bool)
    for j in range(window):
        same &= codes[a[x] - offset + j] == codes[a[y] - offset + j]
    return same


def _numbers(*columns: np.ndarray) -> list[bytes]:
    return [c.astype("<i8").tobytes() for c in columns]


def repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids, bytes, removed bytes, maximal removed runs, and the remaining bytes' digest of every row."""
    if not PICK * 2 <= window < 2048:
        raise ValueError("window must be 64 bytes at least and under 2048")
    layout = X.layout_of(docs, text_col)
    rows = X.chunked(docs, layout, id_col, text_col, spread_nulls=False)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["bucket", "chunk", "payload"]
    spark = docs.sparkSession

    def send_picks(many) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            found = X.HashSet(Picks(X.sorted_docs(table)[1], window, PICK, many.value, layout.bits).hash, layout)
            chunk = table.column("chunk")[0].as_py()
            out = [(b, X.join_parts(X.pack(v), X.bit_list(found.count[lo:hi] > 1))) for b, lo, hi, v in found.buckets()]
            return X.binary_table(names, [o[0] for o in out], [chunk] * len(out), [o[1] for o in out])

        return rows.groupBy("chunk").applyInArrow(run, X.SETS)

    limit = max(MANY_LEAST, layout.chunks // MANY_SHARE)

    def frequent(table: pa.Table) -> pa.Table:
        values = np.concatenate([X.unpack(X.split_parts(p, 2)[0]) for p in table.column("payload").to_pylist()])
        value, count = np.unique(values, return_counts=True)
        return pa.table([pa.array(value[count >= limit] * layout.buckets + table.column("bucket")[0].as_py(), pa.int64())], names=["short"])

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of rows stand in for chunks here, which saves dealing out the texts for a count."""
        for batch in batches:
            for lo, hi, _, _ in K.chunks(batch.column(0), X.CHUNK_TEXT):
                found = X.HashSet(Picks(batch.column(0).slice(lo, hi - lo), window, PICK, np.zeros(0, np.uint64), layout.bits).hash, layout)
                out = [(b, X.join_parts(X.pack(v), b"")) for b, _, _, v in found.buckets()]
                yield from X.binary_table(names, [o[0] for o in out], [0] * len(out), [o[1] for o in out]).to_batches()

    sent = rows.select("text").mapInArrow(send_runs, X.SETS)
    short = np.array([r.short for r in sent.groupBy("bucket").applyInArrow(frequent, "short long").collect()], np.int64)
    many = spark.sparkContext.broadcast(np.sort(short.astype(np.uint64)))  # MANY_SHARE times a chunk's picks at most

    def is_twice(group: np.ndarray, count: np.ndarray, flags: list[np.ndarray]) -> np.ndarray:
        twice = count > 1
        twice[group[flags[0]]] = True
        return twice[group]

    def send_contexts(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return X.binary_table(names, [], [], [])
        ids, texts = X.sorted_docs(table)
        picks = Picks(texts, window, PICK, many.value, layout.bits)
        live = np.flatnonzero(X.HashSet(picks.hash, layout).answers(replies))
        place, hashes, doc = picks.place[live], picks.hash[live], picks.doc[live]
        start, end = picks.first[live], picks.last[live] + window
        prefix = K.prefix_hash(K.BYTE_CODE[picks.data])
        keep, copies = fold(context_key(prefix, start, place, end, hashes), place, picks.data, start, place, end)
        chunk, out = table.column("chunk")[0].as_py(), []
        bucket = (hashes % np.uint64(layout.chunks)).astype(np.int64)  # contexts are larger than hashes, so there are more buckets
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        key = X.order_keys(ids)
        cuts = np.searchsorted(bucket[keep], np.arange(layout.chunks + 1))
        none = _numbers(*[np.zeros(0)] * 3)
        for b in np.flatnonzero(np.diff(cuts)):
            k = keep[cuts[b] : cuts[b + 1]]
            d = doc[k]
            parts = [hashes[k].tobytes(), *_numbers(key[d], d, place[k] - picks.at[d]), (place[k] - start[k]).astype("<i2").tobytes(), (end[k] - place[k]).astype("<i2").tobytes(), K.gather(picks.data, start[k], end[k]).tobytes()]
            out.append((int(b), X.join_parts(*parts, *none)))
        if len(copies):  # told through some bucket, so that one exchange brings all spans back
            d = doc[copies]
            empty = [b""] * 7
            out.append((chunk, X.join_parts(*empty, *_numbers(d, start[copies] - picks.at[d], end[copies] - picks.at[d]))))
        return X.binary_table(names, [o[0] for o in out], [chunk] * len(out), [o[1] for o in out])

    def sort_contexts(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        kinds, columns, out_chunk, out = ["<u8", "<i8", "<i8", "<i8", "<i2", "<i2", "u1"], [[] for _ in range(8)], [], []
        for chunk, payload in zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist(), strict=True):
            parts = X.split_parts(payload, 10)
            if parts[7]:
                out_chunk.append(chunk)
                out.append(X.join_parts(*parts[7:]))
                continue
            for i, k in enumerate(kinds):
                columns[i].append(np.frombuffer(parts[i], k))
            columns[7].append(np.full(len(columns[0][-1]), chunk))
        if columns[0]:
            hashes, key, doc, offset, left, right, codes, chunks = (np.concatenate(c) for c in columns)
            left, right = left.astype(np.int64), right.astype(np.int64)
            size = left + right
            start = np.cumsum(size) - size
            place, end = start + left, start + size
            rank = np.empty(len(key), np.int64)
            rank[np.lexsort((offset, doc, key))] = np.arange(len(key))
            keep, copies = fold(context_key(K.prefix_hash(K.BYTE_CODE[codes]), start, place, end, hashes), rank, codes, start, place, end)
            at, smallest, largest = group_repeats(codes, start[keep], place[keep], end[keep], hashes[keep], rank[keep], window)
            who = np.concatenate([copies, keep[at]])
            lo = np.concatenate([offset[copies] - left[copies], offset[keep[at]] - largest])
            hi = np.concatenate([offset[copies] + right[copies], offset[keep[at]] - smallest + window])
            order = np.argsort(chunks[who], kind="stable")
            who, lo, hi = who[order], lo[order], hi[order]
            for c in np.unique(chunks[who]):
                a, b = np.searchsorted(chunks[who], [c, c + 1])
                out_chunk.append(int(c))
                out.append(X.join_parts(*_numbers(doc[who[a:b]], lo[a:b], hi[a:b])))
        return X.binary_table(["chunk", "bucket", "payload"], out_chunk, [bucket] * len(out), out)

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        columns = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if not table.num_rows:
            return pa.table([pa.array([], table.column("doc_id").type), *(pa.array([], pa.int64()) for _ in range(3)), pa.array([], pa.string())], names=columns)
        ids, texts = X.sorted_docs(table)
        data, at = K.string_parts(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        step = np.zeros(len(data) + 1, np.int32)
        for payload in replies.column("payload").to_pylist():
            doc, lo, hi = (np.frombuffer(p, "<i8") for p in X.split_parts(payload, 3))
            np.add.at(step, at[doc] + lo, 1)
            np.add.at(step, at[doc] + hi, -1)
        gone = np.cumsum(step[:-1]) > 0
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        edge = at[:-1][at[:-1] < len(data)]
        begin[edge] = gone[edge]
        removed = K.segment_sum(gone, at)
        digests = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes() if r else data[a:b].tobytes()).hexdigest() for a, b, r in zip(at[:-1].tolist(), at[1:].tolist(), removed.tolist(), strict=True)]
        return pa.table([ids, pa.array(np.diff(at)), pa.array(removed), pa.array(K.segment_sum(begin, at)), pa.array(digests, pa.string())], names=columns)

    twice = X.shared_hashes(send_picks(many), 1, is_twice)
    contexts = rows.groupBy("chunk").cogroup(twice.groupBy("chunk")).applyInArrow(send_contexts, X.SETS)
    spans = contexts.groupBy("bucket").applyInArrow(sort_contexts, X.REPLIES)
    return rows.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(finish, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
