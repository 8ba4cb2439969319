"""Finding hashes that several parts of a corpus share, without shuffling a row per place.

Documents are dealt into chunks by a hash of their id.  A chunk sends each bucket of the hash space the sorted
set of its hashes there, coded as differences of a few bytes; the bucket answers with one bit per hash.  A hash
counts once per chunk however often it occurs, so no place in a text and no frequent passage makes a large group.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_TEXT, BUCKET_TEXT, LEAST_PARTS = 4 << 20, 16 << 20, 64
#: From so much text on, chunks and buckets grow with its square root, so that sets sent grow in proportion to it; an
#: executor's memory ends that at MOST_GROWTH times the size, beyond which there are more sets of fewer hashes each.
GROWTH_TEXT, MOST_GROWTH = 64 << 30, 8
SETS = "bucket int, chunk int, payload binary"
REPLIES = "chunk int, bucket int, payload binary"


class Layout(NamedTuple):
    """Numbers of chunks and buckets, and bits of a hash that tell it from others."""

    chunks: int
    buckets: int
    bits: int


def layout_of(docs: DataFrame, text_col: str) -> Layout:
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    grown = min(MOST_GROWTH, max(1.0, (size / GROWTH_TEXT) ** 0.5))
    return Layout(max(LEAST_PARTS, -(-size // int(CHUNK_TEXT * grown))), max(LEAST_PARTS, -(-size // int(BUCKET_TEXT * grown))), min(60, 40 + max(0, (int(size) >> 32).bit_length())))


def chunked(docs: DataFrame, layout: Layout, id_col: str, text_col: str, spread_nulls: bool = True) -> DataFrame:
    """chunk, doc_id and text; every row of an id is in the same chunk, but for null ids if they are spread by text."""
    key = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col)) if spread_nulls else F.xxhash64(id_col)
    return docs.select(F.pmod(key, F.lit(layout.chunks)).cast("int").alias("chunk"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def sorted_docs(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Ids and texts of a chunk in order of id, then text; null ids come first."""
    table = table.select(["doc_id", "text"]).combine_chunks()
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table
    nulls = table.column("doc_id").null_count
    if nulls:  # Arrow puts nulls last
        table = pa.concat_tables([table.slice(table.num_rows - nulls), table.slice(0, table.num_rows - nulls)])
    ids, texts = table.column("doc_id").combine_chunks(), table.column("text").combine_chunks()
    return ids, texts


def order_keys(ids: pa.Array) -> np.ndarray:
    """Ids as numbers to compare by; null is the least."""
    return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def pack(values: np.ndarray) -> bytes:
    """Sorted values below 2**63, as differences; the all-ones difference only carries on."""
    if not len(values):
        return b""
    gaps = np.diff(values.astype(np.int64), prepend=0)
    width = max(1, min(7, (int(np.mean(gaps) * 5).bit_length() + 7) // 8))
    most = (1 << (8 * width)) - 1
    more = gaps // most
    if more.any():
        at = np.cumsum(more + 1) - 1
        wide = np.full(int(at[-1]) + 1, most, np.int64)
        wide[at] = gaps - more * most
        gaps = wide
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    gaps = np.zeros((len(raw), 8), np.uint8)
    gaps[:, :width] = raw
    gaps = gaps.view("<i8").ravel()
    return np.cumsum(gaps)[gaps != (1 << (8 * width)) - 1]


def paired_groups(values: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by value, then check; which places in it begin a new pair)."""
    order = np.lexsort((checks, values))
    v, c = values[order], checks[order]
    return order, np.append(True, (v[1:] != v[:-1]) | (c[1:] != c[:-1])) if len(v) else np.zeros(0, bool)


def join_parts(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts)


def split_parts(data: bytes, n: int) -> list[bytes]:
    sizes = struct.unpack_from(f"<{n}q", data)
    out, at = [], 8 * n
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


class HashSet:
    """The distinct hashes of a chunk, cut by bucket; with checks, the distinct pairs of a hash and its check."""

    def __init__(self, hashes: np.ndarray, layout: Layout, checks: np.ndarray | None = None):
        short = hashes >> np.uint64(64 - layout.bits)
        n = np.uint64(layout.buckets)
        #: Sorting by bucket, then value: the bucket is the remainder, so neighbours spread evenly.
        key = (short % n) * np.uint64((1 << layout.bits) // layout.buckets + 1) + short // n
        if checks is None:
            self.distinct, self.inverse, self.count = np.unique(key, return_inverse=True, return_counts=True)
        else:
            order, new = paired_groups(key, checks)
            self.distinct, self.checks = key[order][new], checks[order][new]
            self.inverse = np.empty(len(key), np.int64)
            self.inverse[order] = np.cumsum(new) - 1
        edges = np.arange(layout.buckets + 1, dtype=np.uint64) * np.uint64((1 << layout.bits) // layout.buckets + 1)
        self.cuts = np.searchsorted(self.distinct, edges)
        self.base = edges

    def buckets(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(bucket, from, to, values) of the buckets that are not empty."""
        for b in np.flatnonzero(np.diff(self.cuts)):
            lo, hi = int(self.cuts[b]), int(self.cuts[b + 1])
            yield int(b), lo, hi, (self.distinct[lo:hi] - self.base[b]).astype(np.int64)

    def answers(self, replies: pa.Table) -> np.ndarray:
        """The bits that came back for each place given at first."""
        bits = np.zeros(len(self.distinct), bool)
        for b, payload in zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True):
            lo, hi = int(self.cuts[b]), int(self.cuts[b + 1])
            bits[lo:hi] = np.unpackbits(np.frombuffer(payload, np.uint8), count=hi - lo).astype(bool)
        return bits[self.inverse]


def binary_table(names: list[str], first: list[int], second: list[int], payloads: list[bytes]) -> pa.Table:
    return pa.table([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(payloads, pa.binary())], names=names)


def shared_hashes(sets: DataFrame, lists: int, judge: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], np.ndarray]) -> DataFrame:
    """One bit per hash back to each chunk.

    judge(group, n_groups, flags) gets, for the concatenated entries of a bucket, the number of each entry's hash
    and what else the chunks sent, and returns a bool per entry.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        chunks = table.column("chunk").to_pylist()
        values, extra, sizes = [], [[] for _ in range(lists)], []
        for payload in table.column("payload").to_pylist():
            packed, *more = split_parts(payload, 1 + lists)
            v = unpack(packed)
            values.append(v)
            sizes.append(len(v))
            for i, m in enumerate(more):
                extra[i].append(m)
        _, group, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        flags = [np.concatenate([_flags(m, n) for m, n in zip(x, sizes, strict=True)]) for x in extra]
        bits = judge(group, count, flags)
        ends = np.cumsum(sizes)
        out = [np.packbits(bits[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)]
        return binary_table(["chunk", "bucket", "payload"], chunks, [bucket] * len(chunks), out)

    return sets.groupBy("bucket").applyInArrow(run, REPLIES)


def _flags(data: bytes, n: int) -> np.ndarray:
    """Bits if they were packed as such, else 64-bit numbers."""
    kind, body = data[:1], data[1:]
    return np.unpackbits(np.frombuffer(body, np.uint8), count=n).astype(bool) if kind == b"b" else np.frombuffer(body, "<i8")


def bit_list(bits: np.ndarray) -> bytes:
    return b"b" + np.packbits(bits).tobytes()


def number_list(numbers: np.ndarray) -> bytes:
    return b"n" + numbers.astype("<i8").tobytes()
