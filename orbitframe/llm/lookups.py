"""Looking up what a table says of each distinct key of a chunk of documents.

A chunk sends each bucket of keys one block with the distinct keys it has there; the bucket, which holds the table's
rows of those keys, answers with one block of columns in the same order.  A key costs a chunk one entry however often
it occurs, no bucket gets more than one entry of a key from a chunk, and nothing is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.llm.exchange import REPLIES, SETS, binary_table, join_parts, split_parts
from orbitframe.llm.shared import released


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a binary key, as distinct_keys deals them."""
    return (F.crc32(key) % F.lit(buckets)).cast("int")


def distinct_keys(keys: Iterable[bytes], buckets: int) -> dict[int, list[bytes]]:
    """Sorted distinct keys by bucket, buckets in order."""
    out: list[list[bytes]] = [[] for _ in range(buckets)]
    for key in set(keys):
        out[zlib.crc32(key) % buckets].append(key)
    return {bucket: sorted(found) for bucket, found in enumerate(out) if found}


def key_block(keys: Sequence[bytes]) -> bytes:
    return join_parts(number_block(np.fromiter(map(len, keys), np.int64, len(keys))), b"".join(keys))


def binary_block(values: pa.Array) -> bytes:
    """As key_block, of an Arrow array without nulls, from its buffers."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return join_parts(number_block(np.diff(at)), data[int(at[0]) : int(at[-1])].to_pybytes() if data is not None and len(values) else b"")


def keys_in(block: bytes) -> pa.Array:
    sizes, data = split_parts(block, 2)
    ends = np.append(0, np.cumsum(numbers_in(sizes)))
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def number_block(values: np.ndarray) -> bytes:
    """Numbers from 0 on in as few bytes each as the largest needs."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype("u1")
    return bytes([kind.itemsize]) + values.astype(kind.newbyteorder("<")).tobytes()


def numbers_in(block: bytes) -> np.ndarray:
    return np.frombuffer(block, f"<u{block[0]}", offset=1).astype(np.int64)


def requests(chunked: DataFrame, keys_of: Callable[[pa.Table], Iterable[bytes]], buckets: int) -> DataFrame:
    """bucket, chunk and the block of the chunk's keys there."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        found = distinct_keys(keys_of(table), buckets)
        out = binary_table(["bucket", "chunk", "payload"], list(found), [chunk] * len(found), [key_block(keys) for keys in found.values()])
        del found
        released()
        return out

    return chunked.groupBy("chunk").applyInArrow(run, SETS)


def answers(asked: DataFrame, rows: DataFrame, answer: Callable[[pa.Table, np.ndarray], bytes]) -> DataFrame:
    """chunk, bucket and a block for each block of keys.

    rows has bucket, key and other columns, one row a key; answer(rows of the bucket, places) gets for each key of the
    block its row's place, or -1 if there is none.
    """

    def run(blocks: pa.Table, here: pa.Table) -> pa.Table:
        names = ["chunk", "bucket", "payload"]
        if not blocks.num_rows:
            return binary_table(names, [], [], [])
        here = here.combine_chunks()
        known = here.column("key").combine_chunks().cast(pa.large_binary()) if here.num_rows else pa.array([], pa.large_binary())
        asked_for = [keys_in(payload) for payload in blocks.column("payload").to_pylist()]
        places = pa.compute.index_in(pa.concat_arrays(asked_for), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)  # one hash table a bucket
        ends = np.cumsum([len(keys) for keys in asked_for])
        out = [answer(here, places[end - len(keys) : end]) for keys, end in zip(asked_for, ends, strict=True)]
        return binary_table(names, blocks.column("chunk").to_pylist(), blocks.column("bucket").to_pylist(), out)

    return asked.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(run, REPLIES)


def in_order(replies: pa.Table, keys: Iterable[bytes], buckets: int) -> tuple[list[bytes], list[bytes]]:
    """The chunk's keys as they were asked for, and the answers' blocks in the same order."""
    found = distinct_keys(keys, buckets)
    blocks = dict(zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True))
    return [key for part in found.values() for key in part], [blocks[b] for b in found]
