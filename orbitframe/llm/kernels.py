"""Array kernels over the UTF-8 buffers of Arrow string columns.

An Arrow string column is one byte buffer plus offsets, so a batch of documents can be cut into words and
hashed with a handful of array operations, without a Python object per word.

Two kinds of hashes are used.  Those that stand for a word or a run of words where the text is not at hand mix
eight bytes, or two runs, at a time by a function that is not linear.  Polynomial prefix hashes modulo 2**64, kept
as a running sum ``H[i] = sum(T[b_j] * R**j)``, give the hash of any span by one subtraction and one
multiplication by an inverse power; some texts collide whatever the base, so they only guide comparisons
within a buffer, and what they find equal is compared in full (``spans_equal``, ``suffixes.py``).
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: Documents are worked on in runs of about this many bytes, which bounds the arrays of a task.
CHUNK_BYTES = 1 << 20
SEED = 0x2545F4914F6CDD1D
#: A word of up to so many times eight bytes is hashed together with the others.
LANES = 8
LANE_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)

BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the weak low bits of a polynomial hash."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    while done < n:
        step = U64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse; sizes are rounded up so that few tables are kept."""
    size = 1 << max(16, int(n - 1).bit_length())
    return _powers(BASE, size), _powers(INVERSE, size)


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Running sums of codes[j] * BASE**j, with a leading zero."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum(codes * powers(len(codes) + 1)[0][: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unmixed hash of the spans start:end; equal spans have equal hashes wherever they stand."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def rolling_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """Mixed hash of every run of width codes."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, U64)
    return mix((prefix[width:] - prefix[:n]) * powers(len(prefix))[1][:n])


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, at


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows; a run has one row at least."""
    data, at = string_parts(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(at, at[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each document, and where each document's words begin.

    A word is a maximal run of bytes other than space and 9 to 13; documents part words as well.
    """
    n = len(data)
    first = np.zeros(len(at), np.int64)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    solid = ~IS_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    edges = at[(at > 0) & (at < n)]
    begin[edges] = solid[edges]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    stop[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    first[:] = np.searchsorted(starts, at)
    return starts, ends, first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = SEED) -> np.ndarray:
    """A 64-bit hash for each word, of eight bytes at a time; words of over LANES of these are hashed one by one."""
    data = LOWER[data] if lower else data
    size = ends - starts
    out = mix(size.astype(U64) + U64(seed))
    lanes = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = np.flatnonzero(size <= 8 * LANES)
    for k in range(LANES):
        at = at[size[at] > 8 * k] if k else at
        if not len(at):
            break
        lane = lanes[starts[at] + 8 * k] & LANE_MASK[np.minimum(size[at] - 8 * k, 8)]
        out[at] = mix((out[at] ^ lane) * U64(BASE) + U64(k))
    long = np.flatnonzero(size > 8 * LANES)
    for i, a, b in zip(long.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out[i] = int.from_bytes(hashlib.blake2b(data[a:b].tobytes(), digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of a followed by b."""
    return mix(mix(a + U64(SEED)) * U64(BASE) + b)


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words, not heeding document edges; runs are put together from runs of 1, 2, 4 and so on."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    power, size, out, done = words, 1, None, 0
    while True:
        if width & size:
            out = power if out is None else paired(out[: len(power) - done], power[done:])
            done += size
        size *= 2
        if size > width:
            return mix(out[:n] + U64(width))
        power = paired(power[: len(power) - size // 2], power[size // 2 :])


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The spans' values, one after the other."""
    size = end - start
    total = int(size.sum())
    if not total:
        return data[:0]
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return data[shift + np.arange(total)]


def spans_equal(data: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """Whether each span start:end equals start2:end2, value by value."""
    size = end - start
    same = size == end2 - start2
    rows = np.flatnonzero(same & (size > 0) & (start != start2))
    cuts = np.searchsorted(np.cumsum(size[rows]), np.arange(0, int(size[rows].sum()) + 1, 1 << 22)) if len(rows) else np.zeros(1, np.int64)
    cuts = np.unique(np.append(cuts, [0, len(rows)]))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):  # bounds the arrays
        r = rows[lo:hi]
        differ = gather(data, start[r], end[r]) != gather(data, start2[r], end2[r])
        first = np.cumsum(size[r]) - size[r]
        same[r] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return same


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word of a buffer, the same for words equal byte by byte and no others."""
    _, first, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lead = first[number]
    if spans_equal(data, starts, ends, starts[lead], ends[lead]).all():
        return number
    names: dict[bytes, int] = {}  # hashes collided
    return np.array([names.setdefault(data[a:b].tobytes(), len(names)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def inside(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the n - width + 1 runs of width words lie within one document."""
    keep = np.zeros(max(0, n - width + 1), bool)
    lengths = np.diff(first)
    lo, hi = first[:-1][lengths >= width], first[1:][lengths >= width] - width + 1
    if len(keep):
        mark = np.zeros(len(keep) + 1, np.int64)
        np.add.at(mark, lo, 1)
        np.add.at(mark, hi, -1)
        keep = np.cumsum(mark[:-1]) > 0
    return keep


def covered(marks: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a run of width places that begins at a mark."""
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:n]) > 0


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values in each segment first[i]:first[i+1]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
