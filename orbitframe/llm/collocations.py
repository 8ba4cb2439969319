"""Phrase collocation mining (operator 12).

Method: words found often enough get consecutive ids, and pieces are broken at all others, since no frequent phrase
holds one.  The ids of two or three neighbours are packed into fixed-width keys of 64 and 96 bits.  Chunks of documents
radix-sort and run-length count their keys, ranges of keys gather the runs of all chunks, and sort and count again.
Ranges are cut where they would hold equally many words if neighbours were independent, by the words' counts below each
id, so a frequent word's keys spread over many ranges; a frequent phrase costs a chunk one entry.  Chunks look up the ids
of the words they hold (``lookups.py``); neither the dictionary nor the phrases pass the driver or a broadcast.
Scores, covered phrases and ranks are joins and windows over the frequent phrases.

Null texts count as empty and null languages as ``und``; repeated rows count as often as they come; ids are not looked
at, so they may be null or equal.  Extra columns are ignored, whatever their names, and an empty table gives an empty
result.  Products are decimals of 38 digits, exact for phrases found up to 10^15 times.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.llm import exchange as X
from orbitframe.llm import lookups as L
from orbitframe.llm.shared import dropped, released, written

LEAST, TOP, COVER, UNKNOWN = 10, 2000, 50, "und"
#: Distinct words a task keeps counts of before it sends them on, text of a chunk and of a range, least number of both.
WORDS_KEPT, CHUNK_TEXT, RANGE_TEXT, LEAST_PARTS = 300_000, 8 << 20, 2 << 20, 64
#: Ids have 31 bits, so that two make a positive 64-bit number.
MOST_WORDS = 1 << 31
#: Lower case for A-Z, a line end for each character that ends a piece, and a space for the tabulator.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
BREAK = b"\n"
BLANK = b"\xff"  # not in UTF-8: between a language and a word


def words_of(text: str | None) -> list[bytes]:
    """Words and breaks between pieces, with empty words where spaces meet."""
    return text.encode().translate(TABLE).replace(BREAK, b" \n ").split(b" ") if text else []


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, word and n; an empty word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                del found[BREAK], found[b""]
                found[b""] = sum(found.values())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.binary()), pa.array(found.values(), pa.int64())], ["lang", "word", "n"])
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[UNKNOWN if lang is None else lang].update(words_of(text.as_py()))
                if sum(map(len, counts.values())) >= WORDS_KEPT:
                    yield from sent()
        yield from sent()
        released()

    return docs.select(lang_col, text_col).mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def dictionary(counts: DataFrame, least: int, parts: int) -> DataFrame:
    """bucket, key, lang, word, n, id and below (occurrences of the words with smaller ids) of the frequent words, written; id -1 has a language's number of words."""
    key = F.concat(F.col("lang").cast("binary"), F.lit(BLANK), F.col("word"))
    frequent = written(counts.where((F.col("n") >= least) | (F.octet_length("word") == 0)).withColumn("key", key).withColumn("bucket", L.bucket_of(key, parts)))
    words = frequent.where(F.octet_length("word") > 0)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = Window.orderBy("bucket")  # a row per bucket
    base = words.groupBy("bucket").agg(F.count("*").alias("words"), F.sum("n").alias("sum")).select(
        "bucket", F.coalesce(F.sum("words").over(earlier(by_bucket)), F.lit(0)).alias("first"), F.coalesce(F.sum("sum").over(earlier(by_bucket)), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("bucket").orderBy("key")
    numbered = words.withColumn("at", F.row_number().over(inside) - 1).withColumn("under", F.coalesce(F.sum("n").over(earlier(inside)), F.lit(0)))
    ids = numbered.join(base, "bucket").select(*frequent.columns, (F.col("first") + F.col("at")).cast("long").alias("id"), (F.col("start") + F.col("under")).alias("below"))
    out = written(ids.unionByName(frequent.where(F.octet_length("word") == 0).withColumns({"id": F.lit(-1).cast("long"), "below": F.lit(0).cast("long")})))
    dropped(frequent)
    return out


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Order by high, then low: a stable sort for each 16-bit digit that is not the same in all, least first."""
    order = np.arange(len(high))
    for column, digits in ((low, 2), (high, 4)):
        for d in range(digits):
            digit = (column >> np.uint64(16 * d)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]  # for 16 bits, numpy sorts by radix
    return order


def runs(high: np.ndarray, low: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each comes."""
    order = radix_order(high, low)
    high, low = high[order], low[order]
    begin = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else np.zeros(0, np.int64)
    total = np.diff(np.append(begin, len(high))) if count is None else np.add.reduceat(count[order], begin) if len(begin) else count
    return high[begin], low[begin], total


def packed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)


class Ranges:
    """The range of each key: the share of all pairs or triples of words, were they independent, that come before it."""

    def __init__(self, total: int, parts: int):
        self.total, self.parts = max(total, 1), parts

    def of(self, counts: list[np.ndarray], below: list[np.ndarray]) -> np.ndarray:
        place = np.zeros(len(counts[0]))
        for n, under in zip(counts[::-1], below[::-1], strict=True):
            place = (under + n * place) / self.total
        return np.minimum((place * self.parts).astype(np.int64), self.parts - 1)


class Vocabulary(dict):
    """Place of each of a language's words of a chunk in its columns; -1 for words that are not frequent, -2 for none."""

    def __missing__(self, word: bytes) -> int:
        return -1


def phrases(docs: DataFrame, words: DataFrame, parts: int, least: int, size: int, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """id1, id2, id3 (or -1) and f of the phrases of two and three words found at least so often."""
    salt = [c for c in (id_col,) if c in docs.columns]
    chunked = docs.select(F.pmod(F.xxhash64(*salt, text_col), F.lit(parts)).cast("int").alias("chunk"), F.coalesce(lang_col, F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))
    total = words.where("id >= 0").agg(F.sum("n").alias("n")).first().n or 0
    ranges = Ranges(total, max(LEAST_PARTS, -(-size // RANGE_TEXT)))

    def keys_of(table: pa.Table) -> set[bytes]:
        found: dict[str, set[bytes]] = defaultdict(set)
        for lang, text in zip(table.column("lang").to_pylist(), table.column("text"), strict=True):
            found[lang].update(words_of(text.as_py()))
        return {lang.encode() + BLANK + w for lang, some in found.items() for w in some if w not in (b"", BREAK)}

    def answer(rows: pa.Table, places: np.ndarray) -> bytes:
        there = places >= 0
        found = rows.take(pa.array(places[there]))
        return X.join_parts(X.bit_list(there)[1:], L.number_block(np.array([len(there)])), *(L.number_block(found.column(c).to_numpy()) for c in ("id", "n", "below")))

    def send(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = ["bucket", "chunk", "payload"]
        if not table.num_rows or not replies.num_rows:
            return X.binary_table(names, [], [], [])
        keys, blocks = L.in_order(replies, keys_of(table), parts)
        bits, columns = [], [[], [], []]
        for block in blocks:
            mask, n, *values = X.split_parts(block, 5)
            bits.append(np.unpackbits(np.frombuffer(mask, np.uint8), count=int(L.numbers_in(n)[0])).astype(bool))
            for column, value in zip(columns, values, strict=True):
                column.append(L.numbers_in(value))
        ids, count, below = (np.concatenate(c) for c in columns)
        names_of: dict[bytes, Vocabulary] = defaultdict(lambda: Vocabulary({b"": -2}))
        for place, i in enumerate(np.flatnonzero(np.concatenate(bits)).tolist()):
            lang, _, word = keys[i].partition(BLANK)
            names_of[lang][word] = place
        rows = []
        for lang, text in zip(table.column("lang").to_pylist(), table.column("text"), strict=True):
            found = words_of(text.as_py())
            if found:
                rows.append(np.fromiter(map(names_of[lang.encode()].__getitem__, found), np.int64, len(found)))
                rows.append(np.array([-1]))
        x = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        x = x[x != -2]
        known = x >= 0
        out: dict[int, list[bytes]] = defaultdict(list)
        for width in (2, 3):
            at = np.flatnonzero(np.logical_and.reduce([known[k : len(x) - width + 1 + k] for k in range(width)])) if len(x) >= width else np.zeros(0, np.int64)
            part = [ids[x[at + k]] for k in range(width)]
            high, low, n = runs(packed(part[0], part[1]), (part[2] if width == 3 else np.zeros(len(at))).astype(np.uint64))
            place = np.searchsorted(sorted_ids := np.sort(ids), np.array([high >> np.uint64(32), high & np.uint64(0xFFFFFFFF), low][:width]).astype(np.int64))
            by_id = np.argsort(ids)
            place = by_id[np.minimum(place, len(sorted_ids) - 1)] if len(ids) else place
            where = ranges.of([count[p] for p in place], [below[p] for p in place])
            edges = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.zeros(0, np.int64)
            for lo, hi in zip(edges, [*edges[1:], len(where)], strict=False):
                out[int(where[lo])].append(X.join_parts(bytes([width]), X.pack(high[lo:hi].astype(np.int64)), L.number_block(low[lo:hi]), L.number_block(n[lo:hi])))
        blocks_out = [(r, block) for r, some in sorted(out.items()) for block in some]
        chunk = table.column("chunk")[0].as_py()
        released()
        return X.binary_table(names, [r for r, _ in blocks_out], [chunk] * len(blocks_out), [b for _, b in blocks_out])

    def gather(table: pa.Table) -> pa.Table:
        found: list[np.ndarray] = []
        split = [X.split_parts(p, 4) for p in table.column("payload").to_pylist()]
        for width in (2, 3):
            mine = [s for s in split if s[0][0] == width]
            if not mine:
                continue
            high, low, n = runs(np.concatenate([X.unpack(s[1]) for s in mine]).astype(np.uint64), np.concatenate([L.numbers_in(s[2]) for s in mine]).astype(np.uint64), np.concatenate([L.numbers_in(s[3]) for s in mine]))
            keep = n >= least
            high, low, n = high[keep], low[keep].astype(np.int64), n[keep]
            found.append(np.array([(high >> np.uint64(32)).astype(np.int64), (high & np.uint64(0xFFFFFFFF)).astype(np.int64), low if width == 3 else np.full(len(n), -1), n]))
        rows = np.concatenate(found, axis=1)
        del split, found
        released()
        return pa.table([pa.array(r) for r in rows], names=["id1", "id2", "id3", "f"])

    replies = L.answers(L.requests(chunked, keys_of, parts), words.where("id >= 0").select("bucket", "key", "id", "n", "below"), answer)
    sent = chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, X.SETS)
    return sent.groupBy("bucket").applyInArrow(gather, "id1 long, id2 long, id3 long, f long")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)); at most 1000000, as no part is rarer than the whole."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def candidates(found: DataFrame, words: DataFrame, cover: int = COVER) -> DataFrame:
    """lang, phrase, a, and l, r and score of the lowest-scoring cut, without phrases that a longer one covers."""
    names = words.where("id >= 0").select("id", "lang", F.col("word").cast("string").alias("word"), "n")
    first, second = (names.select(F.col("id").alias(f"id{k}"), *([F.col("lang")] if k == 1 else []), F.col("word").alias(f"w{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    two = found.where("id3 < 0").drop("id3").join(first, "id1").join(second, "id2")
    three = found.where("id3 >= 0")
    start = two.select("id1", "id2", "lang", "w1", "w2", "n1", F.col("f").alias("f12"))
    end = two.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("w2").alias("w3"), F.col("n2").alias("n3"), F.col("f").alias("f23"))
    long = three.join(start, ["id1", "id2"]).join(end, ["id2", "id3"])
    longest = three.select("id1", "id2", "f").unionByName(three.select(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "f")).groupBy("id1", "id2").agg(F.max("f").alias("longer"))
    free = two.join(longest, ["id1", "id2"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("f"), F.lit(True)))
    pairs = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), F.col("n1").alias("l"), F.col("n2").alias("r"), score(F.col("f"), F.col("n1"), F.col("n2")).alias("score"))
    cuts = long.select("*", score(F.col("f"), F.col("n1"), F.col("f23")).alias("s1"), score(F.col("f"), F.col("f12"), F.col("n3")).alias("s2"))
    one = F.col("s1") <= F.col("s2")
    triples = cuts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(one, F.col("n1")).otherwise(F.col("f12")).alias("l"), F.when(one, F.col("f23")).otherwise(F.col("n3")).alias("r"), F.least("s1", "s2").alias("score"))
    return pairs.unionByName(triples)


def ranked(phrases_of: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """The first of each language; each is ranked among those of a salt before, so that no task sorts all of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases_of.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    parts = max(LEAST_PARTS, -(-size // CHUNK_TEXT))
    words = dictionary(word_counts(docs, text_col, lang_col), least, parts)
    if (words.agg(F.max("id").alias("id")).first().id or 0) >= MOST_WORDS:
        raise ValueError("more frequent words than ids")
    found = written(phrases(docs, words, parts, least, size, text_col, lang_col, id_col))
    best = ranked(candidates(found, words), top)
    totals = words.where("id < 0").select("lang", F.col("n").alias("total"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
