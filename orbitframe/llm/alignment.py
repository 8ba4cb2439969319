"""Cross-tokenizer alignment (operator 13).

Method: relational.  Tokens are exploded with their places, a window sums their byte lengths up to each token's end,
the ends of both tokenizers are joined on text and end, and where both end is a cut; a running count of cuts numbers
the groups.  Every end of either is the end of one link, that of the tokens which reach over it, so running windows
name the links one row each and no group is paired within itself.  A grouped sum counts the pairs of ids, a window
finds the highest count of each B id, and a join brings both back to the links.

Both tokenizers always end a token before a space that follows something else than white space, so texts are cut into
words there and the relations are built over the distinct words of the corpus and how often they occur, which gives
the same sums as over the texts.  A document's row is then put together from its words: chunks of documents look their
distinct words up (``lookups.py``).

The only character that the piece model loses is U+2581, so texts with it have no tokens, as null and empty ones; a
word whose tokens' bytes differ otherwise is an error.  Rows are judged one by one: repeated rows count as often as
they come, null ids stand for themselves, extra columns are ignored, whatever their names, and an empty table gives an
empty result.  Equal counts all are the highest.  Tokenizer files are read by path on the executors.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.llm import lookups as L
from orbitframe.llm.exchange import join_parts, split_parts
from orbitframe.llm.shared import dropped, released, written

MARK = "▁"
#: White space before a space: there the words are cut by the rule, otherwise at every space.
RUN = re.compile(r"\s ")
BORDER = re.compile(r"(?<=\S)(?= )")
#: Distinct words a task keeps counts of before it sends them on, text of a chunk of documents, and least number of chunks.
WORDS_KEPT, CHUNK_TEXT, LEAST_PARTS = 200_000, 16 << 20, 64
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_loaded: dict[tuple[str, str], "Tokenizers"] = {}


class Tokenizers:
    """Byte-level tokenizer A and piece model B, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves as characters
        byte = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in plain)}
        vocabulary = sorted(self.a.get_vocab().items(), key=lambda x: x[1])
        self.a_bytes = [bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode() for token, _ in vocabulary]
        if [i for _, i in vocabulary] != list(range(len(vocabulary))):
            raise ValueError("ids of the byte-level tokenizer have gaps")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        probe = self.b.encode("x")
        self.space = self.b.encode("x ")[len(probe) :]  # a space at the end, which alone would be an empty text

    def encode(self, words: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [e.ids for e in self.a.encode_batch_fast([" " + w for w in words], add_special_tokens=False)]
        b = [ids if w else self.space for w, ids in zip(words, self.b.encode(words, num_threads=1), strict=True)]
        for word, x, y in zip(words, a, b, strict=True):
            data = b" " + word.encode()
            if b"".join(map(self.a_bytes.__getitem__, x)) != data or b"".join(map(self.b_bytes.__getitem__, y)) != data:
                raise ValueError(f"tokens do not give back {word!r}")
        return a, b


def tokenizers_of(a_path: str, b_path: str) -> Tokenizers:
    if (a_path, b_path) not in _loaded:
        _loaded.clear()
        _loaded[a_path, b_path] = Tokenizers(a_path, b_path)
    return _loaded[a_path, b_path]


def words_of(text: str | None) -> list[str]:
    """The words of a space and the text, without the space that each begins with; none for texts without tokens."""
    if not text or MARK in text:
        return []
    full = " " + text
    return [w[1:] for w in BORDER.split(full)] if RUN.search(full) else text.split(" ")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """key (the word's bytes) and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in counts], pa.binary()), pa.array(counts.values(), pa.int64())], ["key", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) >= WORDS_KEPT:
                    yield sent()
        yield sent()
        released()

    return docs.select(text_col).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _lists(rows: list[list[int]], sizes: np.ndarray) -> tuple[pa.Array, pa.Array]:
    ends = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    flat = np.fromiter((i for r in rows for i in r), np.int32, int(ends[-1]))
    return pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, sizes[flat].astype(np.int32))


def tokens_of(counts: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """word (a number), key, n, and ids and byte lengths of both tokenizers; the numbers hold once the rows are written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_of(a_path, b_path)
        a_size, b_size = np.array([len(t) for t in both.a_bytes]), np.array([len(t) for t in both.b_bytes])
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            a, b = both.encode([k.decode() for k in batch.column(0).to_pylist()])
            numbers = pa.array(np.arange(number, number + batch.num_rows))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([numbers, *batch.columns, *_lists(a, a_size), *_lists(b, b_size)], ["word", "key", "n", "a", "a_size", "b", "b_size"])
        del both
        _loaded.clear()  # later stages have no use for the tokenizers
        released()

    return counts.mapInArrow(run, "word long, key binary, n long, a array<int>, a_size array<int>, b array<int>, b_size array<int>")


def ends_of(tokens: DataFrame, ids: str, sizes: str) -> DataFrame:
    """word, end and id of each token, dealt by word."""
    exploded = tokens.select("word", ids, sizes).repartition("word").select("word", F.posexplode(F.arrays_zip(ids, sizes)).alias("place", "token"))
    return exploded.select("word", F.sum(f"token.{sizes}").over(Window.partitionBy("word").orderBy("place")).alias("end"), F.col(f"token.{ids}").alias(ids))


def links_of(tokens: DataFrame) -> DataFrame:
    """A row for each link: word, end, the ids a and b that end there (or null), the linked ids, and the cuts from there on."""
    ends = ends_of(tokens, "a", "a_size").join(ends_of(tokens, "b", "b_size"), ["word", "end"], "full_outer")
    onward = Window.partitionBy("word").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)
    return ends.select("word", "end", "a", "b", F.last("a", True).over(onward).alias("link_a"), F.last("b", True).over(onward).alias("link_b"), F.count(cut).over(onward).alias("cuts"))


def aligned_words(tokens: DataFrame) -> DataFrame:
    """word, its numbers of tokens, groups and links, its groups as text, and its links."""

    def listed(column: str) -> F.Column:
        found = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct("end", column))))
        return F.concat_ws(",", F.transform(found, lambda x: x[column].cast("string")))

    groups = links_of(tokens).groupBy("word", "cuts").agg(
        F.concat(listed("a"), F.lit("|"), listed("b")).alias("ids"), F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count("*").alias("n_links"), F.collect_list(F.struct("link_a", "link_b")).alias("links")
    )
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("cuts")).alias("at"), "ids")))
    return groups.groupBy("word").agg(
        F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"), F.sum("n_links").alias("n_links"), F.concat_ws(";", F.transform(in_order, lambda x: x["ids"])).alias("groups"), F.flatten(F.collect_list("links")).alias("links")
    )


def pair_counts(words: DataFrame) -> DataFrame:
    """link_a, link_b, count and whether the count is the B id's highest; a B id has as many rows as A has ids at most."""
    counts = words.select("n", F.inline("links")).groupBy("link_a", "link_b").agg(F.sum("n").alias("count"))
    return counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("link_b"))).cast("int"))


@contextlib.contextmanager
def dealt_by_word(spark: SparkSession) -> Iterator[None]:
    """Joins on word and end take rows that are dealt by word alone as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def judged_words(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """key, NUMBERS and groups of every distinct word, written."""
    tokens = written(tokens_of(word_counts(docs, text_col), a_path, b_path))
    with dealt_by_word(docs.sparkSession):
        words = written(aligned_words(tokens).join(tokens.select("word", "key", "n"), "word"))
    dropped(tokens)
    pairs = written(pair_counts(words))
    scores = words.select("word", F.inline("links")).join(pairs, ["link_a", "link_b"]).groupBy("word").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    judged = written(words.drop("links", "n").join(scores, "word").select("key", *NUMBERS, "groups"))
    dropped(words)
    dropped(pairs)
    return judged


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, NUMBERS and groups_sha256 of every row."""
    judged = judged_words(docs, a_path, b_path, text_col)
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first().n or 0
    parts = max(LEAST_PARTS, -(-size // CHUNK_TEXT))
    chunked = docs.select(F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("int").alias("chunk"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def keys_of(table: pa.Table) -> set[bytes]:
        found: set[str] = set()
        for text in table.column("text"):
            found.update(words_of(text.as_py()))
        return {w.encode() for w in found}

    def answer(rows: pa.Table, places: np.ndarray) -> bytes:
        found = rows.take(pa.array(places)).combine_chunks()
        return join_parts(*(L.number_block(found.column(c).to_numpy()) for c in NUMBERS), L.binary_block(found.column("groups").combine_chunks()))

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        names = [id_col, *NUMBERS, "groups_sha256"]
        if not table.num_rows:
            return pa.table([table.column("id"), *(pa.array([], pa.int64()) for _ in NUMBERS), pa.array([], pa.string())], names=names)
        keys, blocks = L.in_order(replies, keys_of(table), parts)
        place = {k.decode(): i for i, k in enumerate(keys)}
        split = [split_parts(b, len(NUMBERS) + 1) for b in blocks]
        numbers = np.stack([np.concatenate([L.numbers_in(s[c]) for s in split]) for c in range(len(NUMBERS))], 1) if split else np.zeros((0, len(NUMBERS)), np.int64)
        groups = [g for s in split for g in L.keys_in(s[-1]).to_pylist()]
        del keys, blocks, split  # the worker's memory is bounded by a chunk's words
        sums, digests = np.zeros((table.num_rows, len(NUMBERS)), np.int64), []
        for row, text in enumerate(table.column("text")):
            words = words_of(text.as_py())
            at = [place[w] for w in words]
            for lo in range(0, len(at), 1 << 16):  # bounds the arrays
                sums[row] += numbers[np.array(at[lo : lo + (1 << 16)])].sum(0)
            digests.append(hashlib.sha256(b";".join([groups[i] for i in at])).hexdigest() if at else "")
        del place, groups, numbers
        released()
        return pa.table([table.column("id"), *(pa.array(c) for c in sums.T.copy()), pa.array(digests, pa.string())], names=names)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string"
    rows = judged.withColumn("bucket", L.bucket_of(F.col("key"), parts))
    replies = L.answers(L.requests(chunked, keys_of, parts), rows, answer)
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(finish, schema)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *default_tokenizers())
