"""Quality classifier (operator 10).

Method: random Fourier features approximate a Gaussian kernel over standardized document statistics.  Each
partition adds up its part of the normal equations, Spark sums the parts by cell, and the driver solves one
ridge system of fixed size.  Scores are calibrated by isotonic regression on predictions for the fold that the
model did not see, gathered in a fixed number of score bins.

All labelled rows outside the held-out third train the model; there is no sample.  Only the text's statistics
enter a score.  Null texts count as empty and get a score like any other.  Several labels of one id are
averaged and null labels ignored; repeated documents are scored each; without labels every score is 0.5.  Null
ids are scored and not held out.  Extra columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.llm import kernels as K
from orbitframe.llm.quality_rules import SYMBOL, duplicate_lines, repetition
from orbitframe.llm.shared import checkpointed

FEATURES = [
    "log_words", "mean_word", "upper", "digit", "symbol", "exclaim", "stop", "comma", "quote", "non_ascii", "lines", "distinct", "adjacent", "dup_lines", "repeats", "longest", "capital", "top_word",
]
FOURIER = 160
GAMMA = 0.08
RIDGE = 1e-3
BINS = 512
SEED = 20240917


def _set(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


UPPER, DIGIT, BANG, STOP, COMMA, QUOTE = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789"), _set("!?"), _set("."), _set(",;:"), _set("\"'()[]{}=/\\@_")


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    docs = len(at) - 1
    out = np.zeros((docs, len(FEATURES)))
    if not len(data):
        return out
    starts, ends, first = K.words_of(data, at)
    solid = ~K.IS_SPACE[data]
    prefix = K.prefix_hash(K.BYTE_CODE[data])
    number = K.word_numbers(data, starts, ends)
    words = K.mix(number.astype(np.uint64))
    n = np.diff(first)
    some, many = np.maximum(n, 1), np.maximum(K.segment_sum(solid, at), 1)
    per_byte = lambda table: K.segment_sum(table[data], at) / many
    doc = np.repeat(np.arange(docs), n)
    key = np.sort(words + K.mix(doc.astype(np.uint64)))
    runs = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    distinct, top = np.zeros(docs, np.int64), np.zeros(docs, np.int64)
    order = np.argsort(words + K.mix(doc.astype(np.uint64)), kind="stable")
    owner = doc[order][runs]
    np.add.at(distinct, owner, 1)
    np.maximum.at(top, owner, np.diff(np.append(runs, len(key))))
    twice = np.append(False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])) if len(words) else np.zeros(0, bool)
    mask, longest = repetition(number, first)
    columns = [
        np.log1p(n), many / some, per_byte(UPPER), per_byte(DIGIT), per_byte(SYMBOL), per_byte(BANG), per_byte(STOP), per_byte(COMMA), per_byte(QUOTE), per_byte(np.arange(256) > 127),
        K.segment_sum(data == 10, at) / some, distinct / some, K.segment_sum(twice, first) / some, duplicate_lines(data, at, prefix, np.append(0, np.cumsum(solid))) / some, K.segment_sum(mask, first) / some, np.log1p(longest),
        K.segment_sum(UPPER[data[starts]], first) / some, top / some,
    ]
    for i, c in enumerate(columns):
        out[:, i] = c
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and an array of FEATURES for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, at in K.chunks(batch.column(1)):
                rows = statistics(data, at)
                arrays = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), arrays], [id_col, "stats"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(FEATURES)))


def fourier(stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Random Fourier features of standardized statistics, with a constant."""
    rng = np.random.default_rng(SEED)
    weights = rng.normal(0, np.sqrt(2 * GAMMA), (len(FEATURES), FOURIER))
    phase = rng.uniform(0, 2 * np.pi, FOURIER)
    z = np.clip((stats - mean) / spread, -6, 6)
    return np.hstack([np.sqrt(2 / FOURIER) * np.cos(z @ weights + phase), np.ones((len(stats), 1))])


def _moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean and spread of each statistic over the training rows."""
    row = labelled.select(*(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(FEATURES))), *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(FEATURES))), F.count("*").alias("n")).first()
    k = len(FEATURES)
    if not row.n:
        return np.zeros(k), np.ones(k), 0
    spread = np.array(row[k : 2 * k], float)
    return np.array(row[:k], float), np.where(spread > 1e-9, spread, 1.0), row.n


def _normal_equations(labelled: DataFrame, mean: np.ndarray, spread: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Sums of x x' and x y by fold; every partition sends one number per cell at most."""
    k = FOURIER + 1
    upper = np.triu_indices(k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.hstack([fourier(matrix(batch.column(1)), mean, spread), batch.column(2).to_numpy(zero_copy_only=False)[:, None]])
            fold = batch.column(0).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                part = x[fold == f]
                total[int(f)] = total.get(int(f), 0) + part.T @ part
        for f, sums in total.items():
            values = sums[upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), f), pa.int32()), pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["fold", "cell", "v"])

    rows = labelled.select("fold", "stats", "label").mapInArrow(run, "fold int, cell int, v double").groupBy("fold", "cell").agg(F.sum("v").alias("v")).collect()
    out = {}
    for f in sorted({r.fold for r in rows}):
        full = np.zeros((k + 1, k + 1))
        for r in rows:
            if r.fold == f:
                full[upper[0][r.cell], upper[1][r.cell]] = r.v
        full = full + np.triu(full, 1).T
        out[f] = (full[:k, :k], full[:k, k])
    return out


def _solve(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
    penalty = RIDGE * max(a[-1, -1], 1.0) * np.eye(len(b))
    penalty[-1, -1] = 0
    return np.linalg.solve(a + penalty + 1e-9 * np.eye(len(b)), b)


def isotonic(weight: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Weighted pool-adjacent-violators fit, rising."""
    blocks: list[list[float]] = []
    for w, m in zip(weight, mean, strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2]
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """Model from the labelled rows whose crc32 of the id leaves a remainder other than 1 by 3."""
    wanted = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.avg(label_col).alias("label"))
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)).cast("int")
    labelled = checkpointed(stats.join(wanted, F.col(id_col) == F.col("label_id")).select(fold.alias("fold"), "stats", "label").where(F.col("fold") != 1))
    mean, spread, n = _moments(labelled)
    if not n:
        return {"n": 0}
    parts = _normal_equations(labelled, mean, spread)
    whole = _solve(list(parts.values()))
    apart = {f: _solve([p for g, p in parts.items() if g != f]) if len(parts) > 1 else whole for f in parts}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = fourier(matrix(batch.column(1)), mean, spread), batch.column(0).to_numpy(zero_copy_only=False)
            raw = np.zeros(len(x))
            for f, w in apart.items():
                raw[fold == f] = x[fold == f] @ w
            yield pa.RecordBatch.from_arrays([pa.array(_bin(raw)), batch.column(2)], ["bin", "label"])

    seen = labelled.select("fold", "stats", "label").mapInArrow(run, "bin int, label double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("m")).orderBy("bin").collect()
    at = np.array([(r.bin + 0.5) / BINS * 2 - 0.5 for r in seen])
    rate = isotonic(np.array([r.n for r in seen], float), np.array([r.m for r in seen], float))
    return {"n": n, "mean": mean, "spread": spread, "weights": whole, "at": at, "rate": rate}


def _bin(raw: np.ndarray) -> np.ndarray:
    """Bins of raw scores from -0.5 to 1.5."""
    return np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)


def score(stats: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """id, held_out, score and predicted for every row."""
    kind = stats.schema[id_col].dataType.simpleString()
    shared = stats.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m["n"]:
                raw = fourier(matrix(batch.column(1)), m["mean"], m["spread"]) @ m["weights"]
                # ties of the calibrated steps are parted by the raw score, within a thousandth
                got = 0.999 * np.interp(raw, m["at"], m["rate"]) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)
            else:
                got = np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(got, 0, 1))], [id_col, "score"])

    scored = stats.select(id_col, "stats").mapInArrow(run, f"`{id_col}` {kind}, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = checkpointed(features(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return score(stats, fit(stats, spark.read.parquet(f"{sf_dir}/labels.parquet")))
