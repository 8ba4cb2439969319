"""Histograms, range adjustment, tile limits and least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import radiometry as R


def value_bounds(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def _number(buckets: int | str) -> Column:
    return F.col(buckets) if isinstance(buckets, str) else F.lit(buckets)


def histogram(pixels: DataFrame, keys: list[str], bounds: DataFrame, buckets: int | str, value: str = "v") -> DataFrame:
    """keys, bin, n for equal buckets between each group's bounds; values at the top go to the last bucket.

    Where each group has its own number of buckets, the name of the bounds' column with it is given, and kept.
    """
    many = _number(buckets)
    at = F.least(F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("lo")) * many, F.col("hi") - F.col("lo")), F.lit(0.0))), many - 1).cast("int")
    own = [buckets] if isinstance(buckets, str) else []
    return pixels.join(bounds, keys).where(F.col(value).between(F.col("lo"), F.col("hi"))).groupBy(*keys, *own, at.alias("bin")).agg(F.count("*").alias("n"))


def dra_parameters(counts: DataFrame, keys: list[str], buckets: int | str, min_share: float = 0.02, max_share: float = 0.98, a: float = 0.2, b: float = 0.4) -> DataFrame:
    """keys, lo, hi (suggested) and actual_lo, actual_hi in bins, from rows keys, bin, n of a histogram.

    Bins without rows are empty.  A window runs over one group's bins, of which there are buckets at most.
    """
    window = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.where(F.col("n") > 0).withColumns({"upto": F.sum("n").over(window), "whole": F.sum("n").over(Window.partitionBy(*keys)), "after": F.lead("bin").over(Window.partitionBy(*keys).orderBy("bin"))})
    c = F.col
    low_at = F.min(F.when(c("upto") >= min_share * c("whole"), c("bin")))
    # the last bin whose running sum is within the share: an empty bin has the sum of the full one before it
    high_at = F.max(F.when(c("upto") <= max_share * c("whole"), F.coalesce(c("after"), _number(buckets)) - 1))
    first_bin = F.min("bin")
    rows = summed.groupBy(*keys).agg(low_at.alias("e_min"), F.coalesce(high_at, F.greatest(first_bin - 1, F.lit(0))).alias("e_max"), first_bin.alias("actual_lo"), F.max("bin").alias("actual_hi"))
    rows = rows.withColumn("e_min", F.when(F.lit(min_share) == 0, F.lit(0)).otherwise(c("e_min")))
    spread = c("e_max") - c("e_min")
    return rows.select(*keys, F.greatest(c("actual_lo").cast("double"), c("e_min") - a * spread).alias("lo"), F.least(c("actual_hi").cast("double"), c("e_max") + b * spread).alias("hi"), "actual_lo", "actual_hi")


def in_values(parameters: DataFrame, bounds: DataFrame, keys: list[str], buckets: int | str) -> DataFrame:
    """Bins of dra_parameters as pixel values; a top bound of 0 counts as not given."""
    c = F.col
    many = _number(buckets).cast("double")
    step = (F.when(c("last") == 0, many).otherwise(c("last")) - c("first")) / many
    own = [buckets] if isinstance(buckets, str) else []
    rows = parameters.join(bounds.select(*keys, *own, F.col("lo").alias("first"), F.col("hi").alias("last")), keys)
    return rows.select(*keys, *((c(n) * step + c("first")).alias(n) for n in ("lo", "hi", "actual_lo", "actual_hi")))


def band_scales(pixels: DataFrame, keys: list[str], kind: str | None, adjustment: str = "NONE", buckets: int = 255, value: str = "v", source: str = "Float64") -> DataFrame:
    """src_lo, src_hi, dst_lo, dst_hi of each band for NONE, MINMAX or DRA."""
    lo, hi = R.TYPE_RANGES.get(kind or source, (0.0, 255.0))
    out = [F.lit(lo).alias("dst_lo"), F.lit(hi).alias("dst_hi")]
    if adjustment == "NONE":
        lo, hi = R.TYPE_RANGES.get(source, (0.0, 255.0))
        return pixels.select(*keys).distinct().select(*keys, F.lit(lo).alias("src_lo"), F.lit(hi).alias("src_hi"), *out)
    bounds = value_bounds(pixels, keys, value)
    got = in_values(dra_parameters(histogram(pixels, keys, bounds, buckets, value), keys, buckets), bounds, keys, buckets)
    pick = ("lo", "hi") if adjustment == "DRA" else ("actual_lo", "actual_hi")
    return got.select(*keys, F.col(pick[0]).alias("src_lo"), F.col(pick[1]).alias("src_hi"), *out)


def stretched(pixels: DataFrame, keys: list[str], value: str = "v", how: str = "linear", scale: float | None = None) -> DataFrame:
    """Pixels with display values by their group's statistics: linear, histogram, quarter or minmax."""
    good = F.when(R.finite(F.col(value)), F.col(value))
    stats = pixels.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.avg(good).alias("_mean"), F.avg(F.sqrt(F.abs(good))).alias("_root"))
    v = F.col(value)
    made = {
        "linear": R.linear(v, F.col("_lo"), F.col("_hi")),
        "histogram": R.histogram_stretch(v, F.col("_mean"), scale or 8.0),
        "quarter": R.quarter_power(v, F.col("_root"), scale or 3.0),
        "minmax": R.minmax_byte(v, F.col("_lo"), F.col("_hi")),
    }[how]
    return pixels.join(stats, keys).withColumn("display", made).drop("_lo", "_hi", "_mean", "_root")


def sar_precomputed_mean(bands: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Square root of the summed squares of each band's mean plus 50/68 of its spread."""
    each = bands.groupBy(*keys, "band").agg((F.avg(value) + F.stddev_pop(value) * (50 / 68)).alias("m"))
    return each.groupBy(*keys).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("mean"))


def displayed(pixels: DataFrame, image: str = "image", adjustment: str = "MINMAX") -> DataFrame:
    """image, x, y and bands (array of bytes) ready to be encoded, from rows image, band, x, y, v.

    An image of one band is gray, of three or more shows its first three, each adjusted (MINMAX or DRA) by itself; one
    of two is a complex product, shown by its quarter power.  NONE casts all bands to bytes, which wrap around.
    """
    c = F.col
    if adjustment == "NONE":
        rows = pixels.withColumn("display", F.pmod(F.floor("v"), F.lit(256)).cast("int"))
    else:
        counts = pixels.groupBy(image).agg(F.max("band").alias("_bands"))
        rows = pixels.join(counts, image)
        plain = rows.where("_bands = 1 or (_bands >= 3 and band <= 3)")
        if adjustment == "DRA":
            keys = [image, "band"]
            bounds = value_bounds(plain, keys).withColumn("buckets", F.greatest(F.lit(256), F.floor(c("hi") - c("lo")).cast("int")))
            found = in_values(dra_parameters(histogram(plain, keys, bounds, "buckets"), keys, "buckets", max_share=0.97), bounds, keys, "buckets")
            plain = plain.join(found, keys).withColumn("display", R.dra_byte(c("v"), c("lo"), c("hi")))
        else:
            plain = plain.join(value_bounds(plain, [image, "band"]), [image, "band"]).withColumn("display", R.minmax_byte(c("v"), c("lo"), c("hi")))
        pair = rows.where("_bands = 2")
        power = pair.groupBy(image, "x", "y").agg(F.sum(c("v") * c("v")).alias("_power"), F.count("*").alias("_n")).where("_n = 2")
        shown = power.join(sar_precomputed_mean(pair, [image]), image).select(image, F.lit(1).alias("band"), "x", "y", F.floor(R.quarter_power(c("_power"), c("mean"))).cast("int").alias("display"))
        rows = plain.select(image, "band", "x", "y", "display").unionByName(shown)
    entries = F.array_sort(F.collect_list(F.struct("band", "display")))
    return rows.groupBy(image, "x", "y").agg(F.transform(entries, lambda e: e["display"]).alias("bands"))


def fit_homography(points: DataFrame, key: str, source: tuple[str, str], target: tuple[str, str], least: int = 4) -> DataFrame:
    """key and h, the eight coefficients fitted by least squares to each group's point pairs; groups with fewer points drop out.

    Sums of the normal equations are built by Spark, so a group of any size becomes one row of 44 numbers.  Both
    planes are moved to their means and scaled first, which keeps the equations well conditioned.
    """
    x, y, u, v = (F.col(n) for n in (*source, *target))
    stats = points.groupBy(key).agg(*(f(n).alias(f"_{g}{i}") for i, n in enumerate((*source, *target)) for f, g in ((F.avg, "m"), (F.stddev_pop, "s"))), F.count("*").alias("_n")).where(F.col("_n") >= least)
    scaled = points.join(stats, key).select(key, *_scaled(source, target), *[c for c in stats.columns if c != key])
    x, y, u, v = F.col("x"), F.col("y"), F.col("u"), F.col("v")
    one, zero = F.lit(1.0), F.lit(0.0)
    rows = [[one, x, y, zero, zero, zero, -u * x, -u * y, u], [zero, zero, zero, one, x, y, -v * x, -v * y, v]]
    pairs = [(i, j) for i in range(9) for j in range(i, 9)]
    sums = scaled.groupBy(key).agg(F.array(*(F.sum(rows[0][i] * rows[0][j] + rows[1][i] * rows[1][j]) for i, j in pairs)).alias("sums"), *(F.first(f"_{g}{i}").alias(f"_{g}{i}") for i in range(4) for g in "ms"))

    @F.pandas_udf("array<double>")
    def solved(s: pd.Series, moves: pd.DataFrame) -> pd.Series:
        out = []
        for values, move in zip(s, moves.to_numpy(), strict=True):
            m = np.zeros((9, 9))
            for (i, j), w in zip(pairs, values, strict=True):
                m[i, j] = m[j, i] = w
            h = np.linalg.lstsq(m[:8, :8], m[:8, 8], rcond=None)[0]
            (mx, sx), (my, sy), (mu, su), (mv, sv) = move.reshape(4, 2)
            core = np.array([[h[1], h[2], h[0]], [h[4], h[5], h[3]], [h[6], h[7], 1.0]])
            fro = np.array([[1 / sx, 0, -mx / sx], [0, 1 / sy, -my / sy], [0, 0, 1]])
            to = np.array([[su, 0, mu], [0, sv, mv], [0, 0, 1]])
            w = to @ core @ fro
            w /= w[2, 2]
            out.append([w[0, 2], w[0, 0], w[0, 1], w[1, 2], w[1, 0], w[1, 1], w[2, 0], w[2, 1]])
        return pd.Series(out)

    moves = F.struct(*(F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0).alias(f"s{i}") if g == "s" else F.col(f"_m{i}").alias(f"m{i}") for i in range(4) for g in "ms"))
    return sums.select(key, solved("sums", moves).alias("h"))


def _scaled(source: tuple[str, str], target: tuple[str, str]) -> list:
    """The four coordinates less their mean, over their spread."""
    names = zip("xyuv", (*source, *target), strict=True)
    return [((F.col(n) - F.col(f"_m{i}")) / F.when(F.col(f"_s{i}") > 0, F.col(f"_s{i}")).otherwise(1.0)).alias(a) for i, (a, n) in enumerate(names)]


def tile_limits(points: DataFrame, keys: list[str], row: str = "row", col: str = "col") -> DataFrame:
    """Least and largest tile row and column of each area."""
    return points.groupBy(*keys).agg(F.min(row).alias("min_row"), F.max(row).alias("max_row"), F.min(col).alias("min_col"), F.max(col).alias("max_col"))
