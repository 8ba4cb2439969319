"""Pixel values: complex samples, display stretches and the ranges of sample types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed ranges of the sample types; an unknown type has the range of a byte.
TYPE_RANGES = {
    "Byte": (0.0, 255.0), "UInt16": (0.0, 65535.0), "Int16": (-32768.0, 32767.0), "UInt32": (0.0, 4294967295.0), "Int32": (-2147483648.0, 2147483647.0),
    "UInt64": (0.0, 18446744073709551615.0), "Int64": (-9223372036854775808.0, 9223372036854775807.0), "Float32": (-3.4028234663852886e38, 3.4028234663852886e38), "Float64": (-1.7976931348623157e308, 1.7976931348623157e308),
}


def type_range(kind: Column) -> Column:
    """Struct lo, hi of a sample type."""
    out = F.struct(F.lit(0.0).alias("lo"), F.lit(255.0).alias("hi"))
    for name, (lo, hi) in TYPE_RANGES.items():
        out = F.when(kind == name, F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))).otherwise(out)
    return out


def to_complex(first: Column, second: Column, kind: Column, amplitudes: Column) -> Column:
    """Struct i, q of a sample.  Amplitude-and-phase bytes go through the table of amplitudes; other unknown types are an error."""
    plain = kind.isin("RE32F_IM32F", "RE16I_IM16I") | kind.isNull()
    amp = F.coalesce(F.try_element_at(amplitudes, first.cast("int") + 1), first.cast("double"))
    angle = second * (2 * 3.141592653589793 / 256)
    return (
        F.when(plain, F.struct(first.cast("double").alias("i"), second.cast("double").alias("q")))
        .when(kind == "AMP8I_PHS8I", F.struct((amp * F.cos(angle)).alias("i"), (amp * F.sin(angle)).alias("q")))
        .otherwise(F.raise_error(F.concat(F.lit("unknown pixel type "), kind)).cast("struct<i:double,q:double>"))
    )


def power(i: Column, q: Column) -> Column:
    return i * i + q * q


def decibels(p: Column) -> Column:
    """10 log10 of a power; minus infinity for 0."""
    return F.when(p == 0, F.lit(float("-inf"))).otherwise(10 * F.log10(p))


def finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) < float("inf"))


def clip(v: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def linear(v: Column, lo: Column, hi: Column) -> Column:
    """0 to 1 over a range; 0.5 for an empty one.  Kept in double precision."""
    return F.when(hi == lo, F.lit(0.5)).otherwise(clip((v - lo) / (hi - lo), 0.0, 1.0))


def histogram_stretch(v: Column, mean: Column, scale: float = 8.0) -> Column:
    return clip(255 * v / (F.lit(scale) * mean), 0.0, 255.0)


def quarter_power(v: Column, mean: Column, scale: float = 3.0) -> Column:
    """mean is that of the square roots."""
    return clip(255 * F.sqrt(F.abs(v)) / (F.lit(scale) * mean), 0.0, 255.0)


def minmax_byte(v: Column, lo: Column, hi: Column) -> Column:
    """Display byte; the divisor is the largest value, not the range, as the pinned results ask."""
    return F.floor(clip((v - lo) * (255.0 / F.greatest(hi, F.lit(1.0))), 0.0, 255.0)).cast("int")


def dra_byte(v: Column, lo: Column, hi: Column) -> Column:
    return F.floor(clip(255 * (v - lo) / F.greatest(hi - lo, F.lit(1.0)), 0.0, 255.0)).cast("int")
