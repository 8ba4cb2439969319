"""Affine, projective and bilinear maps between planes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def affine(gt: Column, col: Column, row: Column) -> Pair:
    """Pixel to ground by a six-element geotransform."""
    return gt[0] + gt[1] * col + gt[2] * row, gt[3] + gt[4] * col + gt[5] * row


def affine_inverse(gt: Column, x: Column, y: Column) -> Pair:
    """Ground to pixel; null for a singular transform."""
    det = gt[1] * gt[5] - gt[2] * gt[4]
    dx, dy = x - gt[0], y - gt[3]
    return F.try_divide(gt[5] * dx - gt[2] * dy, det), F.try_divide(gt[1] * dy - gt[4] * dx, det)


def homography(h: list[Column], x: Column, y: Column) -> Pair:
    """Coefficients a0 a1 a2 b0 b1 b2 c0 c1: (a0 + a1 x + a2 y, b0 + b1 x + b2 y) / (1 + c0 x + c1 y)."""
    a0, a1, a2, b0, b1, b2, c0, c1 = h
    w = 1 + c0 * x + c1 * y
    return F.try_divide(a0 + a1 * x + a2 * y, w), F.try_divide(b0 + b1 * x + b2 * y, w)


def homography_inverse(h: list[Column], u: Column, v: Column) -> Pair:
    """Solves the two linear equations that a target point puts on its source."""
    a0, a1, a2, b0, b1, b2, c0, c1 = h
    p, q, r = a1 - u * c0, a2 - u * c1, u - a0
    s, t, w = b1 - v * c0, b2 - v * c1, v - b0
    det = p * t - q * s
    return F.try_divide(r * t - q * w, det), F.try_divide(p * w - r * s, det)


def bilinear(u: Column, v: Column, ul: Column, ur: Column, lr: Column, ll: Column) -> Column:
    """Value at row fraction u and column fraction v of a quadrilateral with the given corner values."""
    return ul + u * (ll - ul) + v * (ur - ul) + u * v * (ul + lr - ur - ll)


def chip_to_full(col: Column, row: Column, n_cols: Column, n_rows: Column, corners: list[Pair]) -> Pair:
    """Chip pixel to full image by its corners UL, UR, LR, LL given as (column, row)."""
    u, v = F.try_divide(row, n_rows - 1), F.try_divide(col, n_cols - 1)
    return bilinear(u, v, *(c[0] for c in corners)), bilinear(u, v, *(c[1] for c in corners))
