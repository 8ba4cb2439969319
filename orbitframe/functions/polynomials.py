"""Polynomials whose coefficients are array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed order of the rational polynomial's twenty terms, as powers of longitude, latitude and height.
RPC_TERMS = [
    (0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 1, 1), (2, 0, 0), (0, 2, 0), (0, 0, 2),
    (1, 1, 1), (3, 0, 0), (1, 2, 0), (1, 0, 2), (2, 1, 0), (0, 3, 0), (0, 1, 2), (2, 0, 1), (0, 2, 1), (0, 0, 3),
]
#: Fixed order of the low-order polynomial's ten terms, as powers of x, y and z.
LOW_ORDER_TERMS = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (2, 0, 0), (1, 1, 0), (1, 0, 1), (0, 2, 0), (0, 1, 1), (0, 0, 2)]


def _product(factors: list[Column]) -> Column | None:
    return reduce(lambda a, b: a * b, factors) if factors else None


def _terms(coefficients: Column, powers: list[tuple[int, int, int]], x: Column, y: Column, z: Column) -> Column:
    total = None
    for i, (a, b, c) in enumerate(powers):
        factor = _product([x] * a + [y] * b + [z] * c)
        term = coefficients[i] if factor is None else coefficients[i] * factor
        total = term if total is None else total + term
    return total


def rpc(coefficients: Column, lon: Column, lat: Column, height: Column) -> Column:
    return _terms(coefficients, RPC_TERMS, lon, lat, height)


def low_order(coefficients: Column, x: Column, y: Column, z: Column) -> Column:
    return _terms(coefficients, LOW_ORDER_TERMS, x, y, z)


def rsm(coefficients: Column, px: int, py: int, pz: int, x: Column, y: Column, z: Column) -> Column:
    """Sum of c x^i y^j z^k, i running fastest; a wrong number of coefficients is an error."""
    powers = [(i, j, k) for k in range(pz + 1) for j in range(py + 1) for i in range(px + 1)]
    fits = F.size(coefficients) == len(powers)
    return F.when(fits, _terms(coefficients, powers, x, y, z)).otherwise(F.raise_error(F.lit("wrong number of coefficients")).cast("double"))


def rsm_of_powers(coefficients: Column, powers: Column, x: Column, y: Column, z: Column) -> Column:
    """As rsm, of powers that stand in the row as an array."""
    p, q = powers[0] + 1, powers[1] + 1
    term = lambda c, i: c * F.pow(x, i % p) * F.pow(y, F.floor(i / p) % q) * F.pow(z, F.floor(i / (p * q)))
    total = F.aggregate(F.transform(coefficients, term), F.lit(0.0), lambda acc, v: acc + v)
    return F.when(F.size(coefficients) == p * q * (powers[2] + 1), total).otherwise(F.raise_error(F.lit("wrong number of coefficients")).cast("double"))


def horner(coefficients: Column, t: Column) -> Column:
    """One-variable polynomial, lowest order first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, c: acc * t + c)


def derivative(coefficients: Column, order: int = 1) -> Column:
    for _ in range(order):
        coefficients = F.when(F.size(coefficients) > 1, F.transform(F.slice(coefficients, F.lit(2), F.greatest(F.size(coefficients) - 1, F.lit(0))), lambda c, i: c * (i + 1))).otherwise(F.array(F.lit(0.0)))
    return coefficients


def surface(coefficients: Column, x: Column, y: Column) -> Column:
    """Sum of c[i][j] x^i y^j over an array of arrays."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda acc, row: acc * x + horner(row, y))


def vector(xs: Column, ys: Column, zs: Column, t: Column) -> tuple[Column, Column, Column]:
    return horner(xs, t), horner(ys, t), horner(zs, t)


def dense(pairs: Column, order: Column) -> Column:
    """Array of order + 1 values from structs (exponent, value); absent exponents are 0."""
    table = F.map_from_entries(pairs)
    return F.transform(F.sequence(F.lit(0), order), lambda i: F.coalesce(F.try_element_at(table, i), F.lit(0.0)))


def normalize(value: Column, offset: Column, scale: Column) -> Column:
    return (value - offset) / scale


def denormalize(value: Column, offset: Column, scale: Column) -> Column:
    return value * scale + offset
