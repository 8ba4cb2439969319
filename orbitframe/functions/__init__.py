"""Column expressions: geodesy, polynomials, projective maps, map tiles, radiometry and text."""
