"""Registered queries with their SQL."""

from __future__ import annotations

from orbitframe.plans import files, geodesy, imagery, mixed, rasters, sar_images, shapes

QUERIES = geodesy.QUERIES | imagery.QUERIES | sar_images.QUERIES | mixed.QUERIES | shapes.QUERIES | rasters.QUERIES | files.QUERIES
ORACLES = geodesy.ORACLES | imagery.ORACLES | sar_images.ORACLES | mixed.ORACLES | shapes.ORACLES | rasters.ORACLES | files.ORACLES
