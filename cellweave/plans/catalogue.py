"""All registered queries of the image and single-cell operators, and their DuckDB SQL."""

from __future__ import annotations

from . import fits, images, more, outlines, rasters, runs, stores, tables

FLAGSHIP = "a4_cell_statistics"
QUERIES = images.QUERIES | tables.QUERIES | more.QUERIES | fits.QUERIES | rasters.QUERIES | outlines.QUERIES | runs.QUERIES | stores.QUERIES
ORACLE_SQL = images.ORACLE_SQL | tables.ORACLE_SQL | more.ORACLE_SQL | fits.ORACLE_SQL | rasters.ORACLE_SQL | outlines.ORACLE_SQL | runs.ORACLE_SQL | stores.ORACLE_SQL
