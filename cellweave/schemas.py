"""Schemas of the standard tables, and the check that a frame has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMAS = {
    name: T.StructType.fromDDL(ddl)
    for name, ddl in {
        "pixel": "image_id long, c int, y int, x int, value int",
        "mask": "mask string, y int, x int, cell_id long",
        "centers": "mask string, cell_id long, y double, x double",
        "cell_image": "cell_id long, c int, channel string, kind string, y int, x int, value float",
        "features": "cell_id long, region string, y double, x double",
        "shard": "id int, y0 int, y1 int, x0 int, x1 int",
        "cell_set": "name string, well string, cell_id long",
        "edge": "a long, b long, dy double, dx double, error double",
        "locator": "label double, path string, idx int, cell_id long",
    }.items()
}


def validate(df: DataFrame, name: str) -> DataFrame:
    """df, if it has the table's columns and types (others may follow)."""
    have = dict(df.dtypes)
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in SCHEMAS[name] if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"{name} needs: {', '.join(wrong)}")
    return df
