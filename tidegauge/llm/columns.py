"""Names of internal columns that meet no column of a table, whatever it is called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructField, StructType


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The ``names``, each with underscores put in front until no column of ``df`` is called so, letter case aside."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def mapped_in_arrow(df: DataFrame, run: Callable, schema: StructType) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for columns of any name: batches have their columns in order, under plain names."""
    plain = [StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, StructType(plain)).toDF(*schema.names)
