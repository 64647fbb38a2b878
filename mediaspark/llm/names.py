"""Column names: internal ones that cannot clash, and references to any name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unused(columns: list[str], base: str) -> str:
    """``base``, with underscores behind it until no given column has that name."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def all_of(columns: list[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def with_made(df: DataFrame, base: str, kind: T.DataType, run: Callable) -> DataFrame:
    """``df`` with one more column that ``run`` (for ``mapInArrow``) adds last; it is named ``base`` or the next free name.

    ``run`` sees columns by place, under plain names, so any name passes through.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    fields = [T.StructField(n, f.dataType) for n, f in zip(names, df.schema.fields, strict=True)]
    made = df.toDF(*names).mapInArrow(run, T.StructType([*fields, T.StructField("made", kind)]))
    return made.toDF(*df.columns, unused(df.columns, base))
