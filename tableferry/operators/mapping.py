"""Column mapping: project, rename, reorder and cast in one narrow select."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableferry.functions.casts import (
    cast_lenient,
    cast_strict,
    result_type,
)
from tableferry.plans.spec import MappingItem


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, tuple[str, T.DataType]]]:
    """Rename columns to c0, c1, ... and give a case-sensitive lookup of the old names.

    Spark resolves names without case and reads dots as nesting; a mapping names
    columns exactly.  Of two columns with one name the last one counts.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    lookup = {f.name: (n, f.dataType) for n, f in zip(names, df.schema.fields)}
    return df.toDF(*names), lookup


def fold_targets(mapping: Iterable) -> dict[str, MappingItem]:
    """One item per target: the last one's value at the first one's position."""
    return {m.to: m for m in map(MappingItem.of, mapping)}


def mapped_column(
    item: MappingItem,
    lookup: dict[str, tuple[str, T.DataType]],
    dialect: str = "strict",
    *,
    blank_as_null: bool = False,
    date_formats=(),
) -> Column:
    """The expression for one target column; a source that is not there is NULL."""
    if item.source not in lookup:
        return F.lit(None).cast(result_type(T.StringType(), item.cast, dialect))
    name, dt = lookup[item.source]
    if dialect == "lenient":
        return cast_lenient(F.col(name), dt, item.cast, date_formats=date_formats)
    return cast_strict(
        F.col(name), dt, item.cast, blank_as_null=blank_as_null, date_formats=date_formats
    )


def apply_mapping(df: DataFrame, mapping=None, dialect: str = "strict", **options) -> DataFrame:
    """Columns in mapping order; no or an empty mapping passes the frame through.

    ``dialect`` is ``strict`` or ``lenient``.  In the strict dialect blank text
    reads as the number 0; ``blank_as_null=True`` reads it as NULL.
    """
    if dialect not in ("strict", "lenient"):
        raise ValueError(f"unknown cast dialect: {dialect}")
    if not mapping:
        return df
    base, lookup = positional(df)
    return base.select(
        *[
            mapped_column(item, lookup, dialect, **options).alias(to)
            for to, item in fold_targets(mapping).items()
        ]
    )


def auto_map(source_columns: Iterable[str], destination_columns: Iterable[str]) -> list[MappingItem]:
    """Map by name without case, in the destination's spelling, everything as text."""
    spelling: dict[str, str] = {}
    for name in destination_columns:
        spelling.setdefault(name.lower(), name)
    return [MappingItem(c, spelling.get(c.lower(), c), "STRING") for c in source_columns]
