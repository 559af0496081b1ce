"""Masking of secrets, driven by the schema and not by the data."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableferry import fixed
from tableferry.functions.casts import is_string, js_text


def _walk(c: Column, dt: T.DataType, pattern: str) -> Column:
    if isinstance(dt, T.StructType) and _touches(dt, pattern):
        fields = [
            _field(c.getField(f.name), f.name, f.dataType, pattern).alias(f.name)
            for f in dt.fields
        ]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(dt, T.ArrayType) and _touches(dt, pattern):
        return F.transform(c, lambda x: _walk(x, dt.elementType, pattern))
    if isinstance(dt, T.MapType):
        value = dt.valueType
        if not is_string(value):
            # the mask is text, so the other values of the map become text too
            c = F.transform_values(c, lambda k, v: js_text(_walk(v, value, pattern), value))
        return F.transform_values(
            c, lambda k, v: F.when(k.cast("string").rlike(pattern), fixed.MASK).otherwise(v)
        )
    return c


def _field(c: Column, name: str, dt: T.DataType, pattern: str) -> Column:
    if re.search(pattern, name):
        return F.lit(fixed.MASK)
    return _walk(c, dt, pattern)


def _touches(dt: T.DataType, pattern: str) -> bool:
    """Whether anything below this type could be masked at all."""
    if isinstance(dt, T.StructType):
        return any(re.search(pattern, f.name) or _touches(f.dataType, pattern) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _touches(dt.elementType, pattern)
    return isinstance(dt, T.MapType)


def redact(df: DataFrame, pattern: str = fixed.SECRET_NAME) -> DataFrame:
    """Mask every field whose name matches, at any depth, its NULLs included.

    Names are matched as substrings, so ``c_custkey`` is masked too.  One narrow
    projection; columns that cannot hold a match pass through unchanged.
    """
    cols = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*cols).select(
        *[
            _field(F.col(c), f.name, f.dataType, pattern).alias(f.name)
            for c, f in zip(cols, df.schema.fields)
        ]
    )


def redact_config(value, pattern: str = fixed.SECRET_NAME):
    """The same rule for a plain dict, such as an endpoint config in a run event."""
    if isinstance(value, dict):
        return {
            k: fixed.MASK if re.search(pattern, str(k)) else redact_config(v, pattern)
            for k, v in value.items()
        }
    if isinstance(value, (list, tuple)):
        return [redact_config(v, pattern) for v in value]
    return value
