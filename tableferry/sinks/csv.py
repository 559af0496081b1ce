"""CSV output: every value as text, quoted only where it has to be."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableferry.functions.casts import TEMPORAL, epoch_micros, js_text
from tableferry.operators.mapping import positional
from tableferry.scratch import replace_path
from tableferry.sources.csv import clean_path

WRITE_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "sep": ",",
    "nullValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _object_text(c: Column, dt: T.DataType) -> Column:
    """Text form in CSV objects: true is 1, false is blank, an instant its milliseconds."""
    if isinstance(dt, T.BooleanType):
        return F.when(c, "1").otherwise("")
    if isinstance(dt, TEMPORAL):
        return F.floor(epoch_micros(c, dt) / 1000).cast("bigint").cast("string")
    return js_text(c, dt)


def as_text(df: DataFrame, style: str = "file") -> DataFrame:
    """All columns as CSV cell text; NULL becomes ''."""
    base, _ = positional(df)
    form = _object_text if style == "object" else js_text
    return base.select(
        *[
            F.coalesce(form(F.col(n), f.dataType), F.lit("")).alias(f.name)
            for n, f in zip(base.columns, df.schema.fields)
        ]
    )


def write_csv(df: DataFrame, path: str, *, style: str = "file", mode: str = "overwrite", swap: bool = False) -> None:
    """Write a folder of CSV parts, each with the header; an old one is replaced.

    ``swap`` writes beside ``path`` and replaces it at the end, for a frame that
    reads from the very place it is to replace.  With ``mode="append"`` parts are added,
    and the old ones stay.
    """
    path = clean_path(path)
    if not df.columns:
        df.sparkSession.createDataFrame([], "value string").write.mode(mode).text(path)
        return
    # a lone blank cell would be an empty line, which readers skip: quote it
    empty = '""' if len(df.columns) == 1 else ""
    swap = swap and mode != "append"
    target = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}" if swap else path
    text = as_text(df, style)
    text.write.mode(mode).options(**WRITE_OPTIONS, emptyValue=empty, header=True).csv(target)
    if swap:
        replace_path(df.sparkSession, target, path)
