"""Endpoint types that can be read, each giving a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tableferry import fixed
from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sources.csv import read_csv
from tableferry.sources.jdbc import is_database, read_table
from tableferry.sources.objects import OBJECT_TYPES, connect, read_object_csv


def as_flag(value) -> bool:
    return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes")


def line_breaks(ep: Endpoint) -> bool | str:
    """How cells with line breaks are read: by whole files, not at all, or over splits."""
    value = ep.get("multiline", True)
    return "split" if str(value).lower() == "split" else as_flag(value)


def read_endpoint(
    spark: SparkSession, endpoint, *, malformed_column: str | None = None
) -> DataFrame:
    """The table behind an endpoint, unread until an action asks for it.

    ``spark`` is the one type without a counterpart among the connectors: any
    format or table Spark knows (``format`` and ``path``, or ``table``).
    """
    ep = Endpoint.of(endpoint)
    multiline = line_breaks(ep)
    if ep.type == "csv":
        return read_csv(
            spark,
            ep.need("path"),
            multiline=multiline,
            headers=ep.get("headers", "each"),
            blanks=ep.get("blanks", "exact"),
            malformed_column=malformed_column,
        )
    if is_database(ep):
        return read_table(spark, ep)
    if ep.type in OBJECT_TYPES:
        return read_object_csv(spark, connect(spark, ep), multiline)
    if ep.type == "spark":
        if ep.get("table"):
            return spark.read.table(ep.get("table"))
        reader = spark.read.format(ep.get("format", "parquet")).options(**ep.get("options", {}))
        return reader.load(ep.need("path"))
    raise SpecError(fixed.UNSUPPORTED_SOURCE.format(ep.type))
