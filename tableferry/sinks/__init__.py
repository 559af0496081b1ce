"""Endpoint types that can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tableferry import fixed
from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sinks.csv import write_csv
from tableferry.sinks.jdbc import write_table
from tableferry.sources.jdbc import is_database
from tableferry.sources.objects import OBJECT_TYPES, connect, object_uri

FILE_TYPES = ("csv",)


def write_endpoint(
    df: DataFrame,
    endpoint,
    *,
    truncate: bool = False,
    batch_size: int | None = None,
    mode: str = "overwrite",
    swap: bool = False,
    **options,
) -> None:
    """Write a frame: files and objects are replaced, database tables appended to.

    ``mode="append"`` adds to files instead.  ``truncate`` empties a database
    table first.  ``swap`` says that the frame reads from the place it replaces.
    Further options (``create``, ``atomic``, ``batch``) go to the
    database writer.
    """
    ep = Endpoint.of(endpoint)
    if ep.type == "csv":
        write_csv(df, ep.need("path"), mode=mode, swap=swap)
    elif is_database(ep):
        write_table(df, ep, truncate=truncate, batch_size=batch_size, **options)
    elif ep.type in OBJECT_TYPES:
        uri = connect(df.sparkSession, ep)
        write_csv(df, uri, style="object", mode=mode, swap=swap)
    elif ep.type == "spark":
        if swap:
            raise SpecError("a table cannot be read and replaced by one copy")
        writer = df.write.mode("overwrite" if truncate else ep.get("mode", mode))
        writer = writer.format(ep.get("format", "parquet")).options(**ep.get("options", {}))
        if ep.get("table"):
            writer.saveAsTable(ep.get("table"))
        else:
            writer.save(ep.need("path"))
    else:
        raise SpecError(fixed.UNSUPPORTED_DESTINATION.format(ep.type))


def place(ep: Endpoint) -> str | None:
    """Where the files of an endpoint lie; None for tables."""
    if ep.type in OBJECT_TYPES:
        return object_uri(ep)
    return ep.get("path") if ep.type in (*FILE_TYPES, "spark") else None


def output_path(ep: Endpoint) -> str | None:
    """The path a run reports; only file destinations have one."""
    return ep.get("path") if ep.type in FILE_TYPES else None
