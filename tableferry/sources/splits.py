"""How one table is read over many connections: conditions that take every row exactly once.

With a key (given, or the primary key, or a unique index) the database names every n-th
key in its own order, so that parts hold equally many rows, whatever the key's type, its
gaps or the number of its columns. Without one the table is cut physically, by the
places or the hashes of its rows, where the database has such a thing.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession, types as T

from tableferry.plans.spec import Endpoint, SpecError

if TYPE_CHECKING:
    from tableferry.sources.jdbc import Dialect

#: Types that every database orders.
ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.BinaryType)


def literal_of(d: Dialect, value) -> str:
    """A value that the database gave, as its own literal."""
    if isinstance(value, bool):
        raise SpecError("a truth value is no key")
    if isinstance(value, int | Decimal):
        return f"{value:f}" if isinstance(value, Decimal) else str(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, datetime):
        return d.timestamp.format(value.replace(tzinfo=None).isoformat(" ", "microseconds"))
    if isinstance(value, date):
        return d.date.format(value.isoformat())
    if isinstance(value, bytes | bytearray):
        return d.binary.format(bytes(value).hex())
    return d.text_prefix + "'" + str(value).replace("\\", "\\\\" if d.backslashes else "\\").replace("'", "''") + "'"


def at_least(d: Dialect, columns: list[str], values: list[str]) -> str:
    """Rows whose key is not below ``values``; quoted columns, none but the first with NULLs.

    A comparison of rows where the database has one; else column by column, led by a plain
    condition on the first, which an index can serve.
    """
    if len(columns) == 1:
        return f"{columns[0]} >= {values[0]}"
    if d.row_values:
        return f"({', '.join(columns)}) >= ({', '.join(values)})"
    rest = at_least(d, columns[1:], values[1:])
    return f"{columns[0]} >= {values[0]} AND ({columns[0]} > {values[0]} OR ({rest}))"


def below(d: Dialect, columns: list[str], values: list[str]) -> str:
    """Rows whose key is below ``values``: exactly those that are not ``at_least``, and have no NULL."""
    if len(columns) == 1:
        return f"{columns[0]} < {values[0]}"
    if d.row_values:
        return f"({', '.join(columns)}) < ({', '.join(values)})"
    rest = below(d, columns[1:], values[1:])
    return f"{columns[0]} <= {values[0]} AND ({columns[0]} < {values[0]} OR ({rest}))"


def between(d: Dialect, columns: list[str], bounds: list[tuple], nullable: bool, where: str | None = None) -> list[str]:
    """Conditions of the parts that ``bounds``, in the database's order, cut a table into.

    ``nullable``: a part of its own for NULLs in the first column. ``where`` holds in all parts.
    """
    texts = [[literal_of(d, v) for v in bound] for bound in bounds]
    starts, ends = [None, *texts], [*texts, None]
    out = []
    for low, high in zip(starts, ends, strict=True):
        both = [at_least(d, columns, low)] if low else []
        both += [below(d, columns, high)] if high else []
        if not both and nullable:
            both = [f"{columns[0]} IS NOT NULL"]
        out.append(" AND ".join(f"({c})" for c in both) if both else "1 = 1")
    if nullable:
        out.append(f"{columns[0]} IS NULL")
    return [f"({where}) AND {c}" for c in out] if where else out


def bounds_sql(d: Dialect, table: str, columns: list[str], step: int, where: str) -> str:
    """Every ``step``-th key of a table, and its number."""
    cols = ", ".join(columns)
    numbered = d.numbered.format(cols=cols, table=table, where=where)
    place = d.remainder.format(a="tf_rn - 1", b=step)
    return f"SELECT {cols}, tf_rn FROM ({numbered}) tf_q WHERE tf_rn > 1 AND {place} = 0"


def bounds(
    spark: SparkSession, ep: Endpoint, columns: list[str], parts: int, nullable: bool, where: str | None = None, step: int | None = None
) -> list[tuple]:
    """At most ``parts - 1`` keys that cut the table, or its rows with ``where``, into equally many rows.

    The database counts the rows and numbers them by key: two passes over an index, or
    over ``splitSample`` percent of the table where that is given. ``step`` asks for parts
    of so many rows instead.
    """
    from tableferry.sources.jdbc import connection_options, dialect_of

    d = dialect_of(ep)
    table = d.table(ep)
    sample = ep.get("splitSample")
    if sample is not None:
        if not d.sample:
            raise SpecError("this database samples no tables: leave out 'splitSample'")
        table = d.sample.format(table=table, percent=float(sample))
    known = [c for c in ([f"{columns[0]} IS NOT NULL"] if nullable else []) + ([f"({where})"] if where else [])]
    condition = " AND ".join(known) or "1 = 1"
    reader = lambda sql: spark.read.format("jdbc").options(**connection_options(ep), query=sql).load()
    rows = int(reader(f"SELECT COUNT(*) AS n FROM {table} WHERE {condition}").first()[0])
    step = step or -(-rows // parts)
    if rows <= step:
        return []
    found = sorted(reader(bounds_sql(d, table, columns, step, condition)).collect(), key=lambda r: r[-1])
    keys = [tuple(r)[:-1] for r in found]  # at most ``parts``, or rows / step
    return [k for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]


# --- what the database knows about a table -----------------------------------


def _names(spark: SparkSession, ep: Endpoint) -> tuple[str | None, str | None, str]:
    """Catalog, schema and table as the driver's metadata wants them."""
    from tableferry import fixed
    from tableferry.sources.jdbc import oracle_owner

    schema, table = ep.get("schema"), ep.need("table")
    if ep.type == "oracle":
        schema, table = oracle_owner(ep)
    elif ep.type in fixed.DEFAULT_SCHEMA:
        schema = ep.get("schema", fixed.DEFAULT_SCHEMA[ep.type])
    elif ep.type == "jdbc" and "." in table:
        schema, _, table = table.rpartition(".")
        schema = schema.strip('"')
    return (ep.get("database") if ep.type == "mysql" else None), schema, table.strip('"')


def _rows(result, *columns: str) -> list[tuple]:
    out = []
    while result.next():
        out.append(tuple(result.getString(c) for c in columns))
    return out


def table_key(conn, spark: SparkSession, ep: Endpoint) -> list[str]:
    """Columns of the primary key in its order, else of the narrowest unique index without NULLs, else none."""
    catalog, schema, table = _names(spark, ep)
    meta = conn.getMetaData()
    found = _rows(meta.getPrimaryKeys(catalog, schema, table), "KEY_SEQ", "COLUMN_NAME")
    if found:
        return [name for _, name in sorted(found, key=lambda r: int(r[0]))]
    indexes: dict[str, list[tuple[int, str]]] = {}
    try:
        listed = _rows(meta.getIndexInfo(catalog, schema, table, True, True), "INDEX_NAME", "ORDINAL_POSITION", "COLUMN_NAME")
    except Exception:  # a driver without this list
        return []
    for index, place, name in listed:
        if index and name:
            indexes.setdefault(index, []).append((int(place), name))
    may_be_null = nullable_columns(conn, spark, ep)
    whole = [[n for _, n in sorted(c)] for c in indexes.values()]
    return min((c for c in whole if not may_be_null & set(c)), key=lambda c: (len(c), c), default=[])


def nullable_columns(conn, spark: SparkSession, ep: Endpoint) -> set[str]:
    catalog, schema, table = _names(spark, ep)
    rows = _rows(conn.getMetaData().getColumns(catalog, schema, table, None), "COLUMN_NAME", "IS_NULLABLE")
    return {name for name, state in rows if state != "NO"}


def key_of(spark: SparkSession, ep: Endpoint, wanted: list[str], schema: T.StructType) -> tuple[list[str], bool]:
    """The columns that order a table, and whether the first holds NULLs.

    ``wanted`` columns come first and the table's own key breaks their ties; columns that
    may be NULL can stand at the first place only.
    """
    from tableferry.sources.jdbc import connection

    fields = {f.name.lower(): f for f in schema.fields}
    with connection(spark, ep) as conn:
        own = table_key(conn, spark, ep)
        may_be_null = {c.lower() for c in nullable_columns(conn, spark, ep)}
    key, first = [], len(wanted) or len(own)
    for i, name in enumerate([*wanted, *(k for k in own if k.lower() not in {w.lower() for w in wanted})]):
        field = fields.get(name.lower())
        if field is None or not isinstance(field.dataType, ORDERED) or (i > 0 and name.lower() in may_be_null):
            if i < len(wanted):
                raise SpecError(f"cannot split the read by column '{name}'")
            if i < first:
                return [], False
            break  # ties of the wanted columns stay together
        key.append(field.name)
    return key, bool(key) and key[0].lower() in may_be_null


# --- tables without a key ----------------------------------------------------


def is_table(conn, spark: SparkSession, ep: Endpoint) -> bool:
    """Not a view, whose rows have no places."""
    catalog, schema, table = _names(spark, ep)
    kinds = [k for (k,) in _rows(conn.getMetaData().getTables(catalog, schema, table, None), "TABLE_TYPE")]
    return bool(kinds) and all("VIEW" not in k.upper() for k in kinds)


def page_ranges(pages: int, parts: int) -> list[str]:
    """PostgreSQL: ranges of pages by ``ctid``; the last one is open, for pages that come later."""
    cuts = [pages * i // parts for i in range(1, parts)]
    cuts = sorted({c for c in cuts if c > 0})
    at = [f"'({c},0)'::tid" for c in cuts]
    return [
        " AND ".join([f"ctid >= {low}"] * bool(low) + [f"ctid < {high}"] * bool(high)) or "1 = 1"
        for low, high in zip([None, *at], [*at, None], strict=True)
    ]


def pages_sql(table: str) -> str:
    text = table.replace("'", "''")
    return f"SELECT pg_relation_size('{text}'::regclass) / current_setting('block_size')::bigint AS pages"


def rowid_sql(table: str, parts: int) -> str:
    """Oracle: first row id of each of ``parts`` equal pieces."""
    tiles = f"SELECT ROWID AS tf_r, NTILE({parts}) OVER (ORDER BY ROWID) AS tf_t FROM {table}"
    return f"SELECT ROWIDTOCHAR(MIN(tf_r)) AS low, tf_t FROM ({tiles}) tf_q GROUP BY tf_t"


def rowid_ranges(lows: list[str]) -> list[str]:
    at = [f"CHARTOROWID('{low}')" for low in lows[1:]]
    return [
        " AND ".join([f"ROWID >= {low}"] * bool(low) + [f"ROWID < {high}"] * bool(high)) or "1 = 1"
        for low, high in zip([None, *at], [*at, None], strict=True)
    ]


def hash_buckets(template: str, columns: list[str], parts: int) -> list[str]:
    """Rows by a hash of all their columns, which every database computes alike for one row."""
    return [template.format(columns=", ".join(columns), parts=parts, part=i) for i in range(parts)]


def physical_parts(spark: SparkSession, ep: Endpoint, columns: list[str], parts: int) -> list[str]:
    """Conditions for a table without a key; none where the database offers nothing."""
    from tableferry.sources.jdbc import connection, connection_options, dialect_of

    d = dialect_of(ep)
    if d.chunks is None:
        return []
    with connection(spark, ep) as conn:
        if not is_table(conn, spark, ep):
            return []
    if d.chunks == "hash":
        return hash_buckets(d.hashed, [d.quote(c) for c in columns], parts)
    sql = pages_sql(d.table(ep)) if d.chunks == "pages" else rowid_sql(d.table(ep), parts)
    rows = spark.read.format("jdbc").options(**connection_options(ep), query=sql).load().collect()  # ``parts`` rows
    if d.chunks == "pages":
        return page_ranges(int(rows[0][0]), parts)
    return rowid_ranges([r[0] for r in sorted(rows, key=lambda r: r[1])])


def conditions(spark: SparkSession, ep: Endpoint, schema: T.StructType, parts: int, where: str | None = None) -> list[str]:
    """Conditions that split the table, or its rows with ``where``, into about ``parts`` parts; one or none for a single task."""
    from tableferry.sources.jdbc import dialect_of

    d = dialect_of(ep)
    wanted = ep.get("partitionColumn") or []
    if isinstance(wanted, str):
        wanted = [w.strip() for w in wanted.split(",")]
    key, nullable = key_of(spark, ep, wanted, schema)
    if not key:
        found = physical_parts(spark, ep, schema.names, parts)
        return [f"({where}) AND {c}" for c in found] if where else found
    columns = [d.quote(c) for c in key]
    return between(d, columns, bounds(spark, ep, columns, parts, nullable, where), nullable, where)
