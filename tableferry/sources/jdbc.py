"""Database tables over JDBC: dialects, partitioned reads and catalog queries."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tableferry import fixed
from tableferry.functions.casts import NUMERIC
from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sources.splits import conditions

# One connection per task; a cluster must not open more than the database takes.
DEFAULT_CONNECTIONS = 16
FETCH_SIZE = 10_000


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + str(text).replace("'", "''") + "'"


@dataclass(frozen=True)
class Dialect:
    driver: str | None
    url: Callable[[Endpoint], str]
    table: Callable[[Endpoint], str]
    columns_sql: Callable[[Endpoint], str] | None = None
    quotes: tuple[str, str] = ('"', '"')
    # gets the staging table, the column list and the target
    create_like: str = "CREATE TABLE {new} AS SELECT {cols} FROM {old} WHERE 1 = 0"
    add_column: str = "ALTER TABLE {new} ADD {name} {type}"
    bigint: str = "BIGINT"
    # literals, and how keys are numbered, compared and sampled
    text_prefix: str = ""
    backslashes: bool = False  # a backslash in a text literal escapes
    timestamp: str = "TIMESTAMP '{}'"
    date: str = "DATE '{}'"
    binary: str = "X'{}'"
    remainder: str = "MOD({a}, {b})"
    numbered: str = "SELECT {cols}, ROW_NUMBER() OVER (ORDER BY {cols}) AS tf_rn FROM {table} WHERE {where}"
    row_values: bool = False
    sample: str | None = None
    # tables without a key: "pages", "rowids", "hash" or nothing
    chunks: str | None = None
    hashed: str = ""
    first_rows: str = "{sql} FETCH FIRST 1 ROWS ONLY"
    read_options: dict[str, str] = field(default_factory=dict)
    write_options: dict[str, str] = field(default_factory=dict)

    def quote(self, name: str) -> str:
        start, end = self.quotes
        return start + name.replace(end, end * 2) + end

    def qualified(self, *parts: str) -> str:
        return ".".join(self.quote(p) for p in parts)


def _port(ep: Endpoint) -> int:
    return int(ep.get("port", fixed.DEFAULT_PORT[ep.type]))


def _schema(ep: Endpoint) -> str:
    return ep.get("schema", fixed.DEFAULT_SCHEMA[ep.type])


# --- PostgreSQL --------------------------------------------------------------


def _pg_url(ep: Endpoint) -> str:
    # untyped parameters let the server read text into its own column types
    url = f"jdbc:postgresql://{ep.need('host')}:{_port(ep)}/{ep.need('database')}"
    url += "?stringtype=unspecified&reWriteBatchedInserts=true"
    return url + ("&sslmode=require" if _is_true(ep.get("ssl")) else "")


def _is_true(value) -> bool:
    return value is True or str(value).lower() == "true"


def _pg_columns(ep: Endpoint) -> str:
    return (
        "SELECT ordinal_position AS pos, column_name AS name, upper(data_type) AS type "
        "FROM information_schema.columns "
        f"WHERE table_schema = {literal(_schema(ep))} AND table_name = {literal(ep.need('table'))}"
    )


POSTGRES = Dialect(
    driver="org.postgresql.Driver",
    url=_pg_url,
    table=lambda ep: POSTGRES.qualified(_schema(ep), ep.need("table")),
    columns_sql=_pg_columns,
    binary="'\\x{}'::bytea",
    row_values=True,
    sample="{table} TABLESAMPLE SYSTEM ({percent})",
    chunks="pages",
)


# --- MySQL -------------------------------------------------------------------


def _my_url(ep: Endpoint) -> str:
    return (
        f"jdbc:mysql://{ep.need('host')}:{_port(ep)}/{ep.need('database')}"
        "?useCursorFetch=true&rewriteBatchedStatements=true"
    )


def _my_columns(ep: Endpoint) -> str:
    return (
        "SELECT ORDINAL_POSITION AS pos, COLUMN_NAME AS name, UPPER(DATA_TYPE) AS type "
        "FROM INFORMATION_SCHEMA.COLUMNS "
        f"WHERE TABLE_SCHEMA = {literal(ep.need('database'))} "
        f"AND TABLE_NAME = {literal(ep.need('table'))}"
    )


MYSQL = Dialect(
    driver="com.mysql.cj.jdbc.Driver",
    url=_my_url,
    table=lambda ep: MYSQL.qualified(ep.need("database"), ep.need("table")),
    columns_sql=_my_columns,
    quotes=("`", "`"),
    backslashes=True,
    sample="(SELECT * FROM {table} WHERE RAND() * 100 < {percent}) tf_s",
    chunks="hash",
    hashed="MOD(CRC32(CONCAT_WS('|', {columns})), {parts}) = {part}",
    first_rows="{sql} LIMIT 1",
)


# --- SQL Server --------------------------------------------------------------


def _ms_url(ep: Endpoint) -> str:
    return (
        f"jdbc:sqlserver://{ep.need('host')}:{_port(ep)};databaseName={ep.need('database')};"
        "encrypt=false;trustServerCertificate=true"
    )


def _ms_object(ep: Endpoint) -> str:
    return f"OBJECT_ID({literal(MSSQL.table(ep))})"


def _ms_columns(ep: Endpoint) -> str:
    return (
        "SELECT c.column_id AS pos, c.name AS name, UPPER(TYPE_NAME(c.user_type_id)) AS type "
        f"FROM sys.columns AS c WHERE c.object_id = {_ms_object(ep)}"
    )


def identity_sql(ep: Endpoint) -> str:
    """Finds the identity column of a SQL Server table."""
    return f"SELECT name FROM sys.identity_columns WHERE object_id = {_ms_object(ep)}"


MSSQL = Dialect(
    driver="com.microsoft.sqlserver.jdbc.SQLServerDriver",
    url=_ms_url,
    table=lambda ep: MSSQL.qualified(_schema(ep), ep.need("table")),
    columns_sql=_ms_columns,
    quotes=("[", "]"),
    # the union keeps the identity property from being copied to the new table
    create_like=(
        "SELECT {cols} INTO {new} FROM {old} WHERE 1 = 0 "
        "UNION ALL SELECT {cols} FROM {old} WHERE 1 = 0"
    ),
    text_prefix="N",
    timestamp="CAST('{}' AS datetime2)",
    date="CAST('{}' AS date)",
    binary="0x{}",
    remainder="({a}) % {b}",
    sample="{table} TABLESAMPLE ({percent} PERCENT)",
    chunks="hash",
    hashed="ABS(CAST(BINARY_CHECKSUM(*) AS BIGINT)) % {parts} = {part}",
    first_rows="{sql} OFFSET 0 ROWS FETCH NEXT 1 ROWS ONLY",
)


# --- Oracle ------------------------------------------------------------------


def _ora_url(ep: Endpoint) -> str:
    return f"jdbc:oracle:thin:@//{ep.need('host')}:{_port(ep)}/{ep.need('service')}"


def oracle_owner(ep: Endpoint) -> tuple[str, str]:
    """Owner and table for the catalog: OWNER.TABLE, else the schema, else the user."""
    name = ep.need("table").strip()
    if "." in name:
        owner, name = name.split(".")[:2]
    else:
        owner = ep.get("schema") or ep.need("user")
    return owner.upper(), name.upper()


def _ora_columns(ep: Endpoint) -> str:
    owner, table = oracle_owner(ep)
    return (
        'SELECT COLUMN_ID AS "pos", COLUMN_NAME AS "name", DATA_TYPE AS "type" '
        f"FROM ALL_TAB_COLUMNS WHERE OWNER = {literal(owner)} AND TABLE_NAME = {literal(table)}"
    )


ORACLE = Dialect(
    driver="oracle.jdbc.OracleDriver",
    url=_ora_url,
    table=lambda ep: ep.need("table"),
    columns_sql=_ora_columns,
    bigint="NUMBER(19)",
    binary="HEXTORAW('{}')",
    sample="{table} SAMPLE ({percent})",
    chunks="rowids",
)


# --- any other database ------------------------------------------------------


def _any_table(ep: Endpoint) -> str:
    return ep.need("table")


def _derby_columns(ep: Endpoint) -> str:
    name = ep.need("table").strip('"')
    return (
        "SELECT c.COLUMNNUMBER AS pos, c.COLUMNNAME AS name, "
        "CAST(c.COLUMNDATATYPE AS VARCHAR(100)) AS type "
        "FROM SYS.SYSCOLUMNS c JOIN SYS.SYSTABLES t ON c.REFERENCEID = t.TABLEID "
        f"WHERE t.TABLENAME = {literal(name)}"
    )


OTHER = Dialect(driver=None, url=lambda ep: ep.need("url"), table=_any_table)
DERBY = Dialect(
    driver="org.apache.derby.iapi.jdbc.AutoloadedDriver",
    url=lambda ep: ep.need("url"),
    table=_any_table,
    columns_sql=_derby_columns,
    create_like="CREATE TABLE {new} AS SELECT {cols} FROM {old} WITH NO DATA",
    timestamp="TIMESTAMP('{}')",
    date="DATE('{}')",
    # its row numbers have no order of their own: the rows are put in order first
    numbered=(
        "SELECT {cols}, ROW_NUMBER() OVER () AS tf_rn FROM "
        "(SELECT {cols} FROM {table} WHERE {where} ORDER BY {cols}) tf_o"
    ),
)

DIALECTS = {"postgres": POSTGRES, "mysql": MYSQL, "mssql": MSSQL, "oracle": ORACLE}


def dialect_of(ep: Endpoint) -> Dialect:
    if ep.type == "jdbc":
        return DERBY if str(ep.get("url", "")).startswith("jdbc:derby:") else OTHER
    return DIALECTS[ep.type]


def is_database(ep: Endpoint) -> bool:
    return ep.type == "jdbc" or ep.type in DIALECTS


def connection_options(ep: Endpoint) -> dict[str, str]:
    d = dialect_of(ep)
    options = {"url": d.url(ep)}
    driver = ep.get("driver", d.driver)
    if driver:
        options["driver"] = driver
    for key in ("user", "password"):
        if ep.get(key) is not None:
            options[key] = str(ep.get(key))
    return options


# --- driver-side statements --------------------------------------------------


@contextmanager
def connection(spark: SparkSession, ep: Endpoint):
    """One JDBC connection of the driver, for statements that move no rows through it."""
    jvm, options = spark._jvm, connection_options(ep)
    props = jvm.java.util.Properties()
    for key in ("user", "password"):
        if key in options:
            props.setProperty(key, options[key])
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(
            options["driver"]
        )
    conn = jvm.java.sql.DriverManager.getConnection(options["url"], props)
    try:
        yield conn
    finally:
        conn.close()


def execute(conn, sql: str) -> int:
    """Run one statement; gives the number of rows it changed."""
    statement = conn.createStatement()
    try:
        statement.execute(sql)
        return statement.getUpdateCount()
    finally:
        statement.close()


def fetch_row(conn, sql: str, columns: int = 1):
    """First row of a small query as a tuple of texts, or None."""
    statement = conn.createStatement()
    try:
        rows = statement.executeQuery(sql)
        return tuple(rows.getString(i + 1) for i in range(columns)) if rows.next() else None
    finally:
        statement.close()


#: SQL states, and Oracle's error number, that say that there is no such table.
_NO_TABLE, _NO_TABLE_ORACLE = {"42P01", "42S02", "S0002", "42X05"}, 942


def _is_absent(e: Exception) -> bool:
    cause = getattr(e, "java_exception", None)
    while cause is not None:
        if "getSQLState" in dir(cause):
            return cause.getSQLState() in _NO_TABLE or cause.getErrorCode() == _NO_TABLE_ORACLE
        cause = cause.getCause()
    return False


def answers(conn, table: str) -> bool:
    """Whether the table is there; any other failure, of rights or connections, is an error."""
    try:
        fetch_row(conn, f"SELECT 1 FROM {table} WHERE 1 = 0")
        return True
    except Exception as e:
        if _is_absent(e):
            return False
        raise


def table_exists(spark: SparkSession, ep: Endpoint) -> bool:
    with connection(spark, ep) as conn:
        return answers(conn, dialect_of(ep).table(ep))


# --- reading -----------------------------------------------------------------

_WIDTH_TYPES = NUMERIC + (T.DateType, T.TimestampType, T.TimestampNTZType)


def _equal_widths(ep: Endpoint, plain: DataFrame, parts: int) -> dict[str, str]:
    """Spark's own split into ranges of equal width between given bounds."""
    column = str(ep.get("partitionColumn"))
    found = {f.name.lower(): f for f in plain.schema.fields}.get(column.lower())
    if found is None or not isinstance(found.dataType, _WIDTH_TYPES):
        raise SpecError(f"cannot split the read by column '{column}'")
    return {
        "partitionColumn": found.name,
        "lowerBound": str(ep.get("lowerBound")),
        "upperBound": str(ep.get("upperBound")),
        "numPartitions": str(parts),
    }


def read_table(spark: SparkSession, ep: Endpoint, where: str | None = None) -> DataFrame:
    """The whole table, or its rows with ``where``, in ``numPartitions`` parts of equally many rows.

    The parts are ranges of ``partitionColumn`` (one column or several, of any type that
    has an order; ties are broken by the table's own key), else of the primary key or a
    unique index. A table without any is cut by the places or hashes of its rows where
    the database has them (not in views), and else read by one task. ``lowerBound`` and
    ``upperBound`` ask for ranges of equal width instead, without a look at the table.
    The parts are read by statements of their own: rows that are changed meanwhile are
    seen or not.
    """
    d = dialect_of(ep)
    options = {
        **connection_options(ep),
        **d.read_options,
        "fetchsize": str(ep.get("fetchsize", FETCH_SIZE)),
    }
    reader = spark.read.format("jdbc")
    plain = reader.options(**options, dbtable=d.table(ep)).load()
    parts = int(ep.get("numPartitions", DEFAULT_CONNECTIONS))
    if where is None and parts > 1 and ep.get("lowerBound") is not None and ep.get("upperBound") is not None:
        split = _equal_widths(ep, plain, parts)
        return spark.read.format("jdbc").options(**options, dbtable=d.table(ep), **split).load()
    found = conditions(spark, ep, plain.schema, parts, where) if parts > 1 else [where or "1 = 1"]
    if len(found) <= 1 and where is None:
        return plain
    url = options.pop("url")
    return spark.read.jdbc(url, d.table(ep), predicates=found or [where], properties=options)


def read_columns(spark: SparkSession, ep: Endpoint) -> DataFrame:
    """(pos, name, type) rows from the database's catalog, in column order."""
    d = dialect_of(ep)
    if d.columns_sql is None:
        from tableferry.operators.infer import labels_of

        return labels_of(read_table(spark, ep))
    rows = (
        spark.read.format("jdbc").options(**connection_options(ep), query=d.columns_sql(ep)).load()
    )
    pos, name, kind = rows.columns
    return rows.select(
        (F.col(pos).cast("int") - 1).alias("pos"),
        F.col(name).cast("string").alias("name"),
        F.col(kind).cast("string").alias("type"),
    ).orderBy("pos")
