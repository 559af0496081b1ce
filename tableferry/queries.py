"""Registered queries: each runs library operators over whole tables.

``@query(sql)`` keeps a query beside the SQL that says what it has to give.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tableferry.functions.casts import EPOCH
from tableferry.functions.redact import redact
from tableferry.operators.audit import audit_specs, export_specs
from tableferry.operators.infer import all_string, infer_all_rows, infer_first_row
from tableferry.operators.ledger import infer_incremental
from tableferry.operators.mapping import apply_mapping, auto_map
from tableferry.plans.migrate import discover, migrate
from tableferry.plans.runs import run_events, run_history, run_summaries
from tableferry.plans.workflow import run_workflow
from tableferry.scratch import scratch_path
from tableferry.sinks import write_endpoint
from tableferry.sinks.csv import write_csv
from tableferry.sources import read_endpoint
from tableferry.sources.csv import read_csv
from tableferry.sources.jdbc import connection, execute
from tableferry.sources.objects import read_object_csv
from tableferry.plans.spec import Endpoint
from tableferry.streaming.incremental import incremental_copy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    """Register a query under ``name``, or else under the name of its function."""

    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet(sf_dir: str, name: str) -> dict:
    return {"dbType": "spark", "config": {"path": f"{sf_dir}/{name}.parquet"}}


def done(result) -> None:
    """A copy that fails inside a query must fail the query."""
    if not result.ok:
        raise RuntimeError(result.message)


ISO_SQL = "strftime({}, '%Y-%m-%dT%H:%M:%S.%gZ')"
TEXT_SQL = r"regexp_replace(CAST({} AS VARCHAR), '\.0$', '')"


def iso_sql(column: str) -> str:
    return ISO_SQL.format(column)


def text_sql(column: str) -> str:
    return TEXT_SQL.format(column)


# --- copies ------------------------------------------------------------------

ORDERS_MAPPING = [
    {"from": "o_orderkey", "to": "id", "cast": "NUMBER"},
    {"from": "o_orderdate", "to": "day", "cast": "DATE"},
    {"from": "o_orderstatus", "to": "final", "cast": "BOOLEAN"},
    {"from": "o_totalprice", "to": "total", "cast": "STRING"},
]


@query(f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS id, {iso_sql('o_orderdate')} AS day,
           CASE WHEN o_orderstatus = 'F' THEN 'false' ELSE '' END AS final,
           {text_sql('o_totalprice')} AS total
    FROM orders""")
def migrate_orders(spark, sf_dir):
    """Parquet to CSV with one cast of each tag, then read back."""
    out = scratch_path(spark, "orders")
    target = {"dbType": "csv", "config": {"path": out}}
    spec = {"source": parquet(sf_dir, "orders"), "destination": target, "mapping": ORDERS_MAPPING}
    done(migrate(spark, spec))
    return read_csv(spark, out)


@query("SELECT * FROM customer")
def copy_identity(spark, sf_dir):
    return apply_mapping(table(spark, sf_dir, "customer"), [])


@query("SELECT o_orderpriority AS prio, o_orderkey AS id, o_totalprice AS total FROM orders")
def map_project_rename(spark, sf_dir):
    mapping = [("o_orderpriority", "prio"), ("o_orderkey", "id"), ("o_totalprice", "total")]
    return apply_mapping(table(spark, sf_dir, "orders"), mapping)


@query("""
    SELECT c_custkey AS id, CAST(NULL AS VARCHAR) AS absent, CAST(NULL AS DOUBLE) AS absent_number,
           CAST(NULL AS BOOLEAN) AS absent_flag
    FROM customer""")
def map_missing_source(spark, sf_dir):
    mapping = [
        ("c_custkey", "id"),
        ("C_NAME", "absent"),
        ("C_ACCTBAL", "absent_number", "NUMBER"),
        ("no.such", "absent_flag", "BOOLEAN"),
    ]
    return apply_mapping(table(spark, sf_dir, "customer"), mapping)


@query("SELECT l_linestatus AS x, l_orderkey AS y, l_linenumber AS z FROM lineitem")
def map_duplicate_target(spark, sf_dir):
    mapping = [
        ("l_returnflag", "x"),
        ("l_orderkey", "y"),
        ("l_linestatus", "x"),
        ("l_linenumber", "z"),
    ]
    return apply_mapping(table(spark, sf_dir, "lineitem"), mapping)


@query(f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS "O_ORDERKEY", CAST(o_custkey AS VARCHAR) AS o_custkey,
           o_orderstatus AS o_orderstatus, {text_sql('o_totalprice')} AS "O_TotalPrice",
           {iso_sql('o_orderdate')} AS o_orderdate, o_orderpriority AS o_orderpriority
    FROM orders""")
def automap_by_name(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return apply_mapping(orders, auto_map(orders.columns, ["O_ORDERKEY", "O_TotalPrice", "other"]))


# --- strict casts ------------------------------------------------------------


@query(f"""
    SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR) AS key_text,
           {text_sql('o_totalprice')} AS total, {iso_sql('o_orderdate')} AS day,
           CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS large
    FROM orders""")
def cast_string(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("large", F.col("o_totalprice") > 100000)
    mapping = [
        ("o_orderkey", "id"),
        ("o_orderkey", "key_text", "STRING"),
        ("o_totalprice", "total", "STRING"),
        ("o_orderdate", "day", "STRING"),
        ("large", "large", "STRING"),
    ]
    return apply_mapping(orders, mapping)


@query(r"""
    WITH v AS (
      SELECT l_orderkey AS id, l_linenumber AS line,
             CAST(l_extendedprice * 1e18 AS VARCHAR) AS huge,
             CAST(l_extendedprice / 1e13 AS VARCHAR) AS tiny,
             CAST(l_extendedprice * 1e13 AS VARCHAR) AS large,
             l_extendedprice * 1e13 AS large_value
      FROM lineitem)
    SELECT id, line,
           CASE WHEN CAST(split_part(huge, 'e+', 2) AS INTEGER) < 21
                THEN rpad(replace(split_part(huge, 'e+', 1), '.', ''),
                          CAST(split_part(huge, 'e+', 2) AS INTEGER) + 1, '0')
                ELSE huge END AS huge,
           regexp_replace(tiny, 'e-0', 'e-') AS tiny,
           CASE WHEN contains(large, 'e')
                THEN rpad(replace(split_part(large, 'e+', 1), '.', ''),
                          CAST(split_part(large, 'e+', 2) AS INTEGER) + 1, '0')
                ELSE CAST(CAST(large_value AS BIGINT) AS VARCHAR) END AS large
    FROM v""")
def cast_string_exponents(spark, sf_dir):
    price = F.col("l_extendedprice")
    values = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        (price * 1e18).alias("huge"),
        (price / 1e13).alias("tiny"),
        (price * 1e13).alias("large"),
    )
    mapping = [("id", "id"), ("line", "line")]
    mapping += [(c, c, "STRING") for c in ("huge", "tiny", "large")]
    return apply_mapping(values, mapping)


def number_texts(spark, sf_dir) -> DataFrame:
    """Text spellings of l_partkey, good and bad ones, chosen by l_linenumber."""
    part = F.col("l_partkey").cast("string")
    line = F.col("l_linenumber")
    raw = (
        F.when(F.col("l_quantity") < 5, F.lit("  "))
        .when(line == 1, part)
        .when(line == 2, F.concat(F.lit("  "), part, F.lit("\t ")))
        .when(line == 3, F.concat(F.lit("0x"), F.hex("l_partkey")))
        .when(line == 4, F.concat(part, F.lit("e3")))
        .when(line == 5, F.concat(part, F.lit(",000")))
        .when(line == 6, F.concat(F.lit("-."), part))
        .otherwise(F.concat(part, F.lit("d")))
    )
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), line.alias("line"), raw.alias("raw")
    )


NUMBER_CASES = """
    CASE WHEN l_quantity < 5 THEN {blank}
         WHEN l_linenumber IN (1, 2, 3) THEN CAST(l_partkey AS DOUBLE)
         WHEN l_linenumber = 4 THEN l_partkey * 1000.0::DOUBLE
         WHEN l_linenumber = 6 THEN CAST('-0.' || l_partkey AS DOUBLE) END"""


@query(f"""
    SELECT l_orderkey AS id, l_linenumber AS line, {NUMBER_CASES.format(blank='0.0')} AS n,
           {NUMBER_CASES.format(blank='NULL')} AS n_or_null
    FROM lineitem""")
def cast_number_corpus(spark, sf_dir):
    raw = number_texts(spark, sf_dir)
    zero = apply_mapping(
        raw, [("id", "id"), ("line", "line"), ("raw", "raw"), ("raw", "n", "NUMBER")]
    )
    mapping = [("id", "id"), ("line", "line"), ("n", "n"), ("raw", "n_or_null", "NUMBER")]
    return apply_mapping(zero, mapping, blank_as_null=True)


@query("""
    SELECT l_orderkey AS id, l_linenumber AS line,
           CASE WHEN l_returnflag = 'N' THEN false END AS returned,
           CASE WHEN l_linestatus = 'F' THEN false END AS open,
           l_discount <> 0 AS discounted,
           CASE WHEN l_linenumber = 1 THEN true WHEN l_linenumber = 2 THEN false
                WHEN l_linenumber = 3 THEN true WHEN l_linenumber = 4 THEN false END AS word
    FROM lineitem""")
def cast_boolean(spark, sf_dir):
    line = F.col("l_linenumber")
    word = (
        F.when(line == 1, " Yes ").when(line == 2, "\tNO\n").when(line == 3, "1")
        .when(line == 4, "FALSE").when(line == 5, "on").otherwise("")
    )
    items = table(spark, sf_dir, "lineitem").withColumn("word", word)
    mapping = [
        ("l_orderkey", "id"),
        ("l_linenumber", "line"),
        ("l_returnflag", "returned", "BOOLEAN"),
        ("l_linestatus", "open", "BOOLEAN"),
        ("l_discount", "discounted", "BOOLEAN"),
        ("word", "word", "BOOLEAN"),
    ]
    return apply_mapping(items, mapping)


#: Spellings of a day, and of a second in UTC.
DAY_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "d MMM yyyy", "yyyy-M-d", "MMM d, yyyy", "EEE, dd MMM yyyy", "M/d/yyyy",
)
INSTANT_FORMATS = (
    "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "MM/dd/yyyy HH:mm:ss",
    "EEE MMM dd yyyy HH:mm:ss 'GMT+0000 (Coordinated Universal Time)'", "yyyy/M/d H:mm:ss", "MMMM d, yyyy HH:mm:ss",
    "d MMM yyyy HH:mm:ss 'UTC'", "yyyy-M-d HH:mm:ss", "MMM d yyyy HH:mm:ss",
)


def date_texts(spark, sf_dir) -> DataFrame:
    """Spellings of o_orderdate, chosen by priority; one of them is no date."""
    day, prio = F.col("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    spelling = (F.col("o_orderkey") % 8).cast("int")
    raw = (
        F.when(prio == "1", F.get(F.array(*[F.date_format(day, f) for f in DAY_FORMATS]), spelling))
        .when(prio == "2", F.date_format(day, "MM/dd/yyyy"))
        .when(prio == "3", F.get(F.array(*[F.date_format(day, f) for f in INSTANT_FORMATS]), spelling))
        .when(prio == "4", F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
        .otherwise(F.date_format(day, "HH:mm"))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        raw.alias("raw"),
        day.alias("day"),
        (F.col("o_custkey") * 1000).alias("millis"),
    )


DATE_CASES = """
    CASE substr(o_orderpriority, 1, 1)
         WHEN '1' THEN date_trunc('day', o_orderdate)
         WHEN '2' THEN date_trunc('day', o_orderdate)
         WHEN '3' THEN date_trunc('second', o_orderdate)
         WHEN '4' THEN date_trunc('second', o_orderdate) - INTERVAL 330 MINUTE END"""


@query(f"""
    SELECT o_orderkey AS id, CAST({DATE_CASES} AS TIMESTAMP) AS parsed,
           CAST(o_orderdate AS TIMESTAMP) AS day, make_timestamp(o_custkey * 1000000) AS epoch
    FROM orders""")
def cast_date(spark, sf_dir):
    mapping = [
        ("id", "id"),
        ("raw", "parsed", "DATE"),
        ("day", "day", "DATE"),
        ("millis", "epoch", "DATE"),
    ]
    return local_times(apply_mapping(date_texts(spark, sf_dir), mapping), "parsed", "day", "epoch")


def local_times(df: DataFrame, *names: str) -> DataFrame:
    """Instants as UTC wall-clock time, the type the tables themselves use."""
    epoch = F.expr(EPOCH)
    return df.withColumns({n: F.timestamp_add("MICROSECOND", F.unix_micros(n), epoch) for n in names})


# --- lenient casts -----------------------------------------------------------


@query(r"""
    SELECT o_orderkey AS id,
           CAST(regexp_extract(o_orderpriority, '^\s*([+-]?[0-9]+)', 1) AS BIGINT) AS prio,
           CAST(floor(o_totalprice) AS BIGINT) AS total, CAST(NULL AS BIGINT) AS status
    FROM orders""")
def cast_lenient_int(spark, sf_dir):
    mapping = [
        ("o_orderkey", "id"),
        ("o_orderpriority", "prio", "INTEGER"),
        ("o_totalprice", "total", "bigint"),
        ("o_orderstatus", "status", "point"),
    ]
    return apply_mapping(table(spark, sf_dir, "orders"), mapping, "lenient")


@query(f"""
    WITH v AS (SELECT l_orderkey AS id, l_linenumber AS line,
                      {NUMBER_CASES.format(blank='0.0')} AS n FROM lineitem)
    SELECT id, line, n, n IS NULL AS not_a_number FROM v""")
def cast_lenient_number(spark, sf_dir):
    mapping = [("id", "id"), ("line", "line"), ("raw", "n", "Decimal(10,2)")]
    out = apply_mapping(number_texts(spark, sf_dir), mapping, "lenient")
    return out.withColumns({"n": F.nanvl("n", F.lit(None)), "not_a_number": F.isnan("n")})


@query("""
    SELECT l_orderkey AS id, l_linenumber AS line, l_linenumber IN (1, 3) AS word,
           l_linenumber = 1 AS one, l_quantity < 25 AS small
    FROM lineitem""")
def cast_lenient_bool(spark, sf_dir):
    line = F.col("l_linenumber")
    word = F.when(line == 1, "TRUE").when(line == 2, "yes").when(line == 3, " 1.0 ").otherwise("0")
    items = table(spark, sf_dir, "lineitem").withColumns(
        {"word": word, "small": F.col("l_quantity") < 25}
    )
    mapping = [
        ("l_orderkey", "id"),
        ("l_linenumber", "line"),
        ("word", "word", "bool"),
        ("l_linenumber", "one", "BOOLEAN"),
        ("small", "small", "BOOLEAN"),
    ]
    return apply_mapping(items, mapping, "lenient")


@query(f"""
    SELECT o_orderkey AS id, CAST({DATE_CASES} AS TIMESTAMP) AS parsed,
           make_timestamp(o_custkey * 1000000) AS epoch
    FROM orders""")
def cast_lenient_date(spark, sf_dir):
    mapping = [("id", "id"), ("raw", "parsed", "datetime"), ("millis", "epoch", "Time")]
    out = apply_mapping(date_texts(spark, sf_dir), mapping, "lenient")
    return local_times(out, "parsed", "epoch")


@query(f"""
    SELECT p_partkey AS id, p_name AS name, CAST(p_size AS VARCHAR) AS size,
           {text_sql('p_retailprice')} AS price, p_retailprice AS price_kept
    FROM part""")
def cast_lenient_text(spark, sf_dir):
    mapping = [
        ("p_partkey", "id"),
        ("p_name", "name", "varchar(10)"),
        ("p_size", "size", "NUMERIC"),
        ("p_retailprice", "price", "real"),
        ("p_retailprice", "price_kept", ""),
    ]
    return apply_mapping(table(spark, sf_dir, "part"), mapping, "lenient")


# --- schema ------------------------------------------------------------------


def first_label_sql(column: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({column}, '-?[0-9]+') THEN 'INT' "
        f"WHEN regexp_full_match({column}, '-?[0-9]+(\\.[0-9]+)?') THEN 'FLOAT' "
        f"WHEN regexp_matches({column}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'DATE' "
        "ELSE 'STRING' END"
    )


def first_row_sql(columns: dict[str, str], source: str) -> str:
    cells = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    rows = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{name}' AS name, {first_label_sql(name)} AS type FROM f"
        for i, name in enumerate(columns)
    )
    return f"WITH f AS (SELECT {cells} FROM {source}) {rows}"


CUSTOMER_TEXT = {
    "c_custkey": "CAST(c_custkey AS VARCHAR)",
    "c_name": "c_name",
    "c_nationkey": "CAST(c_nationkey AS VARCHAR)",
    "c_acctbal": text_sql("c_acctbal"),
    "c_mktsegment": "c_mktsegment",
}


@query(
    first_row_sql(CUSTOMER_TEXT, "customer ORDER BY customer.c_custkey LIMIT 1"),
    name="infer_first_row",
)
def infer_first_row_by_key(spark, sf_dir):
    return infer_first_row(table(spark, sf_dir, "customer"), order_by=["c_custkey"])


def all_label_sql(column: str, text: str, source: str, pos: int) -> str:
    def fits(pattern: str, test: str) -> str:
        return f"coalesce(bool_and({test}({text}, '{pattern}')) FILTER ({text} <> ''), false)"

    return (
        f"SELECT {pos} AS pos, '{column}' AS name, CASE "
        f"WHEN {fits('-?[0-9]+', 'regexp_full_match')} THEN 'INT' "
        f"WHEN {fits('-?[0-9]+(\\.[0-9]+)?', 'regexp_full_match')} THEN 'FLOAT' "
        f"WHEN {fits('^[0-9]{4}-[0-9]{2}-[0-9]{2}', 'regexp_matches')} THEN 'DATE' "
        f"ELSE 'STRING' END AS type FROM {source}"
    )


EVENTS_TEXT = {
    "event_id": "CAST(event_id AS VARCHAR)",
    "ts": iso_sql("ts"),
    "user_id": "CAST(user_id AS VARCHAR)",
    "event_type": "event_type",
    "value": text_sql("value"),
    "props": "props",
}


@query(
    " UNION ALL ".join(
        all_label_sql(c, text, "events", i) for i, (c, text) in enumerate(EVENTS_TEXT.items())
    ),
    name="infer_all_rows",
)
def infer_all_rows_events(spark, sf_dir):
    return infer_all_rows(table(spark, sf_dir, "events"))


@query(ORACLES["infer_all_rows"], name="infer_incremental")
def infer_incremental_events(spark, sf_dir):
    """Two looks at a growing folder of CSV files; the second one reads the new files only."""
    out, known = scratch_path(spark, "files"), scratch_path(spark, "states")
    events = table(spark, sf_dir, "events")
    for kind in (F.col("event_type") == "click", ~F.coalesce(F.col("event_type") == "click", F.lit(False))):
        write_csv(events.where(kind), out, mode="append")
        labels = infer_incremental(spark, out, known)
    return labels


@query("""
    SELECT 0 AS pos, 'id' AS name, 'INT' AS type UNION ALL
    SELECT 1, 'day', 'DATE' UNION ALL SELECT 2, 'final', 'STRING'""")
def discover_csv(spark, sf_dir):
    """Labels of a CSV copy of orders, from its first data row."""
    out = scratch_path(spark, "discover")
    write_csv(apply_mapping(table(spark, sf_dir, "orders"), ORDERS_MAPPING[:3]), out)
    return discover(spark, {"dbType": "csv", "config": {"path": out}})


@query("""
    SELECT CAST(row_number() OVER (ORDER BY ordinal) - 1 AS INTEGER) AS pos, name, 'STRING' AS type
    FROM (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus'), (4, 'o_totalprice'),
                 (5, 'o_orderdate'), (6, 'o_orderpriority')) AS t (ordinal, name)""")
def schema_all_string(spark, sf_dir):
    out = scratch_path(spark, "schema")
    write_csv(table(spark, sf_dir, "orders"), out, style="object")
    return all_string(spark, read_object_csv(spark, out))


# --- files -------------------------------------------------------------------


def round_trip(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    out = scratch_path(spark, name)
    write_csv(df, out)
    return read_csv(spark, out)


@query("""
    SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
    FROM documents""")
def csv_round_trip(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "documents"), "documents")


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages")
def csv_round_trip_pages(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "pages"), "pages")


@query("""
    SELECT CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, text
    FROM conversations""")
def csv_round_trip_conversations(spark, sf_dir):
    return round_trip(spark, table(spark, sf_dir, "conversations"), "conversations")


@query(f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS id, CAST(l_linenumber AS VARCHAR) AS line,
           CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS flag,
           CASE WHEN l_discount = 0 THEN '' ELSE {text_sql('l_discount')} END AS discount
    FROM lineitem""")
def csv_blank_cells(spark, sf_dir):
    """NULL and blank text both come back as blank text."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount"),
    )
    return round_trip(spark, items, "blank")


@query("""
    SELECT CASE WHEN o_orderstatus = 'F' THEN '' ELSE CAST(o_orderkey AS VARCHAR) END AS flag
    FROM orders""")
def csv_single_column(spark, sf_dir):
    """Blank cells of a one-column table are rows as well."""
    key = F.col("o_orderkey").cast("string")
    flag = F.when(F.col("o_orderstatus") == "F", "").otherwise(key)
    return round_trip(spark, table(spark, sf_dir, "orders").select(flag.alias("flag")), "single")


@query(f"""
    SELECT o_orderkey || ',' || o_orderstatus || ',' || {text_sql('o_totalprice')} || ','
           || {iso_sql('o_orderdate')} || ',' || chr(34) || o_orderpriority || ', '
           || repeat(chr(34), 2) || o_custkey || repeat(chr(34), 3) AS line
    FROM orders""")
def csv_lines(spark, sf_dir):
    """The raw lines that are written: text forms, and quotes only where needed."""
    note = F.concat("o_orderpriority", F.lit(', "'), "o_custkey", F.lit('"'))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", note.alias("note")
    )
    out = scratch_path(spark, "lines")
    write_csv(orders, out)
    lines = spark.read.text(out).withColumnRenamed("value", "line")
    return lines.where(F.col("line") != ",".join(orders.columns))


@query("""
    SELECT CAST(l_orderkey AS VARCHAR) AS id,
           CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN ''
                ELSE l_returnflag || ', "x"' END AS flag,
           CASE WHEN l_linenumber <= 3 THEN NULL WHEN l_linenumber = 4 THEN ''
                ELSE l_linestatus END AS status
    FROM lineitem""")
def csv_short_rows(spark, sf_dir):
    """Short rows lack cells, blank cells are blank text, long rows lose the surplus."""
    line, key = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    quoted = F.concat(F.lit('"'), "l_returnflag", F.lit(', ""x"""'))
    text = (
        F.when(line == 1, key)
        .when(line == 2, F.concat(key, F.lit(",")))
        .when(line == 3, F.concat_ws(",", key, quoted))
        .when(line == 4, F.concat(key, F.lit(","), quoted, F.lit(",")))
        .otherwise(F.concat_ws(",", key, quoted, F.col("l_linestatus"), F.lit("surplus")))
    )
    out = scratch_path(spark, "ragged")
    items = table(spark, sf_dir, "lineitem").select(text.alias("value"))
    # a part has to start with the header line, and text output has no order to rely on:
    # put a header before every row, and leave out the ones that are not a part's first line
    items.select(F.concat(F.lit("id,flag,status\n"), "value").alias("value")).write.text(out)
    return read_csv(spark, out, multiline=False).where(F.col("id") != "id")


@query(f"""
    SELECT CAST(l_orderkey AS VARCHAR) AS id, {text_sql('l_tax')} AS tax,
           CASE WHEN l_linestatus = 'F' THEN '1' ELSE '' END AS final,
           CAST(epoch_ms(l_shipdate) AS VARCHAR) AS shipped
    FROM lineitem""")
def object_csv_read(spark, sf_dir):
    """CSV objects: flags as 1 or blank, instants as milliseconds, strict rows."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_tax").alias("tax"),
        (F.col("l_linestatus") == "F").alias("final"),
        F.col("l_shipdate").alias("shipped"),
    )
    out = scratch_path(spark, "object")
    write_csv(items, out, style="object")
    return read_object_csv(spark, out)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents")
def csv_split_multiline(spark, sf_dir):
    """Texts with line breaks as CSV, read back by as many tasks as the files have splits."""
    out = scratch_path(spark, "lines")
    write_csv(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), out)
    return read_csv(spark, out, multiline="split")


# --- databases ---------------------------------------------------------------


def database(spark: SparkSession) -> str:
    """URL of the database for the JDBC queries.

    ``spark.tableferry.jdbc.url`` names one that all executors can reach.  Only a
    local session may use a database inside its own process instead.
    """
    url = spark.conf.get("spark.tableferry.jdbc.url", None)
    if url:
        return url
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.tableferry.jdbc.url to a database the executors can reach")
    system = spark._jvm.java.lang.System
    if system.getProperty("derby.stream.error.field") is None:
        system.setProperty("derby.stream.error.method", "java.io.OutputStream.nullOutputStream")
    return "jdbc:derby:memory:tableferry;create=true"


CUSTOMER_DDL = (
    "(c_custkey BIGINT NOT NULL PRIMARY KEY, c_name VARCHAR(100), c_nationkey INTEGER, "
    "c_acctbal DOUBLE PRECISION, c_mktsegment VARCHAR(20))"
)


def new_table(spark: SparkSession, columns: str, **config) -> Endpoint:
    """A fresh database table with lower-case column names."""
    words = columns.replace("(c_", '("c_', 1).replace(", c_", ', "c_')
    ddl = " ".join(f'{w}"' if w.lstrip("(").startswith('"c_') else w for w in words.split(" "))
    return quoted_table(spark, ddl, **config)


def quoted_table(spark: SparkSession, ddl: str, **config) -> Endpoint:
    """A fresh database table, its columns as they are written."""
    name = f"T_{uuid.uuid4().hex[:12].upper()}"
    ep = Endpoint("jdbc", {"url": database(spark), "table": name, **config})
    with connection(spark, ep) as conn:
        execute(conn, f"CREATE TABLE {name} {ddl}")
    return ep


PLAIN_DDL = CUSTOMER_DDL.replace(" PRIMARY KEY", "")


@query("SELECT * FROM customer UNION ALL SELECT * FROM customer")
def jdbc_append_twice(spark, sf_dir):
    ep = new_table(spark, PLAIN_DDL)
    customer = table(spark, sf_dir, "customer")
    for _ in range(2):
        write_endpoint(customer, ep, batch_size=500)
    return read_endpoint(spark, ep)


@query("SELECT * FROM customer")
def jdbc_truncate(spark, sf_dir):
    ep = new_table(spark, CUSTOMER_DDL)
    customer = table(spark, sf_dir, "customer")
    for _ in range(2):
        write_endpoint(customer, ep, truncate=True)
    return read_endpoint(spark, ep)


@query("SELECT * FROM customer")
def jdbc_partitioned_read(spark, sf_dir):
    """Read in ranges of the primary key, which is found in the catalog."""
    ep = new_table(spark, CUSTOMER_DDL, numPartitions=4)
    write_endpoint(table(spark, sf_dir, "customer"), ep)
    return read_endpoint(spark, ep)


@query("""
    SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey * 1000 ELSE o_orderkey END AS id,
           o_custkey AS customer, o_totalprice AS total FROM orders""")
def jdbc_skewed_read(spark, sf_dir):
    """Nine of ten keys in a thousandth of their range, read in parts of equally many rows."""
    ddl = '("id" BIGINT NOT NULL PRIMARY KEY, "customer" BIGINT, "total" DOUBLE PRECISION)'
    ep = quoted_table(spark, ddl, numPartitions=8)
    key = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderkey") * 1000).otherwise(F.col("o_orderkey"))
    orders = table(spark, sf_dir, "orders")
    write_endpoint(orders.select(key.alias("id"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").alias("total")), ep)
    return read_endpoint(spark, ep)


@query("""
    SELECT c_mktsegment AS segment, c_name AS name, c_custkey AS id, c_acctbal AS balance FROM customer""")
def jdbc_composite_read(spark, sf_dir):
    """Read in ranges of a key of two texts, the first of which has few values."""
    ddl = (
        '("segment" VARCHAR(20) NOT NULL, "name" VARCHAR(100) NOT NULL, "id" BIGINT, "balance" DOUBLE PRECISION, '
        'PRIMARY KEY ("segment", "name"))'
    )
    ep = quoted_table(spark, ddl, numPartitions=7)
    customer = table(spark, sf_dir, "customer")
    write_endpoint(
        customer.select(
            F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"),
            F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
        ),
        ep,
    )
    return read_endpoint(spark, ep)


@query("""
    SELECT c_custkey, c_name, CAST(NULL AS INTEGER) AS c_nationkey,
           c_acctbal, CAST(NULL AS VARCHAR) AS c_mktsegment FROM customer""")
def jdbc_subset_columns(spark, sf_dir):
    """Columns are matched by name; the ones that are not written stay NULL."""
    ep = new_table(spark, CUSTOMER_DDL)
    write_endpoint(table(spark, sf_dir, "customer").select("c_acctbal", "c_name", "c_custkey"), ep)
    return read_endpoint(spark, ep)


@query("SELECT * FROM customer UNION ALL SELECT * FROM customer")
def jdbc_staged_append(spark, sf_dir):
    """Through a staging table; a batch that is replayed is applied once."""
    ep = new_table(spark, PLAIN_DDL)
    customer = table(spark, sf_dir, "customer")
    stream = uuid.uuid4().hex
    for batch in (0, 1, 1):
        write_endpoint(customer, ep, batch=(stream, batch))
    return read_endpoint(spark, ep)


@query("""
    SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS pos, column_name AS name,
           CASE column_type WHEN 'VARCHAR' THEN 'CLOB(2147483647)' ELSE column_type END AS type
    FROM (DESCRIBE SELECT * FROM customer)""")
def schema_jdbc(spark, sf_dir):
    """Catalog labels of a table that was created from customer's own columns."""
    name = f"T_{uuid.uuid4().hex[:12].upper()}"
    ep = Endpoint("jdbc", {"url": database(spark), "table": name})
    write_endpoint(table(spark, sf_dir, "customer"), ep, create=True)
    return discover(spark, ep)


# --- run accounting ----------------------------------------------------------


@query("""
    SELECT '****' AS c_custkey, c_name, '****' AS c_nationkey, c_acctbal, c_mktsegment
    FROM customer""")
def redact_columns(spark, sf_dir):
    return redact(table(spark, sf_dir, "customer"))


@query("""
    SELECT event_id AS id, '****' AS secret, event_type AS kind, '****' AS user_password,
           CAST(json_extract(props, '$.k') AS INTEGER) AS k, '****' AS api_key,
           event_type AS plain
    FROM events""")
def redact_nested(spark, sf_dir):
    """Fields of structs, elements of arrays and entries of maps are masked by name."""
    k = F.get_json_object("props", "$.k").cast("int")
    nested = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.struct(
            F.col("user_id").alias("secret_id"),
            F.array(
                F.struct(F.col("event_type").alias("kind"), F.col("value").alias("userPassword"))
            ).alias("parts"),
            k.alias("k"),
        ).alias("body"),
        F.create_map(
            F.lit("ApiKey"), F.col("props"), F.lit("plain"), F.col("event_type")
        ).alias("config"),
    )
    out = redact(nested)
    return out.select(
        "id",
        F.col("body.secret_id").alias("secret"),
        F.col("body.parts")[0]["kind"].alias("kind"),
        F.col("body.parts")[0]["userPassword"].alias("user_password"),
        F.col("body.k").alias("k"),
        F.col("config")["ApiKey"].alias("api_key"),
        F.col("config")["plain"].alias("plain"),
    )


@query("""
    SELECT count(*) AS moved, count(*) FILTER (l_returnflag <> 'N') AS lost_returned,
           count(*) FILTER (l_linestatus <> 'F') AS lost_open, 0::BIGINT AS lost_shipped
    FROM lineitem""")
def copy_metrics(spark, sf_dir):
    """Row and loss counts, collected by the tasks that write the copy."""
    out = scratch_path(spark, "metrics")
    spec = {
        "source": parquet(sf_dir, "lineitem"),
        "destination": {"dbType": "csv", "config": {"path": out}},
        "mapping": [
            {"from": "l_orderkey", "to": "id"},
            {"from": "l_returnflag", "to": "returned", "cast": "BOOLEAN"},
            {"from": "l_linestatus", "to": "open", "cast": "BOOLEAN"},
            {"from": "l_shipdate", "to": "shipped", "cast": "DATE"},
        ],
    }
    result = migrate(spark, spec)
    done(result)
    row = (
        result.moved,
        result.losses["returned"],
        result.losses["open"],
        result.losses.get("shipped", 0),
    )
    schema = "moved long, lost_returned long, lost_open long, lost_shipped long"
    return spark.createDataFrame([row], schema)


@query(f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS "runId", o_orderstatus AS status,
           coalesce(CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS VARCHAR) END,
                    CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS VARCHAR) END, '-') AS rows,
           CASE WHEN CAST(o_totalprice AS BIGINT) = 0 THEN '-'
                ELSE CAST(CAST(floor(CAST(o_totalprice AS BIGINT) / 1000 + 0.5) AS BIGINT)
                          AS VARCHAR) || 's' END AS duration,
           CASE WHEN o_orderstatus = 'P' THEN '-' ELSE {iso_sql('o_orderdate')} END AS started,
           '-' AS output
    FROM orders""", name="run_history")
def run_history_rows(spark, sf_dir):
    status = F.col("o_orderstatus")
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    summaries = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("runId"),
        status.alias("status"),
        F.when(status != "P", day).alias("startedAt"),
        F.lit(None).cast("string").alias("endedAt"),
        F.when(status == "O", F.col("o_orderkey")).alias("rowsRead"),
        F.when(status == "F", F.col("o_custkey")).alias("rowsWritten"),
        F.round("o_totalprice").cast("long").alias("durationMs"),
        F.lit(None).cast("string").alias("outputUrl"),
    )
    return run_history(summaries)


@query("""
    SELECT 'customer' AS "runId", 'succeeded' AS status, count(*) AS "rowsRead",
           count(*) AS "rowsWritten" FROM customer
    UNION ALL SELECT 'orders', 'succeeded', count(*), count(*) FROM orders
    UNION ALL SELECT 'lineitem', 'succeeded', count(*), count(*) FROM lineitem""", name="run_summaries")
def run_summaries_read(spark, sf_dir):
    """Three logged copies, and their summaries read back."""
    runs, out = scratch_path(spark, "runs"), scratch_path(spark, "copies")
    for name in ("customer", "orders", "lineitem"):
        target = {"dbType": "csv", "config": {"path": f"{out}/{name}"}}
        spec = {"source": parquet(sf_dir, name), "destination": target}
        done(migrate(spark, spec, runs_dir=runs, run_id=name))
    return run_summaries(spark, runs).select("runId", "status", "rowsRead", "rowsWritten")


@query(f"""
    SELECT {iso_sql('ts')} AS ts, event_type AS "runId", event_id AS "eventId", value
    FROM events""", name="run_events")
def run_events_read(spark, sf_dir):
    """Events as a JSON-lines log, one log per kind, and all logs read back."""
    runs = scratch_path(spark, "events")
    events = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        F.col("event_type").alias("runId"),
        F.col("event_id").alias("eventId"),
        "value",
    )
    events.write.json(f"{runs}/all/run.jsonl")
    return run_events(spark, runs, fields="eventId long, value double")


# --- workflows ---------------------------------------------------------------


@query("""
    SELECT 'keys' AS sink, CAST(o_orderkey AS VARCHAR) AS id, '' AS prio FROM orders
    UNION ALL SELECT 'all', CAST(o_orderkey AS VARCHAR), o_orderpriority FROM orders""")
def workflow_fan_out(spark, sf_dir):
    """One source, two destinations, a mapping per edge."""
    out = scratch_path(spark, "fanout")

    def sink(name: str) -> dict:
        config = {"path": f"{out}/{name}"}
        return {"id": name, "kind": "destination", "label": name, "dbType": "csv", "config": config}

    source = {"id": "src", "kind": "source", "label": "orders", **parquet(sf_dir, "orders")}
    spec = {
        "nodes": [source, sink("keys"), sink("all")],
        "edges": [{"from": "src", "to": "keys"}, {"from": "src", "to": "all"}],
    }
    mappings = {
        ("src", "keys"): [("o_orderkey", "id")],
        ("src", "all"): [("o_orderkey", "id"), ("o_orderpriority", "prio")],
    }
    for result in run_workflow(spark, spec, mappings=mappings):
        done(result)
    keys = read_csv(spark, f"{out}/keys").select(F.lit("keys").alias("sink"), "id", F.lit("").alias("prio"))
    return keys.unionByName(read_csv(spark, f"{out}/all").withColumn("sink", F.lit("all")))


@query("SELECT o_orderkey AS id, o_orderpriority AS prio, 1::BIGINT AS copies FROM orders")
def workflow_resume(spark, sf_dir):
    """A workflow that is run again takes the edges that are not on record: each row once."""
    records, rows = scratch_path(spark, "edges"), quoted_table(spark, '("id" BIGINT, "prio" VARCHAR(40))')
    source = {"id": "src", "kind": "source", "label": "orders", **parquet(sf_dir, "orders")}
    target = {"id": "db", "kind": "destination", "label": "db", "dbType": "jdbc", "config": rows.config}
    files = {"path": scratch_path(spark, "keys")}
    other = {"id": "keys", "kind": "destination", "label": "keys", "dbType": "csv", "config": files}
    first = {"nodes": [source, target], "edges": [{"from": "src", "to": "db"}]}
    both = {"nodes": [source, target, other], "edges": [*first["edges"], {"from": "src", "to": "keys"}]}
    mappings = {("src", "db"): [("o_orderkey", "id"), ("o_orderpriority", "prio")], ("src", "keys"): [("o_orderkey", "id")]}
    for spec in (first, both):
        for result in run_workflow(spark, spec, mappings=mappings, ledger=records, concurrent=2):
            done(result)
    return read_endpoint(spark, rows).groupBy("id", "prio").agg(F.count(F.lit(1)).alias("copies"))


def order_specs(spark, sf_dir) -> DataFrame:
    """A workflow per order: a CSV source and a database destination, some incomplete."""
    status, none = F.col("o_orderstatus"), F.lit(None).cast("string")
    source = F.struct(
        F.lit("s").alias("id"),
        F.lit("source").alias("kind"),
        F.col("o_orderpriority").alias("label"),
        F.when(status != "P", "csv").alias("dbType"),
        F.create_map(F.lit("path"), F.when(status == "F", "in.csv").otherwise("")).alias("config"),
    )
    target = F.struct(
        F.lit("d").alias("id"),
        F.lit("destination").alias("kind"),
        F.concat(F.lit("customer "), "o_custkey").alias("label"),
        F.lit("mysql").alias("dbType"),
        F.map_from_arrays(
            F.array(*map(F.lit, ("host", "port", "user", "password", "database", "table"))),
            F.array(F.lit("db"), none, F.lit("me"), F.lit("pw"), F.lit("shop"), F.lit("orders")),
        ).alias("config"),
    )
    edge = F.struct(F.lit("s").alias("from"), F.lit("d").alias("to"))
    edges = F.when(F.col("o_totalprice") > 100000, F.array(edge)).otherwise(
        F.array().cast("array<struct<from:string,to:string>>")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array(source, target).alias("nodes"), edges.alias("edges")
    )


@query("""
    SELECT o_orderkey, 's' AS node_id, o_orderpriority || ' (source)' AS label,
           'pick a database' AS issue, 'error' AS severity,
           o_orderpriority || ' (source): pick a database' AS message
    FROM orders WHERE o_orderstatus = 'P'
    UNION ALL
    SELECT o_orderkey, 's', o_orderpriority, '''path'' is empty', 'error',
           o_orderpriority || ': ''path'' is empty'
    FROM orders WHERE o_orderstatus = 'O'
    UNION ALL
    SELECT o_orderkey, 'd', 'customer ' || o_custkey, '''port'' is empty', 'warning',
           'customer ' || o_custkey || ': ''port'' is empty'
    FROM orders
    UNION ALL
    SELECT o_orderkey, 'd', 'customer ' || o_custkey, 'no incoming connection', 'error',
           'customer ' || o_custkey || ': no incoming connection'
    FROM orders WHERE o_totalprice <= 100000""", name="audit_specs")
def audit_order_specs(spark, sf_dir):
    """Issues of a table of workflows, stored as JSON text."""
    specs = export_specs(order_specs(spark, sf_dir), "o_orderkey", masked=False)
    return audit_specs(specs, "o_orderkey")


@query("""
    SELECT o_orderkey,
      '{"version":1,"nodes":[{"id":"s","kind":"source","label":"' || o_orderpriority || '"'
      || CASE WHEN o_orderstatus = 'P' THEN '' ELSE ',"dbType":"csv"' END
      || ',"config":{"path":"' || CASE WHEN o_orderstatus = 'F' THEN 'in.csv' ELSE '' END
      || '"}},{"id":"d","kind":"destination","label":"customer ' || o_custkey
      || '","dbType":"mysql","config":{"host":"db","port":null,"user":"me","password":"****",'
      || '"database":"shop","table":"orders"}}],"edges":['
      || CASE WHEN o_totalprice > 100000 THEN '{"from":"s","to":"d"}' ELSE '' END || ']}' AS spec
    FROM orders""", name="export_specs")
def export_order_specs(spark, sf_dir):
    """Workflows as JSON text with the passwords masked."""
    return export_specs(order_specs(spark, sf_dir), "o_orderkey")


@query("SELECT event_id AS id, event_type AS kind, value AS amount, 1::BIGINT AS copies FROM events", name="incremental_copy")
def incremental_copy_events(spark, sf_dir):
    """Two runs over the same files copy every row once."""
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "checkpoint")
    mapping = [("event_id", "id"), ("event_type", "kind"), ("value", "amount")]
    target = {"dbType": "spark", "config": {"path": out}}
    for _ in range(2):
        run = incremental_copy(
            spark, parquet(sf_dir, "events"), target, mapping, checkpoint=checkpoint
        )
        run.awaitTermination()
    return spark.read.parquet(out).groupBy("id", "kind", "amount").agg(
        F.count(F.lit(1)).alias("copies")
    )



@query("SELECT c_custkey AS id, c_name AS name, 1::BIGINT AS copies FROM customer")
def incremental_jdbc(spark, sf_dir):
    """A recurring copy from a growing table: three runs by a cursor, each row once."""
    ddl = '("id" BIGINT NOT NULL PRIMARY KEY, "stage" INTEGER NOT NULL, "name" VARCHAR(100))'
    source = quoted_table(spark, ddl, cursor="stage", numPartitions=4)
    out, checkpoint = scratch_path(spark, "rows"), scratch_path(spark, "checkpoint")
    stage = F.floor(F.col("c_nationkey") / 9).cast("int")
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.coalesce(stage, F.lit(0)).alias("stage"), F.col("c_name").alias("name")
    )
    for number in range(3):
        write_endpoint(customer.where(F.col("stage") == number), source)
        run = incremental_copy(
            spark, source, {"dbType": "spark", "config": {"path": out}}, [("id", "id"), ("name", "name")], checkpoint=checkpoint
        )
        run.awaitTermination()
    return spark.read.parquet(out).groupBy("id", "name").agg(F.count(F.lit(1)).alias("copies"))
