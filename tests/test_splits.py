"""Balanced database reads: texts of each dialect, and every row once on Derby inside the test process."""

import random
import uuid
from datetime import date, datetime
from decimal import Decimal

import pytest

from tableferry import read_endpoint, write_endpoint
from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sources import jdbc, splits
from tableferry.sources.jdbc import connection, execute

DIALECTS = {"postgres": jdbc.POSTGRES, "mysql": jdbc.MYSQL, "mssql": jdbc.MSSQL, "oracle": jdbc.ORACLE, "derby": jdbc.DERBY}


def test_literals():
    when = datetime(2024, 2, 29, 1, 2, 3, 45)
    texts = {k: [splits.literal_of(d, v) for v in ("o'b\\c", when, date(2024, 1, 2), b"\x00\xff")] for k, d in DIALECTS.items()}
    stamp = "2024-02-29 01:02:03.000045"
    assert texts["postgres"] == ["'o''b\\c'", f"TIMESTAMP '{stamp}'", "DATE '2024-01-02'", "'\\x00ff'::bytea"]
    assert texts["mysql"] == ["'o''b\\\\c'", f"TIMESTAMP '{stamp}'", "DATE '2024-01-02'", "X'00ff'"]
    assert texts["mssql"] == ["N'o''b\\c'", f"CAST('{stamp}' AS datetime2)", "CAST('2024-01-02' AS date)", "0x00ff"]
    assert texts["oracle"] == ["'o''b\\c'", f"TIMESTAMP '{stamp}'", "DATE '2024-01-02'", "HEXTORAW('00ff')"]
    assert texts["derby"][1:3] == [f"TIMESTAMP('{stamp}')", "DATE('2024-01-02')"]
    numbers = [splits.literal_of(jdbc.DERBY, v) for v in (-5, Decimal("1E+3"), Decimal("0.10"), 1e-7)]
    assert numbers == ["-5", "1000", "0.10", "1e-07"]


def test_composite_conditions_of_each_dialect():
    key, at = ["a", "b", "c"], ["1", "'x'", "9"]
    assert splits.at_least(jdbc.POSTGRES, key, at) == "(a, b, c) >= (1, 'x', 9)"
    assert splits.below(jdbc.POSTGRES, key, at) == "(a, b, c) < (1, 'x', 9)"
    for d in (jdbc.MYSQL, jdbc.MSSQL, jdbc.ORACLE, jdbc.DERBY):
        assert splits.at_least(d, key, at) == "a >= 1 AND (a > 1 OR (b >= 'x' AND (b > 'x' OR (c >= 9))))"
        assert splits.below(d, key, at) == "a <= 1 AND (a < 1 OR (b <= 'x' AND (b < 'x' OR (c < 9))))"


def test_spelled_out_conditions_take_each_key_once():
    rng = random.Random(1)
    rows = [tuple(rng.randrange(4) for _ in range(3)) for _ in range(200)]
    bounds = sorted(set(rng.sample(rows, 5)))
    taken = splits.between(jdbc.DERBY, ["a", "b", "c"], bounds, nullable=False)
    code = [c.replace("=", "==").replace(">==", ">=").replace("<==", "<=").replace("AND", "and").replace("OR", "or") for c in taken]
    for a, b, c in rows:
        assert [eval(x, {"a": a, "b": b, "c": c}) for x in code].count(True) == 1
        place = [eval(x, {"a": a, "b": b, "c": c}) for x in code].index(True)
        assert place == sum(bound <= (a, b, c) for bound in bounds)


def test_bounds_sql_of_each_dialect():
    sql = {k: splits.bounds_sql(d, "t", ["a", "b"], 7, "1 = 1") for k, d in DIALECTS.items()}
    inner = "(SELECT a, b, ROW_NUMBER() OVER (ORDER BY a, b) AS tf_rn FROM t WHERE 1 = 1) tf_q WHERE tf_rn > 1 AND "
    for k in ("postgres", "mysql", "oracle"):
        assert sql[k] == f"SELECT a, b, tf_rn FROM {inner}MOD(tf_rn - 1, 7) = 0"
    assert sql["mssql"] == f"SELECT a, b, tf_rn FROM {inner}(tf_rn - 1) % 7 = 0"
    assert "(SELECT a, b FROM t WHERE 1 = 1 ORDER BY a, b) tf_o" in sql["derby"]


def test_tables_without_a_key():
    assert splits.page_ranges(100, 4) == [
        "ctid < '(25,0)'::tid", "ctid >= '(25,0)'::tid AND ctid < '(50,0)'::tid",
        "ctid >= '(50,0)'::tid AND ctid < '(75,0)'::tid", "ctid >= '(75,0)'::tid",
    ]
    assert splits.page_ranges(0, 4) == ["1 = 1"] and len(splits.page_ranges(2, 8)) == 2
    assert splits.pages_sql('"s"."o\'b"').startswith("SELECT pg_relation_size('\"s\".\"o''b\"'::regclass)")
    assert splits.rowid_ranges(["A", "B", "C"]) == [
        "ROWID < CHARTOROWID('B')", "ROWID >= CHARTOROWID('B') AND ROWID < CHARTOROWID('C')", "ROWID >= CHARTOROWID('C')",
    ]
    assert splits.rowid_ranges([]) == ["1 = 1"] and "NTILE(5) OVER (ORDER BY ROWID)" in splits.rowid_sql("t", 5)
    assert splits.hash_buckets(jdbc.MYSQL.hashed, ["`a`", "`b`"], 2) == [
        "MOD(CRC32(CONCAT_WS('|', `a`, `b`)), 2) = 0", "MOD(CRC32(CONCAT_WS('|', `a`, `b`)), 2) = 1",
    ]
    assert splits.hash_buckets(jdbc.MSSQL.hashed, ["[a]"], 3)[2] == "ABS(CAST(BINARY_CHECKSUM(*) AS BIGINT)) % 3 = 2"
    assert [d.chunks for d in DIALECTS.values()] == ["pages", "hash", "hash", "rowids", None]


def test_samples_of_each_dialect():
    texts = {k: d.sample and d.sample.format(table="t", percent=1.5) for k, d in DIALECTS.items()}
    assert texts["postgres"] == "t TABLESAMPLE SYSTEM (1.5)" and texts["mssql"] == "t TABLESAMPLE (1.5 PERCENT)"
    assert texts["oracle"] == "t SAMPLE (1.5)" and "RAND() * 100 < 1.5" in texts["mysql"] and texts["derby"] is None


# --- behaviour on Derby ------------------------------------------------------


@pytest.fixture()
def new(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))

    def make(ddl, rows=None, schema=None, **config):
        name = f"T_{uuid.uuid4().hex[:10].upper()}"
        e = Endpoint("jdbc", {"url": "jdbc:derby:memory:tests;create=true", "table": name, **config})
        with connection(spark, e) as conn:
            execute(conn, f"CREATE TABLE {name} {ddl}")
        if rows is not None:
            write_endpoint(rows if schema is None else spark.createDataFrame(rows, schema), e)
        return e

    return make


def parts(df):
    return [len(p) for p in df.rdd.glom().collect()]


def test_skewed_numbers_give_equal_parts(spark, new):
    """Nine of ten keys lie in a hundredth of the range."""
    keys = [*range(900), *range(1_000, 90_000, 890)]
    e = new('("k" BIGINT NOT NULL PRIMARY KEY)', [(k,) for k in keys], "k long", numPartitions=8)
    df = read_endpoint(spark, e)
    sizes = parts(df)
    assert len(sizes) == 8 and max(sizes) <= 2 * len(keys) / 8 and min(sizes) > 0
    assert sorted(r.k for r in df.collect()) == keys


def test_both_ends_and_nulls(spark, new):
    least, most = -(2**63), 2**63 - 1
    rows = [(least, 1), (most, 2), (None, 3), (0, 4), (None, 5), (least, 6), (most, 7)]
    e = new('("k" BIGINT, "v" INTEGER)', rows, "k long, v int", numPartitions=3, partitionColumn="k")
    df = read_endpoint(spark, e)
    assert sorted(r.v for r in df.collect()) == [1, 2, 3, 4, 5, 6, 7]
    assert max(parts(df)) <= 4
    for n in (2, 5, 50):
        e = Endpoint(e.type, {**e.config, "numPartitions": n})
        assert sorted(r.v for r in read_endpoint(spark, e).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_text_and_composite_keys(spark, new):
    rng = random.Random(5)
    words = [f"{rng.choice(['', ' ', 'é', 'A', 'a', chr(39), '%'])}w{i % 37}" for i in range(400)]
    rows = [(w, i % 7, i) for i, w in enumerate(words)]
    rows = list({(a, b): (a, b, c) for a, b, c in rows}.values())
    e = new('("a" VARCHAR(20) NOT NULL, "b" INTEGER NOT NULL, "v" INTEGER, PRIMARY KEY ("b", "a"))', rows, "a string, b int, v int", numPartitions=6)
    df = read_endpoint(spark, e)
    assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    assert len(parts(df)) == 6 and max(parts(df)) <= 2 * len(rows) / 6
    # the key's own order comes first, so that an index serves it
    with connection(spark, e) as conn:
        assert splits.table_key(conn, spark, e) == ["b", "a"]
    by_text = read_endpoint(spark, Endpoint(e.type, {**e.config, "partitionColumn": "a"}))
    assert sorted(tuple(r) for r in by_text.collect()) == sorted(rows) and max(parts(by_text)) <= 2 * len(rows) / 6


def test_one_value_in_most_rows_is_split_by_the_tables_own_key(spark, new):
    rows = [(i, 7 if i % 10 else None) for i in range(300)]
    e = new('("id" INTEGER NOT NULL PRIMARY KEY, "s" INTEGER)', rows, "id int, s int", numPartitions=5, partitionColumn="s")
    df = read_endpoint(spark, e)
    assert sorted(r.id for r in df.collect()) == list(range(300)) and max(parts(df)) <= 60


def test_dates_instants_decimals_and_unique_indexes(spark, new):
    e = new('("d" DATE NOT NULL, "t" TIMESTAMP NOT NULL, "n" DECIMAL(20, 4) NOT NULL)', numPartitions=4)
    rows = [(date(2020, 1, 1 + i % 28), datetime(2020, 1, 1, i % 24, i % 60, 1, i), Decimal(i) / 8) for i in range(100)]
    write_endpoint(spark.createDataFrame(rows, "d date, t timestamp_ntz, n decimal(20,4)"), e)
    with connection(spark, e) as conn:
        assert splits.table_key(conn, spark, e) == []
        execute(conn, f'CREATE UNIQUE INDEX "u_{e.get("table")}" ON {e.get("table")} ("t", "n")')
        assert splits.table_key(conn, spark, e) == ["t", "n"]
    for config in ({}, {"partitionColumn": "d"}, {"partitionColumn": ["n"]}, {"partitionColumn": "d, n"}):
        df = read_endpoint(spark, Endpoint(e.type, {**e.config, **config}))
        assert sorted(r.n for r in df.collect()) == sorted(r[2] for r in rows) and max(parts(df)) <= 50


def test_no_key_is_one_task_and_an_empty_table_too(spark, new):
    e = new('("v" INTEGER)', [(1,), (1,)], "v int", numPartitions=4)
    assert parts(read_endpoint(spark, e)) == [2]
    e = new('("k" INTEGER NOT NULL PRIMARY KEY)', numPartitions=4)
    assert read_endpoint(spark, e).count() == 0
    with pytest.raises(SpecError, match="samples no tables"):
        read_endpoint(spark, Endpoint(e.type, {**e.config, "splitSample": 5}))


def test_columns_that_may_be_null_come_first_or_not_at_all(spark, new):
    e = new('("a" INTEGER NOT NULL, "b" INTEGER)', [(1, None), (2, 3)], "a int, b int", numPartitions=2)
    with pytest.raises(SpecError, match="cannot split the read by column 'b'"):
        read_endpoint(spark, Endpoint(e.type, {**e.config, "partitionColumn": "a,b"}))
    df = read_endpoint(spark, Endpoint(e.type, {**e.config, "partitionColumn": "b,a"}))
    assert sorted(r.a for r in df.collect()) == [1, 2]


def test_filters_and_columns_still_reach_the_database(spark, new):
    e = new('("k" VARCHAR(9) NOT NULL PRIMARY KEY, "v" INTEGER, "w" INTEGER)', [(f"k{i:03}", i, i) for i in range(50)], "k string, v int, w int", numPartitions=3)
    df = read_endpoint(spark, e).where("v > 40").select("k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,40)" in plan and "struct<k:string>" in plan and df.count() == 9


def test_widths_are_still_there(spark, new):
    e = new('("k" INTEGER NOT NULL PRIMARY KEY)', [(i,) for i in range(100)], "k int", numPartitions=4, partitionColumn="k", lowerBound=0, upperBound=100)
    assert parts(read_endpoint(spark, e)) == [25, 25, 25, 25]


def test_an_absent_table_is_told_from_other_failures(spark, new):
    e = new('("k" INTEGER)')
    absent = Endpoint("jdbc", {**e.config, "table": "NO_SUCH_TABLE"})
    assert jdbc.table_exists(spark, e) and not jdbc.table_exists(spark, absent)
    with pytest.raises(Exception, match="(?i)syntax"):
        jdbc.table_exists(spark, Endpoint("jdbc", {**e.config, "table": "SELECT ("}))
