"""JDBC: texts for the four databases, and behaviour on Derby inside the test process.

No live PostgreSQL, MySQL, SQL Server or Oracle is involved.
"""

import uuid

import pytest

from tableferry import discover, migrate, read_endpoint, write_endpoint
from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sinks import jdbc as sink
from tableferry.sources import jdbc
from tableferry.sources.jdbc import connection, dialect_of, execute

BASE = {"host": "h", "user": "u", "password": "p", "database": "d", "table": "t"}


def ep(kind, **config):
    return Endpoint(kind, {**BASE, **config})


def test_urls():
    assert dialect_of(ep("postgres")).url(ep("postgres")).startswith("jdbc:postgresql://h:5432/d?")
    assert "sslmode=require" in dialect_of(ep("postgres")).url(ep("postgres", ssl=True))
    assert "sslmode" not in dialect_of(ep("postgres")).url(ep("postgres"))
    assert dialect_of(ep("mysql")).url(ep("mysql", port="3307")).startswith("jdbc:mysql://h:3307/d?")
    url = dialect_of(ep("mssql")).url(ep("mssql"))
    assert url == "jdbc:sqlserver://h:1433;databaseName=d;encrypt=false;trustServerCertificate=true"
    assert dialect_of(ep("oracle")).url(ep("oracle", service="X")) == "jdbc:oracle:thin:@//h:1521/X"


def test_tables():
    table = lambda e: dialect_of(e).table(e)
    assert table(ep("postgres")) == '"public"."t"'
    assert table(ep("postgres", schema="s", table='a"b')) == '"s"."a""b"'
    assert table(ep("mysql", table="a`b")) == "`d`.`a``b`"
    assert table(ep("mssql")) == "[dbo].[t]"
    assert table(ep("mssql", table="a]b")) == "[dbo].[a]]b]"
    assert table(ep("oracle", schema="IGNORED", table="OWN.T")) == "OWN.T"
    with pytest.raises(SpecError, match="oracle endpoint requires 'table'"):
        table(ep("oracle", table=""))


def test_oracle_owner():
    assert jdbc.oracle_owner(ep("oracle", table="own.tab", schema="s")) == ("OWN", "TAB")
    assert jdbc.oracle_owner(ep("oracle", table=" tab ", schema="s")) == ("S", "TAB")
    assert jdbc.oracle_owner(ep("oracle", table="tab")) == ("U", "TAB")


def test_catalog_sql():
    sql = dialect_of(ep("postgres")).columns_sql(ep("postgres", table="o'b"))
    assert "table_schema = 'public'" in sql and "table_name = 'o''b'" in sql
    assert "TABLE_SCHEMA = 'd'" in dialect_of(ep("mysql")).columns_sql(ep("mysql"))
    assert "OBJECT_ID('[dbo].[t]')" in dialect_of(ep("mssql")).columns_sql(ep("mssql"))
    assert "OWNER = 'U' AND TABLE_NAME = 'T'" in dialect_of(ep("oracle")).columns_sql(ep("oracle"))


def test_publish_statements():
    d = jdbc.MSSQL
    assert sink.publish_sql(d, "[dbo].[t]", "[dbo].[s]", ["id", "n"], truncate=True, identity=True) == [
        "DELETE FROM [dbo].[t]",
        "SET IDENTITY_INSERT [dbo].[t] ON",
        "INSERT INTO [dbo].[t] ([id], [n]) SELECT [id], [n] FROM [dbo].[s] q",
        "SET IDENTITY_INSERT [dbo].[t] OFF",
    ]
    (one,) = sink.publish_sql(jdbc.POSTGRES, '"t"', '"s"', ["id"], distinct=True)
    assert one == 'INSERT INTO "t" ("id") SELECT "id" FROM (SELECT DISTINCT "id", "tf_row" FROM "s") q'
    like = d.create_like.format(new="s", cols="[id]", old="t")
    assert like == "SELECT [id] INTO s FROM t WHERE 1 = 0 UNION ALL SELECT [id] FROM t WHERE 1 = 0"


def test_target_columns():
    assert sink.target_columns(["ID", "n"], ["id", "n", "N"]) == ["id", "n"]
    with pytest.raises(SpecError, match="no column 'x'"):
        sink.target_columns(["x"], ["id"])


# --- behaviour on Derby ------------------------------------------------------


@pytest.fixture()
def new(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))

    def make(ddl='("id" BIGINT NOT NULL PRIMARY KEY, "name" VARCHAR(20))', **config):
        name = f"T_{uuid.uuid4().hex[:10].upper()}"
        e = Endpoint("jdbc", {"url": "jdbc:derby:memory:tests;create=true", "table": name, **config})
        if ddl:
            with connection(spark, e) as conn:
                execute(conn, f"CREATE TABLE {name} {ddl}")
        return e

    return make


def people(spark, n=10):
    return spark.range(n).selectExpr("id", "concat('n', id) AS name")


def test_append_needs_the_table(spark, new):
    e = new(ddl=None)
    with pytest.raises(SpecError, match="does not exist"):
        write_endpoint(people(spark), e)
    write_endpoint(people(spark), e, create=True)
    assert read_endpoint(spark, e).count() == 10


def test_unknown_column_is_an_error(spark, new):
    e = new()
    with pytest.raises(Exception, match="(?i)column"):
        write_endpoint(people(spark).withColumnRenamed("name", "nom"), e)
    with pytest.raises(SpecError, match="no column 'nom'"):
        write_endpoint(people(spark).withColumnRenamed("name", "nom"), e, atomic=True)


def test_no_rows_is_a_no_op(spark, new):
    e = new()
    write_endpoint(people(spark, 0), e)
    write_endpoint(people(spark, 0), e, atomic=True)
    assert read_endpoint(spark, e).count() == 0


def test_partitioned_by_primary_key(spark, new):
    e = new(numPartitions=4)
    write_endpoint(people(spark, 100), e)
    df = read_endpoint(spark, e)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    assert df.where("id >= 0").select("id").distinct().count() == 100


def test_partition_column_has_to_have_an_order(spark, new):
    e = new(numPartitions=4, partitionColumn="nom")
    with pytest.raises(SpecError, match="cannot split"):
        read_endpoint(spark, e)


def test_nulls_in_the_partition_column_are_kept(spark, new):
    e = new('("k" INTEGER, "v" INTEGER)', numPartitions=3, partitionColumn="k")
    df = spark.createDataFrame([(None, 1), (1, 2), (9, 3), (None, 4)], "k int, v int")
    write_endpoint(df, e)
    assert sorted(r.v for r in read_endpoint(spark, e).collect()) == [1, 2, 3, 4]


def test_truncate_keeps_the_definition(spark, new):
    e = new()
    write_endpoint(people(spark, 5), e)
    for atomic in (False, True):
        write_endpoint(people(spark, 3), e, truncate=True, atomic=atomic)
        assert read_endpoint(spark, e).count() == 3
    types = [r["type"] for r in discover(spark, e).collect()]
    assert types == ["BIGINT NOT NULL", "VARCHAR(20)"]


def test_atomic_is_all_or_nothing(spark, new):
    e = new()
    write_endpoint(people(spark, 5), e)
    with pytest.raises(Exception, match="(?i)duplicate key"):
        write_endpoint(spark.range(3, 50).selectExpr("id", "'x' AS name"), e, atomic=True)
    assert read_endpoint(spark, e).count() == 5
    with connection(spark, e) as conn:
        left = jdbc.fetch_row(conn, "SELECT COUNT(*) FROM SYS.SYSTABLES WHERE TABLENAME LIKE 'tf_stage%'")
    assert left == ("0",)


def test_rows_staged_twice_are_published_once(spark, new, monkeypatch):
    """A task that is retried after its commit leaves its rows twice."""
    e, real = new('("id" BIGINT, "name" VARCHAR(20))'), sink._writer

    class Twice:
        def __init__(self, *args):
            self.args = args

        def mode(self, m):
            first = real(*self.args).mode(m)
            df = self.args[0].where("id < 4")
            again = real(df, *self.args[1:]).mode(m)

            class Save:
                def save(_):
                    first.save()
                    again.save()

            return Save()

    monkeypatch.setattr(sink, "_writer", lambda *a: Twice(*a))
    data = people(spark).unionByName(people(spark, 1))  # a true duplicate stays
    sink.write_staged(data, e)
    assert sorted(r.id for r in read_endpoint(spark, e).collect()) == [0, *range(10)]


def test_replayed_batch_is_skipped(spark, new):
    e = new('("id" BIGINT, "name" VARCHAR(20))')
    stream = uuid.uuid4().hex
    for batch in (0, 0, 1):
        write_endpoint(people(spark, 2), e, batch=(stream, batch))
    assert read_endpoint(spark, e).count() == 4


def test_copy_between_tables(spark, new):
    a, b = new(), new('("ID" BIGINT, "Name" VARCHAR(20))')
    write_endpoint(people(spark, 7), a)
    spec = {"source": {"dbType": "jdbc", "config": a.config}, "destination": {"dbType": "jdbc", "config": b.config}}
    result = migrate(spark, spec, automap=True)
    assert result.ok, result.message
    assert result.moved == 7 and sorted(r.Name for r in read_endpoint(spark, b).collect())[0] == "n0"
    assert migrate(spark, spec, automap=True, atomic=True).moved == 7
    assert read_endpoint(spark, b).count() == 14


def test_nested_values_are_json_text(spark, new):
    e = new('("id" BIGINT, "name" VARCHAR(40))')
    write_endpoint(spark.sql("SELECT 1L AS id, map('k', 1) AS name"), e)
    assert read_endpoint(spark, e).first() == (1, '{"k":1}')
