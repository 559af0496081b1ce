from pyspark.sql import types as T

from tableferry import apply_mapping, auto_map
from tableferry.plans.spec import MappingItem


def test_identity(spark):
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    assert apply_mapping(df, None) is df and apply_mapping(df, []) is df


def test_project_rename_reorder(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "id int, s string, v double")
    out = apply_mapping(df, [{"from": "v", "to": "x"}, {"from": "id", "to": "y", "cast": "STRING"}])
    assert out.columns == ["x", "y"] and out.first() == (2.0, "1")


def test_source_names_are_exact(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`a` int, `a.b` int, `b` int")
    out = apply_mapping(df, [("A", "up"), ("a.b", "dot"), ("b", "b.c")])
    assert out.columns == ["up", "dot", "b.c"] and out.first() == (None, 2, 3)


def test_names_that_differ_in_case_only(spark):
    df = spark.createDataFrame([(1, 2)], T.StructType([T.StructField("a", T.IntegerType()), T.StructField("A", T.IntegerType())]))
    assert apply_mapping(df, [("A", "x"), ("a", "y")]).first() == (2, 1)


def test_missing_source_types(spark):
    df = spark.createDataFrame([(1,)], "id int")
    items = [("no", "a"), ("no", "b", "NUMBER"), ("no", "c", "BOOLEAN"), ("no", "d", "DATE"), ("no", "e", "x")]
    out = apply_mapping(df, items)
    assert [f.dataType.simpleString() for f in out.schema] == ["string", "double", "boolean", "timestamp", "string"]
    assert out.first() == (None,) * 5


def test_same_target_twice(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    out = apply_mapping(df, [("a", "x"), ("b", "y"), ("c", "x")])
    assert out.columns == ["x", "y"] and out.first() == (3, 2)


def test_auto_map():
    got = auto_map(["ID", "Name", "extra"], ["id", "NAME", "name", "Id"])
    assert got == [MappingItem("ID", "id", "STRING"), MappingItem("Name", "NAME", "STRING"), MappingItem("extra", "extra", "STRING")]


def test_lenient_dialect(spark):
    df = spark.createDataFrame([("5-LOW",)], "p string")
    assert apply_mapping(df, [("p", "p", "int")], "lenient").first() == (5,)
