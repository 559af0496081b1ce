"""CSV with line breaks in cells, split over tasks, against Spark's reader of whole files."""

import os
import random

import pytest

from tableferry import read_endpoint
from tableferry.sinks.csv import write_csv
from tableferry.sources.csv import read_csv
from tableferry.sources.records import split_records

SF = "/root/testdata/sf0.001"


def put(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)
    return path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture()
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["documents", "pages", "conversations"])
def test_given_tables(spark, path, name):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    write_csv(df.coalesce(1), path(name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000b")
    try:
        lines = spark.read.text(path(name))
        assert lines.rdd.getNumPartitions() > 4
        split = rows(read_csv(spark, path(name), multiline="split"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert split == rows(read_csv(spark, path(name))) and len(split) == df.count()


@pytest.mark.parametrize("seed", [0, 1, 3])
def test_random_cells_over_tiny_splits(spark, path, small_splits, seed):
    rng = random.Random(seed)
    pieces = ["a", "é😀", ",", "\n", "\n\n", "\r\n", '"', '""', " ", "x" * 300, "\n" * 40, "\\"]

    def cell():
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(5)))
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n\r') or rng.random() < 0.2 else text

    end = rng.choice(["\n", "\r\n"])
    for i in range(3):
        lines = [",".join(cell() for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(40)]
        one = '"one\nline"' if end == "\n" else "one"
        header = f'\ufeff{one},b,"c"' if i == 1 else f"{one},b,c"
        text = end.join([header, *lines]) + (end if rng.random() < 0.5 else "")
        os.makedirs(path("in"), exist_ok=True)
        put(path(f"in/{i}.csv"), text)
    # the reader of whole files turns \r\n inside cells into \n where lines end so; over splits cells stay as they are
    same = lambda v: v.replace("\r\n", "\n") if isinstance(v, str) and end == "\r\n" else v
    for options in ({}, {"blanks": "null"}, {"malformed_column": "bad"}):
        split = read_csv(spark, path("in"), multiline="split", **options).collect()
        assert sorted((tuple(map(same, r)) for r in split), key=repr) == rows(read_csv(spark, path("in"), **options))


def test_a_cell_over_many_splits(spark, path, small_splits):
    long = "\n".join(f"line {i}" for i in range(2_000))
    p = put(path("x.csv"), f'a,b\n1,"{long}"\n2,"{long}""\n"\n3,end\n')
    got = dict(rows(read_csv(spark, p, multiline="split")))
    assert got == {"1": long, "2": long + '"\n', "3": "end"}
    assert spark.read.text(p).rdd.getNumPartitions() > 20


def test_edges(spark, path, small_splits):
    assert read_csv(spark, put(path("h.csv"), "a,b\n"), multiline="split").count() == 0
    assert read_csv(spark, put(path("e.csv"), ""), multiline="split").columns == []
    assert rows(read_csv(spark, put(path("b.csv"), "\n\na,b\n\n1,2\n\r\n"), multiline="split")) == [("1", "2")]
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, put(path("s.csv"), "a,b\n1\n"), multiline="split", strict_rows=True).collect()
    with pytest.raises(ValueError, match="no streams"):
        read_csv(spark, path("b.csv"), multiline="split", stream=True)
    ep = {"dbType": "csv", "config": {"path": path("b.csv"), "multiline": "split"}}
    assert rows(read_endpoint(spark, ep)) == [("1", "2")]


def test_one_record_lines_are_not_brought_together(spark, path):
    """Only lines of broken records meet in an aggregate."""
    put(path("x.csv"), "a,b\n" + "1,2\n" * 500 + '3,"x\ny"\n')
    df = split_records(spark, [path("x.csv")])
    assert df.count() == 501
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_one_header_for_many_files(spark, path):
    write_csv(spark.range(400).selectExpr("id", "id * 2 AS b").repartition(200), path("in"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    df = read_csv(spark, path("in"), headers="first")
    assert len(tracker.getJobIdsForGroup(None)) - before <= 2  # one header
    assert rows(df) == rows(read_csv(spark, path("in"))) and df.count() == 400
    put(path("in/other.csv"), "b,id\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, path("in"), headers="first", multiline=False).collect()
    assert read_csv(spark, path("in")).count() == 401
    with pytest.raises(ValueError, match="names that differ"):
        read_csv(spark, put(path("twice.csv"), "a,A\n1,2\n"), headers="first")


def test_the_query_passes_its_table_through_no_single_task(spark):
    from tableferry.queries import QUERIES

    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        sf = "/root/testdata/sf0.01"
        parts = spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()
        out = QUERIES["csv_split_multiline"](spark, sf)
        assert parts > 1 and len(out.inputFiles()) > 1
        assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
