import glob
import os
import uuid

import pytest

from tableferry import incremental_copy, read_endpoint
from tableferry.plans.spec import Endpoint
from tableferry.streaming.incremental import ledger_id
from tableferry.sinks.csv import write_csv
from tableferry.sinks.jdbc import write_table
from tableferry.sources.csv import read_csv
from tableferry.sources.jdbc import connection, execute

MAPPING = [{"from": "id", "to": "n", "cast": "NUMBER"}, {"from": "s", "to": "s"}]


def frame(spark, start, end):
    return spark.range(start, end).selectExpr("id", "concat('a,', id) AS s")


def run(*args, **kw):
    incremental_copy(*args, **kw).awaitTermination()


def test_only_new_files_are_copied(spark, path):
    source = {"dbType": "spark", "config": {"path": path("in")}}
    target = {"dbType": "csv", "config": {"path": path("out")}}
    frame(spark, 0, 5).write.parquet(path("in"))
    for _ in range(2):
        run(spark, source, target, MAPPING, checkpoint=path("cp"))
        assert read_csv(spark, path("out")).count() == 5
    frame(spark, 5, 9).write.mode("append").parquet(path("in"))
    run(spark, source, target, MAPPING, checkpoint=path("cp"))
    got = sorted(tuple(r) for r in read_csv(spark, path("out")).collect())
    assert got == [(str(i), f"a,{i}") for i in range(9)]


def test_csv_source_and_batches_of_files(spark, path):
    write_csv(frame(spark, 0, 8).repartition(4), path("in"))
    source, target = {"dbType": "csv", "config": {"path": path("in")}}, {"dbType": "spark", "config": {"path": path("out")}}
    query = incremental_copy(spark, source, target, MAPPING, checkpoint=path("cp"), files_per_trigger=1)
    query.awaitTermination()
    assert len(query.recentProgress) >= 4
    assert sorted(r.n for r in spark.read.parquet(path("out")).collect()) == [float(i) for i in range(8)]


def test_database_batches_are_applied_once(spark, path, monkeypatch):
    """A batch that fails after it was published is replayed, and skipped."""
    name = f"T_{uuid.uuid4().hex[:10].upper()}"
    ep = Endpoint("jdbc", {"url": "jdbc:derby:memory:tests;create=true", "table": name})
    with connection(spark, ep) as conn:
        execute(conn, f'CREATE TABLE {name} ("n" DOUBLE, "s" VARCHAR(20))')
    frame(spark, 0, 6).write.parquet(path("in"))
    source = {"dbType": "spark", "config": {"path": path("in")}}
    checkpoint = path(f"cp-{name}")
    failed = []

    def fail_once(*args, **kw):
        write_table(*args, **kw)
        if not failed:
            failed.append(True)
            raise RuntimeError("lost after the commit")

    monkeypatch.setattr("tableferry.sinks.write_table", fail_once)
    try:
        run(spark, source, ep, MAPPING, checkpoint=checkpoint)
    except Exception as e:
        assert "lost after the commit" in str(e)
    run(spark, source, ep, MAPPING, checkpoint=checkpoint)
    assert failed and read_endpoint(spark, ep).count() == 6


def test_an_empty_folder_can_be_watched(spark, path):
    os.makedirs(path("in"))
    source = {"dbType": "csv", "config": {"path": path("in"), "columns": ["id", "s"]}}
    target = {"dbType": "spark", "config": {"path": path("out")}}
    run(spark, source, target, MAPPING, checkpoint=path("cp"))
    write_csv(frame(spark, 0, 3), path("new"))
    for i, part in enumerate(sorted(glob.glob(path("new") + "/part-*"))):
        os.rename(part, path(f"in/{i}.csv"))
    run(spark, source, target, MAPPING, checkpoint=path("cp"))
    assert sorted(r.n for r in spark.read.parquet(path("out")).collect()) == [0.0, 1.0, 2.0]
    with open(path("in/9.csv"), "w") as f:
        f.write("s,id\na,9\n")
    with pytest.raises(Exception, match="9.csv"):
        run(spark, source, target, MAPPING, checkpoint=path("cp"))
    with pytest.raises(ValueError, match="name the columns"):
        read_csv(spark, path("nothing"), stream=True)


def test_ledger_ids_differ_by_whole_checkpoint_and_target():
    one = Endpoint("postgres", {"host": "h", "database": "d", "table": "t"})
    two = Endpoint("postgres", {"host": "h", "database": "d", "table": "u"})
    ids = {ledger_id("file:/a/checkpoint", one), ledger_id("file:/b/checkpoint", one), ledger_id("file:/a/checkpoint", two)}
    assert len(ids) == 3 and ledger_id("file:/a/checkpoint/", one) in ids and all(len(i) <= 200 for i in ids)
