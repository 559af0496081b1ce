"""Recurring copies from a database, on Derby inside the test process."""

import glob
import uuid

import pytest

from tableferry import incremental_copy, read_endpoint
from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sinks.jdbc import write_table
from tableferry.sources.csv import read_csv
from tableferry.sources.jdbc import connection, execute
from tableferry.streaming import marks


def table(spark, ddl, **config):
    name = f"T_{uuid.uuid4().hex[:10].upper()}"
    ep = Endpoint("jdbc", {"url": "jdbc:derby:memory:tests;create=true", "table": name, "numPartitions": 3, **config})
    with connection(spark, ep) as conn:
        execute(conn, f"CREATE TABLE {name} {ddl}")
    return ep


def add(spark, ep, *rows):
    with connection(spark, ep) as conn:
        execute(conn, f"INSERT INTO {ep.get('table')} VALUES {', '.join(rows)}")


def ids(spark, ep, start, stop):
    add(spark, ep, *(f"({i}, 's{i}')" for i in range(start, stop)))


DDL = '("id" INTEGER NOT NULL PRIMARY KEY, "s" VARCHAR(9))'


def run(spark, *args, **kw):
    query = incremental_copy(spark, *args, **kw)
    query.awaitTermination()
    return query


def test_three_runs_copy_each_row_once(spark, path):
    source, target = table(spark, DDL), table(spark, '("n" INTEGER, "s" VARCHAR(9))')
    mapping = [("id", "n"), ("s", "s")]
    checkpoint = path(f"cp-{target.get('table')}")
    upto = 0
    for more in (10, 0, 7, 25):
        ids(spark, source, upto, upto + more) if more else None
        upto += more
        query = run(spark, source, target, mapping, checkpoint=checkpoint, rows_per_batch=10)
        got = sorted((r.n, r.s) for r in read_endpoint(spark, target).collect())
        assert got == [(i, f"s{i}") for i in range(upto)]
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3  # 25 rows, ten a batch


def test_a_batch_that_is_replayed_is_applied_once(spark, path, monkeypatch):
    source, target = table(spark, DDL), table(spark, DDL)
    ids(spark, source, 0, 6)
    checkpoint, failed = path(f"cp-{target.get('table')}"), []

    def fail_once(*args, **kw):
        write_table(*args, **kw)
        if not failed:
            failed.append(True)
            raise RuntimeError("lost after the commit")

    monkeypatch.setattr("tableferry.sinks.write_table", fail_once)
    with pytest.raises(Exception, match="lost after the commit"):
        run(spark, source, target, checkpoint=checkpoint)
    ids(spark, source, 6, 9)
    run(spark, source, target, checkpoint=checkpoint)
    assert sorted(r.id for r in read_endpoint(spark, target).collect()) == list(range(9))


def test_files_of_a_replayed_batch_are_replaced(spark, path, monkeypatch):
    source = table(spark, DDL)
    ids(spark, source, 0, 6)
    target, failed, real = {"dbType": "csv", "config": {"path": path("out")}}, [], marks.publish_files

    def fail_once(*args):
        real(*args)
        if not failed:
            failed.append(True)
            raise RuntimeError("lost after the move")

    monkeypatch.setattr("tableferry.streaming.incremental.publish_files", fail_once)
    with pytest.raises(Exception, match="lost after the move"):
        run(spark, source, target, checkpoint=path("cp"))
    for more in (0, 5):
        ids(spark, source, 6, 6 + more) if more else None
        run(spark, source, target, checkpoint=path("cp"))
        assert sorted(int(r.id) for r in read_csv(spark, path("out")).collect()) == list(range(6 + more))
    assert not glob.glob(path("out") + "/_batch*")


def test_a_change_time_with_ties_as_the_cursor(spark, path):
    ddl = '("id" VARCHAR(9) NOT NULL PRIMARY KEY, "at" TIMESTAMP NOT NULL)'
    source, target = table(spark, ddl, cursor="at"), {"dbType": "spark", "config": {"path": path("out")}}
    stamp = lambda s: f"TIMESTAMP('2024-01-01 00:00:{s:02}')"
    add(spark, source, *(f"('k{i:02}', {stamp(i // 5)})" for i in range(20)))
    run(spark, source, target, checkpoint=path("cp"), rows_per_batch=3)
    add(spark, source, *(f"('z{i:02}', {stamp(3)})" for i in range(3)))  # the last second goes on
    with connection(spark, source) as conn:
        execute(conn, f"UPDATE {source.get('table')} SET \"at\" = {stamp(9)} WHERE \"id\" = 'k00'")
    run(spark, source, target, checkpoint=path("cp"), rows_per_batch=3)
    got = sorted(r.id for r in spark.read.parquet(path("out")).collect())
    assert got == sorted(["k00", *(f"k{i:02}" for i in range(20)), *(f"z{i:02}" for i in range(3))])


def test_marks_written_in_part_are_taken_up(spark, path, monkeypatch):
    source = table(spark, DDL)
    ids(spark, source, 0, 30)
    written, real = [], marks._write_mark

    def stop(spark, folder, mark):
        if len(written) == 2:
            written.append(None)
            raise RuntimeError("driver lost")
        if None not in written:
            written.append(mark)
        real(spark, folder, mark)

    monkeypatch.setattr(marks, "_write_mark", stop)
    target = {"dbType": "spark", "config": {"path": path("out")}}
    with pytest.raises(RuntimeError, match="driver lost"):
        run(spark, source, target, checkpoint=path("cp"), rows_per_batch=4)
    ids(spark, source, 30, 33)
    run(spark, source, target, checkpoint=path("cp"), rows_per_batch=4)
    assert sorted(r.id for r in spark.read.parquet(path("out")).collect()) == list(range(33))


def test_what_has_no_cursor(spark, path):
    target = {"dbType": "spark", "config": {"path": path("out")}}
    with pytest.raises(SpecError, match="needs a 'cursor'"):
        run(spark, table(spark, '("v" INTEGER)'), target, checkpoint=path("a"))
    with pytest.raises(SpecError, match="may be NULL"):
        run(spark, table(spark, '("id" INTEGER NOT NULL PRIMARY KEY, "t" INTEGER)', cursor="t"), target, checkpoint=path("b"))
    run(spark, table(spark, DDL), target, checkpoint=path("c"))  # an empty table
    with pytest.raises(RuntimeError, match="two runs"):
        marks._write_mark(spark, path("d"), {"number": 1, "rows": "", "rest": ""})
        marks._write_mark(spark, path("d"), {"number": 1, "rows": "", "rest": ""})
