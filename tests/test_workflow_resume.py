"""Workflows that are taken up again, and edges at once."""

import uuid

import pytest

from tableferry import read_endpoint, run_workflow
from tableferry.plans import workflow
from tableferry.plans.spec import Endpoint
from tableferry.sources.jdbc import connection, execute
from tableferry.sources.csv import read_csv


def node(name, kind, config):
    db = "spark" if kind == "source" else config.pop("type", "csv")
    return {"id": name, "kind": kind, "label": name, "dbType": db, "config": config}


def three_edges(spark, path, *targets):
    spark.range(20).selectExpr("id", "concat('n', id) AS name").write.mode("overwrite").parquet(path("in"))
    nodes = [node("src", "source", {"path": path("in")}), *targets]
    return {"nodes": nodes, "edges": [{"from": "src", "to": t["id"]} for t in targets]}


def database_table(spark):
    name = f"T_{uuid.uuid4().hex[:10].upper()}"
    config = {"url": "jdbc:derby:memory:tests;create=true", "table": name}
    with connection(spark, Endpoint("jdbc", config)) as conn:
        execute(conn, f'CREATE TABLE {name} ("id" BIGINT, "name" VARCHAR(20))')
    return config


@pytest.mark.parametrize("concurrent", [1, 3])
def test_only_edges_that_are_not_on_record_are_run(spark, path, monkeypatch, concurrent):
    spec = three_edges(spark, path, *(node(f"d{i}", "destination", {"path": path(f"out{i}")}) for i in range(3)))
    copied, real = [], workflow.migrate

    def killed_at_second(spark, pipeline, **kw):
        if len(copied) == 1 and "again" not in copied:
            raise KeyboardInterrupt
        copied.append(pipeline.destination.get("path"))
        return real(spark, pipeline, **kw)

    monkeypatch.setattr(workflow, "migrate", killed_at_second)
    with pytest.raises(KeyboardInterrupt):
        run_workflow(spark, spec, ledger=path("ledger"))
    copied.append("again")
    results = run_workflow(spark, spec, ledger=path("ledger"), concurrent=concurrent)
    assert [r.ok for r in results] == [True] * 3 and [r.moved for r in results] == [20] * 3
    assert copied[0] == path("out0") and sorted(copied[2:]) == [path("out1"), path("out2")]
    assert run_workflow(spark, spec, ledger=path("ledger"))[2].run_id == results[2].run_id and len(copied) == 4
    assert all(read_csv(spark, path(f"out{i}")).count() == 20 for i in range(3))
    run_workflow(spark, spec, ledger=path("ledger"), ledger_name="tomorrow")
    assert len(copied) == 7


def test_an_edge_lost_before_its_record_is_not_copied_twice(spark, path, monkeypatch):
    config = database_table(spark)
    spec = three_edges(spark, path, node("db", "destination", {"type": "jdbc", **config}))
    monkeypatch.setattr(workflow.EdgeLedger, "done", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError, match="driver lost"):
        run_workflow(spark, spec, ledger=path("ledger"))
    monkeypatch.undo()
    (result,) = run_workflow(spark, spec, ledger=path("ledger"))
    assert result.ok and read_endpoint(spark, Endpoint("jdbc", config)).count() == 20


def test_failed_edges_are_not_on_record(spark, path):
    config = {"url": "jdbc:derby:memory:tests;create=true", "table": "NO_SUCH_TABLE"}
    spec = three_edges(spark, path, node("db", "destination", {"type": "jdbc", **config}), node("d", "destination", {"path": path("out")}))
    for _ in range(2):
        results = run_workflow(spark, spec, ledger=path("ledger"), concurrent=2)
        assert [r.ok for r in results] == [False, True] and "does not exist" in results[0].message


def test_edges_into_one_place_keep_their_order(spark, path, monkeypatch):
    config = database_table(spark)
    spec = three_edges(spark, path, node("db", "destination", {"type": "jdbc", **config}), node("d", "destination", {"path": path("out")}))
    spec["nodes"].append(node("two", "source", {"path": path("in")}))
    spec["edges"].append({"from": "two", "to": "db"})
    order, real = [], workflow.migrate

    def noted(spark, pipeline, **kw):
        order.append((pipeline.destination.type, "start"))
        out = real(spark, pipeline, **kw)
        order.append((pipeline.destination.type, "end"))
        return out

    monkeypatch.setattr(workflow, "migrate", noted)
    results = run_workflow(spark, spec, concurrent=3)
    assert all(r.ok for r in results) and read_endpoint(spark, Endpoint("jdbc", config)).count() == 40
    assert [s for t, s in order if t == "jdbc"] == ["start", "end"] * 2
