import json

import pytest

from tableferry import audit_specs, export_specs, run_workflow
from tableferry.plans.spec import SpecError, Workflow
from tableferry.sources.csv import read_csv


def node(i, kind, db="csv", **config):
    return {"id": i, "kind": kind, "label": i.upper(), "dbType": db, "config": config}


def edge(a, b):
    return {"from": a, "to": b}


def test_every_edge_runs(spark, path):
    spark.range(5).write.parquet(path("in"))
    spec = {
        "version": 1,
        "nodes": [
            node("s", "source", "spark", path=path("in")), node("x", "source", "csv", path=path("none")),
            node("a", "destination", path=path("a")), node("b", "destination", path=path("b")),
            node("c", "destination", path=path("c")),
        ],
        "edges": [edge("s", "a"), edge("x", "b"), edge("s", "c")],
    }
    results = run_workflow(spark, spec)
    assert [r.ok for r in results] == [True, False, True]
    assert read_csv(spark, path("a")).count() == read_csv(spark, path("c")).count() == 5


def test_edges_lead_from_sources_to_destinations(spark):
    for e in (edge("d", "s"), edge("s", "s"), edge("s", "nowhere")):
        spec = {"nodes": [node("s", "source"), node("d", "destination")], "edges": [e]}
        with pytest.raises(SpecError, match="does not join"):
            run_workflow(spark, spec)


def test_two_edges_into_one_replaced_place(spark, path):
    nodes = [node("s", "source", path="i"), node("t", "source", path="j"), node("d", "destination", path=path("o"))]
    with pytest.raises(SpecError, match="several edges would replace"):
        run_workflow(spark, {"nodes": nodes, "edges": [edge("s", "d"), edge("t", "d")]})


def test_export_form_masks_secrets():
    spec = {"nodes": [node("s", "source", "mysql", host="h", password="p")], "edges": []}
    out = Workflow.of(spec).as_dict()
    assert out["version"] == 1 and out["nodes"][0]["config"] == {"host": "h", "password": "****"}
    assert Workflow.of(spec).as_dict(masked=False)["nodes"][0]["config"]["password"] == "p"


def issues(spark, *specs):
    texts = [(i, s if isinstance(s, str) or s is None else json.dumps(s)) for i, s in enumerate(specs)]
    df = spark.createDataFrame(texts, "id int, spec string")
    return sorted((r.id, r.message, r.severity) for r in audit_specs(df, "id").collect())


def test_audit(spark):
    good = {"nodes": [node("s", "source", path="i"), node("d", "destination", path="o")], "edges": [edge("s", "d")]}
    bad = {
        "nodes": [
            node("s", "source", "mysql", host="h", user="u", password="", database="d", table="t"),
            {"id": "n", "kind": "source", "label": "N"},
            node("x", "source", "dbase"), node("d", "destination", path="o"), node("e", "destination", path="o"),
        ],
        "edges": [edge("d", "s"), edge("s", "ghost"), edge("s", "d")],
    }
    got = issues(spark, good, bad, "{", None, {"nodes": [], "edges": []})
    assert got == [
        (1, "D: edge starts here, not at a source", "error"), (1, "E: no incoming connection", "error"),
        (1, "N (source): pick a database", "error"), (1, "S: 'password' is empty", "error"),
        (1, "S: 'port' is empty", "warning"), (1, "S: edge ends here, not at a destination", "error"),
        (1, "X: Unsupported type: dbase", "error"), (1, "ghost: edge touches a node that is not there", "error"),
        (2, ": spec cannot be read", "error"), (3, ": spec cannot be read", "error"),
    ]


def test_audit_against_brute_force(spark):
    """Random wiring, checked against sets in plain Python."""
    import random

    rng, specs, want = random.Random(5), [], set()
    for i in range(60):
        nodes = [node(f"n{k}", rng.choice(["source", "destination"]), path="p") for k in range(rng.randint(1, 8))]
        edges = [edge(f"n{rng.randint(0, 9)}", f"n{rng.randint(0, 9)}") for _ in range(rng.randint(0, 8))]
        specs.append({"nodes": nodes, "edges": edges})
        ids, kinds = {n["id"] for n in nodes}, {n["id"]: n["kind"] for n in nodes}
        froms, tos = {e["from"] for e in edges}, {e["to"] for e in edges}
        for x in (froms | tos) - ids:
            want.add((i, x, "edge touches a node that is not there"))
        for x in ids:
            if kinds[x] == "destination" and x not in tos:
                want.add((i, x.upper(), "no incoming connection"))
            if kinds[x] == "destination" and x in froms:
                want.add((i, x.upper(), "edge starts here, not at a source"))
            if kinds[x] == "source" and x in tos:
                want.add((i, x.upper(), "edge ends here, not at a destination"))
    got = {(i, *m.split(": ")) for i, m, _ in issues(spark, *specs)}
    assert got == want


def test_export_and_audit_of_struct_columns(spark):
    df = spark.sql("""
        SELECT 7 AS id, array(named_struct('id', 'd', 'kind', 'destination', 'label', 'D', 'dbType', 'gcs',
               'config', map('bucket', 'b', 'key', 'k'))) AS nodes,
               CAST(array() AS ARRAY<STRUCT<`from`: STRING, `to`: STRING>>) AS edges""")
    spec = json.loads(export_specs(df, "id").first().spec)
    assert spec["version"] == 1 and spec["nodes"][0]["config"] == {"bucket": "b", "key": "****"}
    found = audit_specs(df.selectExpr("id", "named_struct('version', 1, 'nodes', nodes, 'edges', edges) AS spec"), "id")
    assert {(r.issue, r.severity) for r in found.collect()} == {
        ("'projectId' is empty", "warning"), ("'keyFilename' is empty", "warning"), ("no incoming connection", "error"),
    }
