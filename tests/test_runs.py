import json
import os
from datetime import datetime

from tableferry import migrate, redact, run_events, run_history, run_summaries
from tableferry.functions.redact import redact_config
from tableferry.plans.runs import SUMMARY


def csv(path):
    return {"dbType": "csv", "config": {"path": path}}


def test_missing_endpoint_is_a_result(spark):
    for spec in ({}, {"source": {"dbType": "csv"}}, {"source": {}, "destination": {"dbType": "csv"}}):
        result = migrate(spark, spec)
        assert not result.ok and result.message == "Missing source/destination"


def test_unsupported_types(spark, path):
    result = migrate(spark, {"source": {"dbType": "dbase"}, "destination": csv(path("o"))})
    assert result.message == "Unsupported source type: dbase" and result.status == "failed"
    spark.range(1).write.parquet(path("in"))
    source = {"dbType": "spark", "config": {"path": path("in")}}
    result = migrate(spark, {"source": source, "destination": {"dbType": "dbase"}})
    assert result.message == "Unsupported destination type: dbase"


def test_metrics_of_a_copy(spark, path):
    with open(path("in.csv"), "w") as f:
        f.write("n,b,d,s\n1,yes,2024-01-01,a\nx,maybe,never,b\n,,,\n5\n6,no,2024,c,d\n")
    mapping = [{"from": c, "to": c.upper(), "cast": t} for c, t in zip("nbds", ("NUMBER", "BOOLEAN", "DATE", "STRING"))]
    result = migrate(spark, {"source": csv(path("in.csv")), "destination": csv(path("out")), "mapping": mapping})
    assert result.ok, result.message
    assert (result.moved, result.malformed_rows) == (5, 2)
    assert result.losses == {"N": 1, "B": 2, "D": 2}


def test_empty_source(spark, path):
    with open(path("in.csv"), "w") as f:
        f.write("a,b\n")
    result = migrate(spark, {"source": csv(path("in.csv")), "destination": csv(path("out"))})
    assert result.ok and result.moved == 0
    open(path("none.csv"), "w").close()
    result = migrate(spark, {"source": csv(path("none.csv")), "destination": csv(path("out2"))})
    assert result.ok and result.moved == 0, result.message


def test_run_log(spark, path):
    runs = path(".runs")
    assert run_summaries(spark, runs).count() == 0 and run_events(spark, runs).count() == 0
    spark.range(3).write.parquet(path("in"))
    source = {"dbType": "spark", "config": {"path": path("in"), "password": "hunter2"}}
    ok = migrate(spark, {"source": source, "destination": csv(path("out"))}, runs_dir=runs)
    bad = migrate(spark, {"source": csv(path("none")), "destination": csv(path("o"))}, runs_dir=runs)
    assert ok.ok and not bad.ok
    # as other programs leave them: plain files, one of them broken
    os.makedirs(f"{runs}/old")
    os.makedirs(f"{runs}/broken")
    with open(f"{runs}/old/summary.json", "w") as f:
        json.dump({"runId": "old", "status": "ok", "rowsRead": 4}, f, indent=2)
    with open(f"{runs}/broken/summary.json", "w") as f:
        f.write("{")
    summaries = run_summaries(spark, runs)
    got = {r.runId: (r.status, r.rowsRead, r.rowsWritten) for r in summaries.collect()}
    assert got == {ok.run_id: ("succeeded", 3, 3), bad.run_id: ("failed", None, None), "old": ("ok", 4, None)}
    shown = run_history(summaries).collect()
    assert shown[-1].runId == "old" and shown[-1].rows == "4" and shown[-1].started == "-"
    assert shown[0].started >= shown[1].started
    events = run_events(spark, runs, ok.run_id, fields="event string, rows long").collect()
    assert [(e.event, e.rows) for e in sorted(events, key=lambda e: e.ts)] == [("started", None), ("succeeded", 3)]
    text = "".join(r.value for r in spark.read.text(f"{runs}/{ok.run_id}/run.jsonl").collect())
    assert "hunter2" not in text and "****" in text


def test_history_shows(spark):
    rows = [
        ("a", "ok", None, None, 1, 2, 1499, "f"), ("b", "ok", "2024-02", None, 3, None, 1500, None),
        ("c", "ok", "2024-03", None, None, None, 0, None), ("d", "ok", "2024-01", None, 0, 0, None, None),
        ("e", "ok", "2024-04", None, 0, 0, 499, None),
    ]
    got = [tuple(r) for r in run_history(spark.createDataFrame(rows, SUMMARY)).collect()]
    assert got == [
        ("e", "ok", "0", "0s", "2024-04", "-"), ("c", "ok", "-", "-", "2024-03", "-"),
        ("b", "ok", "3", "2s", "2024-02", "-"), ("d", "ok", "0", "-", "2024-01", "-"),
        ("a", "ok", "2", "1s", "-", "f"),
    ]


def test_redaction_of_frames(spark):
    df = spark.sql("""
        SELECT CAST(NULL AS INT) AS monkeyId, 1 AS id, timestamp '2024-01-01' AS at,
               named_struct('Password', 1, 'in', array(named_struct('secretX', 2, 'y', 3))) AS body,
               CAST(NULL AS STRUCT<k: INT, password: STRING>) AS gone,
               map('apiKey', 'x', 'b', 'y') AS texts, map('key', 1, 'n', 2) AS numbers,
               array(map('secret', 's', 'z', 'z')) AS list""")
    row = redact(df).first()
    assert row.monkeyId == "****" and row.id == 1 and row.at == datetime(2024, 1, 1)
    assert row.body.Password == "****" and row.body["in"][0].secretX == "****" and row.body["in"][0].y == 3
    assert row.gone is None
    assert row.texts == {"apiKey": "****", "b": "y"} and row.numbers == {"key": "****", "n": "2"}
    assert row.list == [{"secret": "****", "z": "z"}]
    assert redact(df, pattern="^id$").first().id == "****"


def test_redaction_of_configs():
    config = {"user": "u", "PASSWORD": None, "nested": [{"accountKey": "k", "x": 1}]}
    assert redact_config(config) == {"user": "u", "PASSWORD": "****", "nested": [{"accountKey": "****", "x": 1}]}
