"""A copy has to stay one narrow stage of generated code over a pruned scan."""

import re

import pytest

from tableferry import apply_mapping, redact
from tableferry.operators.audit import audit_specs
from tableferry.operators.infer import infer_all_rows
from tableferry.plans.runs import Measured
from tableferry.queries import order_specs
from tableferry.operators.audit import export_specs
from tableferry.sinks.csv import as_text, write_csv
from tableferry.sources.csv import read_csv

SF = "/root/testdata/sf0.001"
TAGS = ["STRING", "NUMBER", "BOOLEAN", "DATE"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


def test_every_cast_is_native_and_narrow(lineitem):
    for tag in TAGS:
        mapping = [(c, c, tag) for c in lineitem.columns]
        for dialect in ("strict", "lenient"):
            text = plan(apply_mapping(lineitem, mapping, dialect))
            assert "Exchange" not in text and "Python" not in text and "*(1) Project" in text


def test_text_casts_are_native(lineitem):
    text = as_text(lineitem)
    for tag in TAGS:
        p = plan(apply_mapping(text, [(c, c, tag) for c in text.columns]))
        assert "Exchange" not in p and "Python" not in p and "*(1) Project" in p


def test_unmapped_columns_are_not_read(lineitem):
    p = plan(apply_mapping(lineitem, [("l_tax", "t", "STRING"), ("nope", "n")]))
    assert re.search(r"ReadSchema: struct<l_tax:double>", p)


def test_filters_reach_the_scan(lineitem):
    p = plan(apply_mapping(lineitem, [("l_tax", "t"), ("l_orderkey", "k")]).where("k = 7"))
    assert "EqualTo(l_orderkey,7)" in p


def test_metrics_add_no_stage(lineitem):
    p = plan(Measured(lineitem, [("l_returnflag", "f", "BOOLEAN"), ("l_tax", "t")]).frame)
    assert "CollectMetrics" in p and "Exchange" not in p
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in p


def test_redaction_is_narrow(lineitem):
    p = plan(redact(lineitem))
    assert "Exchange" not in p and "l_orderkey:bigint" not in p


def test_inference_is_one_partial_aggregate(lineitem):
    p = plan(infer_all_rows(lineitem))
    assert p.count("FileScan") == 1 and p.count("SinglePartition") <= 1 and "partial_min" in p


def test_audit_is_one_narrow_pass(spark):
    p = plan(audit_specs(export_specs(order_specs(spark, SF), "o_orderkey"), "o_orderkey"))
    assert p.count("FileScan") == 1 and "Exchange" not in p and "Join" not in p


def test_csv_scan_is_pruned_unless_short_rows_matter(spark, lineitem, tmp_path):
    write_csv(lineitem, str(tmp_path / "x"))
    p = plan(read_csv(spark, str(tmp_path / "x"), blanks="null", multiline=False).select("l_tax"))
    assert re.search(r"ReadSchema: struct<c7:string>", p)
