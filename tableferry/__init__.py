"""Copy tables between files, object stores and databases with Spark."""

from tableferry.functions.casts import cast_lenient, cast_strict, js_number, js_text
from tableferry.functions.redact import redact
from tableferry.operators.audit import audit_specs, export_specs
from tableferry.operators.infer import infer_all_rows, infer_first_row
from tableferry.operators.mapping import apply_mapping, auto_map
from tableferry.plans.migrate import discover, migrate
from tableferry.plans.runs import run_events, run_history, run_summaries
from tableferry.plans.spec import Endpoint, MappingItem, Pipeline, Workflow
from tableferry.plans.workflow import run_workflow
from tableferry.sinks import write_endpoint
from tableferry.sources import read_endpoint
from tableferry.streaming.incremental import incremental_copy

__all__ = [
    "Endpoint",
    "MappingItem",
    "Pipeline",
    "Workflow",
    "apply_mapping",
    "audit_specs",
    "auto_map",
    "cast_lenient",
    "cast_strict",
    "discover",
    "export_specs",
    "incremental_copy",
    "infer_all_rows",
    "infer_first_row",
    "js_number",
    "js_text",
    "migrate",
    "read_endpoint",
    "redact",
    "run_events",
    "run_history",
    "run_summaries",
    "run_workflow",
    "write_endpoint",
]
