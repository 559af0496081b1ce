"""Audit and export of a whole table of workflow specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tableferry import fixed
from tableferry.functions.casts import is_string
from tableferry.functions.redact import redact

NODE = "struct<id:string,kind:string,label:string,dbType:string,config:map<string,string>>"
SPEC = f"version int, nodes array<{NODE}>, edges array<struct<`from`:string,`to`:string>>"

ERROR, WARNING = "error", "warning"


def export_specs(specs: DataFrame, spec_id: str, masked: bool = True) -> DataFrame:
    """Workflows as JSON text (id, spec), secrets in the configs masked.

    ``specs`` has the id column, ``nodes`` and ``edges``, shaped as in ``SPEC``.
    """
    body = specs.select(F.col(spec_id).alias("id"), "nodes", "edges")
    if masked:
        body = redact(body)
    spec = F.struct(F.lit(1).alias("version"), "nodes", "edges")
    return body.select(F.col("id").alias(spec_id), F.to_json(spec).alias("spec"))


ISSUE = "struct<label:string,issue:string,severity:string>"
_DANGLING = "(missing)"


def _fields_of(db_type: Column) -> Column:
    """The fields of an endpoint type as array literals of (name, has default)."""
    out = F
    for name, fields in fixed.ENDPOINT_FIELDS.items():
        optional = fixed.OPTIONAL_FIELDS[name]
        cells = [
            F.struct(F.lit(f).alias("name"), F.lit(f in optional).alias("optional")) for f in fields
        ]
        out = out.when(db_type == name, F.array(*cells))
    return out


def _issue(label: Column, issue: Column, severity: Column) -> Column:
    return F.struct(label.alias("label"), issue.alias("issue"), severity.alias("severity"))


def _own_issues(n: Column) -> Column:
    """Issues a node shows by itself, as an array of structs."""
    label, db_type = F.coalesce(n["label"], F.lit("")), F.coalesce(n["dbType"], F.lit(""))
    fields = _fields_of(db_type)
    before, after = fixed.ISSUE_EMPTY_FIELD.split("{}")
    kind = F.coalesce(n["kind"], F.lit(""))
    no_type = _issue(
        F.concat(label, F.lit(" ("), kind, F.lit(")")), F.lit(fixed.ISSUE_NO_TYPE), F.lit(ERROR)
    )
    unknown = _issue(
        label, F.concat(F.lit(fixed.UNSUPPORTED_TYPE.format("")), db_type), F.lit(ERROR)
    )
    empty_fields = F.transform(
        F.filter(fields, lambda f: F.coalesce(n["config"][f["name"]], F.lit("")) == ""),
        lambda f: _issue(
            label,
            F.concat(F.lit(before), f["name"], F.lit(after)),
            F.when(f["optional"], WARNING).otherwise(ERROR),
        ),
    )
    known = db_type.isin(*fixed.ENDPOINT_FIELDS)
    return (
        F.when(db_type == "", F.array(no_type)).when(~known, F.array(unknown)).otherwise(empty_fields)
    )


def _ids(nodes: Column, wanted) -> Column:
    return F.transform(F.filter(nodes, wanted), lambda n: n["id"])


def audit_specs(specs: DataFrame, spec_id: str, spec: str = "spec") -> DataFrame:
    """One row per issue: (id, node_id, label, issue, severity, message).

    Every listed field counts; an empty field that has a default is a warning.
    A spec is one row, so its edges are checked against its nodes by set
    operations inside the row: one pass over the table, and no shuffle.
    """
    parsed = specs.select(F.col(spec_id).alias("sid"), _parsed(specs, spec).alias("s")).select(
        "sid",
        F.coalesce("s.nodes", F.array().cast(f"array<{NODE}>")).alias("nodes"),
        F.col("s.nodes").isNull().alias("unreadable"),
        F.array_distinct(F.coalesce("s.edges.from", F.array().cast("array<string>"))).alias("froms"),
        F.array_distinct(F.coalesce("s.edges.to", F.array().cast("array<string>"))).alias("tos"),
    )
    nodes = F.col("nodes")
    ends_only = _ids(nodes, lambda n: n["kind"] == "destination")
    not_start = _ids(nodes, lambda n: ~n["kind"].eqNullSafe(F.lit("source")))
    not_end = _ids(nodes, lambda n: ~n["kind"].eqNullSafe(F.lit("destination")))
    nothing = F.lit(None).cast("string")
    stand_in = [nothing.alias("label"), nothing.alias("dbType")]
    stand_in.append(F.lit(None).cast("map<string,string>").alias("config"))

    def missing(node_id: Column) -> Column:
        return F.struct(node_id.alias("id"), F.lit(_DANGLING).alias("kind"), *stand_in)

    dangling = F.array_except(F.array_union("froms", "tos"), F.col("nodes.id"))
    # the set operations come before the explosion: once per spec, not once per node
    checked = parsed.select(
        "sid",
        "unreadable",
        F.array_except(ends_only, F.col("tos")).alias("orphans"),
        F.array_intersect(F.col("froms"), not_start).alias("bad_starts"),
        F.array_intersect(F.col("tos"), not_end).alias("bad_ends"),
        F.concat(nodes, F.transform(dangling, missing)).alias("nodes"),
    )
    flat = checked.select(
        "sid", "unreadable", "orphans", "bad_starts", "bad_ends", F.explode_outer("nodes").alias("n")
    )
    n = F.col("n")
    label = F.coalesce(n["label"], n["id"], F.lit(""))

    def when(cond: Column, issue: str) -> Column:
        return F.when(cond, _issue(label, F.lit(issue), F.lit(ERROR)))

    is_end, present = n["kind"] == "destination", n.isNotNull() & ~n["kind"].eqNullSafe(F.lit(_DANGLING))
    wiring = F.array_compact(
        F.array(
            when(F.col("unreadable"), "spec cannot be read"),
            when(n["kind"] == _DANGLING, "edge touches a node that is not there"),
            when(is_end & F.array_contains("orphans", n["id"]), fixed.ISSUE_NO_INBOUND),
            when(
                present & F.array_contains("bad_starts", n["id"]),
                "edge starts here, not at a source",
            ),
            when(
                present & F.array_contains("bad_ends", n["id"]),
                "edge ends here, not at a destination",
            ),
        )
    )
    own = F.when(present, _own_issues(n)).otherwise(F.array().cast(f"array<{ISSUE}>"))
    return flat.select("sid", n["id"].alias("node_id"), F.inline(F.concat(own, wiring))).select(
        F.col("sid").alias(spec_id),
        "node_id",
        "label",
        "issue",
        "severity",
        F.concat("label", F.lit(": "), "issue").alias("message"),
    )


def _parsed(specs: DataFrame, spec: str) -> Column:
    field = next(f for f in specs.schema.fields if f.name == spec)
    if is_string(field.dataType):
        return F.from_json(F.col(spec), SPEC)
    if isinstance(field.dataType, T.StructType):
        return F.col(spec)
    raise TypeError(f"column {spec} holds neither JSON text nor a struct")
