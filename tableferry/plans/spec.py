"""Plain records that describe a copy: endpoints, mapping items, workflows."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from tableferry import fixed
from tableferry.functions.redact import redact_config


class SpecError(ValueError):
    """A spec that cannot be run."""


def resolve_type(name: str | None) -> str:
    """Endpoint type for a type or display name in any case; '' when there is none."""
    if not name:
        return ""
    low = name.lower()
    return fixed.ENDPOINT_ALIASES.get(low, low if low in ("spark", "jdbc") else name)


@dataclass(frozen=True)
class MappingItem:
    source: str
    to: str
    cast: str | None = None

    @classmethod
    def of(cls, item) -> MappingItem:
        if isinstance(item, MappingItem):
            return item
        if isinstance(item, dict):
            return cls(item["from"], item["to"], item.get("cast"))
        return cls(*item)


@dataclass(frozen=True)
class Endpoint:
    type: str
    config: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, value) -> Endpoint:
        if isinstance(value, Endpoint):
            return value
        value = value or {}
        return cls(resolve_type(value.get("dbType") or value.get("type")), value.get("config") or {})

    def get(self, key: str, default=None):
        """A config value; blank text counts as not given."""
        value = self.config.get(key)
        return default if value is None or value == "" else value

    def need(self, key: str):
        value = self.get(key)
        if value is None:
            raise SpecError(f"{self.type} endpoint requires '{key}'")
        return value

    def redacted(self) -> dict[str, Any]:
        return {"dbType": self.type, "config": redact_config(self.config)}


@dataclass(frozen=True)
class Pipeline:
    source: Endpoint
    destination: Endpoint
    mapping: tuple[MappingItem, ...] = ()
    truncate: bool = False
    batch_size: int | None = None
    options: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, value) -> Pipeline:
        if isinstance(value, Pipeline):
            return value
        source = Endpoint.of(value.get("source"))
        destination = Endpoint.of(value.get("destination"))
        if not source.type or not destination.type:
            raise SpecError(fixed.MISSING_ENDPOINT)
        options = dict(value.get("options") or {})
        return cls(
            source,
            destination,
            tuple(MappingItem.of(m) for m in value.get("mapping") or ()),
            bool(options.pop("truncateDest", False)),
            options.pop("batchSize", None),
            options,
        )


@dataclass(frozen=True)
class WorkflowNode:
    id: str
    kind: str
    label: str
    endpoint: Endpoint

    def endpoint_dict(self) -> dict[str, Any]:
        return {"dbType": self.endpoint.type, "config": self.endpoint.config}


@dataclass(frozen=True)
class Workflow:
    nodes: tuple[WorkflowNode, ...]
    edges: tuple[tuple[str, str], ...]

    @classmethod
    def of(cls, value) -> Workflow:
        if isinstance(value, Workflow):
            return value
        nodes = tuple(
            WorkflowNode(n["id"], n["kind"], n.get("label") or n["id"], Endpoint.of(n))
            for n in value.get("nodes") or ()
        )
        edges = tuple((e["from"], e["to"]) for e in value.get("edges") or ())
        return cls(nodes, edges)

    def links(self) -> list[tuple[WorkflowNode, WorkflowNode]]:
        """Edges as node pairs; each has to lead from a source to a destination."""
        by_id = {n.id: n for n in self.nodes}
        out = []
        for start, end in dict.fromkeys(self.edges):
            a, b = by_id.get(start), by_id.get(end)
            if a is None or b is None or a.kind != "source" or b.kind != "destination":
                raise SpecError(f"edge {start} -> {end} does not join a source to a destination")
            out.append((a, b))
        return out

    def as_dict(self, masked: bool = True) -> dict[str, Any]:
        """The export form of the workflow, secrets masked unless asked otherwise."""
        return {
            "version": 1,
            "nodes": [
                {
                    "id": n.id,
                    "kind": n.kind,
                    "label": n.label,
                    "dbType": n.endpoint.type,
                    "config": redact_config(n.endpoint.config) if masked else n.endpoint.config,
                }
                for n in self.nodes
            ],
            "edges": [{"from": a, "to": b} for a, b in self.edges],
        }
