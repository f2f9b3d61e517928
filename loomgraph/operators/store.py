"""Writes to the graph. Every write appends rows or mutations; the current state is folded from them."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..sources.schema import ANNOTATIONS, EDGES, NODES, TIERS
from ..sources.session import checkpoint
from .filters import by_id, find
from .joins import annotations_left


def stamp(after: str | None = None) -> str:
    """Now in ISO form, at least a millisecond after another time."""
    now = datetime.now(UTC)
    if after:
        now = max(now, datetime.fromisoformat(after.replace("Z", "+00:00")) + timedelta(milliseconds=1))
    return now.isoformat(timespec="milliseconds").replace("+00:00", "Z")

#: Writes after which the state is checkpointed, so that its plan stays short.
FOLD_AFTER = 32


class Store:
    """Nodes, edges and annotations as DataFrames; every write gives a new state and keeps the events it makes."""

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.spark = spark
        self.nodes = nodes if nodes is not None else spark.createDataFrame([], NODES)
        self.edges = edges if edges is not None else spark.createDataFrame([], EDGES)
        self.annotations = spark.createDataFrame([], ANNOTATIONS)
        self.events: list[dict] = []
        self._writes = {"nodes": 0, "edges": 0, "annotations": 0}

    def _set(self, **tables: DataFrame) -> None:
        for name, rows in tables.items():
            self._writes[name] += 1
            setattr(self, name, checkpoint(rows) if self._writes[name] % FOLD_AFTER == 0 else rows)

    def get(self, node: str) -> dict | None:
        row = by_id(self.nodes, node).first()
        return row.asDict() if row else None

    def create_node(self, kind: str, name: str, qualified_name: str | None = None, file_path: str | None = None, data: dict | None = None, tier: str = "personal") -> str:
        node, now = str(uuid.uuid4()), stamp()
        self._set(nodes=self.nodes.unionByName(self.spark.createDataFrame([(node, kind, name, qualified_name, file_path, json.dumps(data or {}), tier, now, now)], NODES)))
        return node

    def update_node(self, node: str, **fields: str) -> None:
        old = self.get(node)
        if old is None:
            raise KeyError(f"Node not found: {node}")
        new = old | fields | {"updated_at": stamp(old["updated_at"])}
        row = self.spark.createDataFrame([tuple(new[c] for c in self.nodes.columns)], NODES)
        self._set(nodes=self.nodes.where(F.col("id") != node).unionByName(row))

    def delete_node(self, node: str) -> None:
        """Edges of the node go with it, and annotations by it or of those edges."""
        self._set(nodes=self.nodes.where(F.col("id") != node), edges=self.edges.where((F.col("source_id") != node) & (F.col("target_id") != node)))
        self._set(annotations=annotations_left(self.annotations, self.nodes, self.edges))

    def create_edge(self, source: str, target: str, relation: str, data: dict | None = None) -> str:
        if self.nodes.where(F.col("id").isin(source, target)).count() < len({source, target}):
            raise ValueError("both ends of an edge must exist")
        edge = str(uuid.uuid4())
        self._set(edges=self.edges.unionByName(self.spark.createDataFrame([(edge, source, target, relation, json.dumps(data or {}), stamp())], EDGES)))
        return edge

    def delete_edge(self, edge: str) -> None:
        self._set(edges=self.edges.where(F.col("id") != edge), annotations=self.annotations.where(F.col("edge_id") != edge))

    def create_annotation(self, decision: str, edge: str) -> str:
        """A decision explains an edge; both must exist."""
        if self.get(decision) is None or by_id(self.edges, edge).isEmpty():
            raise ValueError("an annotation needs its decision and its edge")
        made = str(uuid.uuid4())
        self._set(annotations=self.annotations.unionByName(self.spark.createDataFrame([(made, decision, edge, stamp())], ANNOTATIONS)))
        return made

    def delete_annotation(self, annotation: str) -> None:
        self._set(annotations=self.annotations.where(F.col("id") != annotation))

    def find_annotations(self, decision: str | None = None, edge: str | None = None) -> DataFrame:
        return find(self.annotations, decision_id=decision, edge_id=edge)

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "edges": self.edges, "annotations": self.annotations}

    def sql(self, text: str, **values) -> DataFrame:
        """Any query over the tables, named {nodes}, {edges} and {annotations} in the text; :name stands for a value."""
        return self.spark.sql(text, args=values, **{name: rows for name, rows in self.tables().items() if "{" + name + "}" in text})

    def target(self, given: str) -> str:
        """A node's id as it is; else the node of that path; else a new path node."""
        if self.get(given):
            return given
        found = self.nodes.where((F.col("kind") == "path") & (F.col("file_path") == given)).orderBy("id").first()
        if found:
            return found.id
        name = self.spark.range(1).select(base_name(F.lit(given))).first()[0]
        return self.create_node("path", name, file_path=given, tier="public")

    def create_decision(self, title: str, description: str, rationale: str, alternatives: list | None = None, governs: list[str] = (), references: list[str] = ()) -> str:
        """References are checked before anything is written."""
        missing = [r for r in references if not self.get(r)]
        if missing:
            raise ValueError(f"references do not exist: {missing}")
        decision = self.create_node("decision", title, data={"description": description, "rationale": rationale, "alternatives": alternatives or [], "status": "active"})
        governed = [self.target(g) for g in governs]
        for relation, ends in (("GOVERNS", governed), ("REFERENCES", references)):
            for end in ends:
                self.create_edge(decision, end, relation)
        self._emit("decision.created", decision_id=decision, title=title, rationale=rationale, governed_file_ids=governed, tags=[])
        return decision

    def update_decision(self, decision: str, **changes) -> list[str]:
        """The changed fields. A decision that another one supersedes gets an edge from that, once."""
        old = self._decision(decision)
        data = json.loads(old["data"])
        before = {"title": old["name"], **{k: data.get(k) for k in ("description", "rationale", "status")}}
        changed = [k for k, v in changes.items() if k in ("alternatives", "superseded_by") or before.get(k) != v]
        data |= {k: v for k, v in changes.items() if k != "title"}
        self.update_node(decision, name=changes.get("title", old["name"]), data=json.dumps(data))
        newer = changes.get("superseded_by")
        if newer:
            if self.edges.where((F.col("source_id") == newer) & (F.col("target_id") == decision) & (F.col("relation") == "SUPERSEDES")).isEmpty():
                self.create_edge(newer, decision, "SUPERSEDES")
            self._emit("decision.superseded", old_id=decision, new_id=newer, reason="")
        else:
            self._emit("decision.updated", decision_id=decision, changed_fields=changed)
        return changed

    def delete_decision(self, decision: str) -> None:
        title = self._decision(decision)["name"]
        self.delete_node(decision)
        self._emit("decision.deleted", decision_id=decision, title=title)

    def link_decision(self, decision: str, target: str, relation: str = "GOVERNS") -> None:
        self.create_edge(decision, self.target(target) if relation == "GOVERNS" else target, relation)

    def promote(self, decision: str, tier: str) -> None:
        if tier not in TIERS[1:]:
            raise ValueError("a decision is promoted to team or public")
        before = self._decision(decision)["tier"]
        self.update_node(decision, tier=tier)
        self._emit("decision.promoted", decision_id=decision, from_tier=before, to_tier=tier)

    def _decision(self, decision: str) -> dict:
        row = self.get(decision)
        if row is None or row["kind"] != "decision":
            raise KeyError(f"Decision not found: {decision}")
        return row

    def _emit(self, kind: str, **payload) -> None:
        now = datetime.now(UTC)
        self.events.append({"id": f"{int(now.timestamp() * 1000):013d}-{len(self.events):08d}", "kind": kind, "actor": "user", "created_at": int(now.timestamp() * 1000), "project_id": "", "payload": json.dumps(payload)})
