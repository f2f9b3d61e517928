"""The eighteen operations of the service, answering with text that starts with ``No results:`` or ``ERROR`` where there is none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import denormalize_name, normalize_name
from ..sources.tables import text_lines
from . import filters, fulltext, joins, traverse
from .store import Store

REASONS = ("project_not_found", "binary_failed", "malformed_input", "internal_error", "fs_error")


@dataclass(frozen=True)
class Answer:
    text: str
    is_error: bool = False


def ok(lines: list[str], nothing: str) -> Answer:
    return Answer("\n".join(lines) if lines else f"No results: {nothing}")


def error(reason: str, message: str) -> Answer:
    if reason not in REASONS:
        raise ValueError(reason)
    return Answer(f"ERROR reason={reason}: {message}", True)


class Service:
    """Decisions in a store, and one project of a code index (projects, nodes, edges) if attached."""

    def __init__(self, store: Store, index: dict[str, DataFrame] | None = None, project: str | None = None):
        self.store, self.index, self.project = store, index, project

    # decisions

    def create_decision(self, title: str, description: str, rationale: str, alternatives: list | None = None, governs: list[str] = (), references: list[str] = ()) -> Answer:
        try:
            return Answer(self.store.create_decision(title, description, rationale, alternatives, governs, references))
        except ValueError as e:
            return error("malformed_input", str(e))

    def _on(self, act, decision: str, done: str) -> Answer:
        try:
            act()
            return Answer(done)
        except KeyError:
            return ok([], f"no decision {decision}")
        except ValueError as e:
            return error("malformed_input", str(e))

    def update_decision(self, decision: str, **changes) -> Answer:
        return self._on(lambda: self.store.update_decision(decision, **changes), decision, f"updated {decision}")

    def delete_decision(self, decision: str) -> Answer:
        return self._on(lambda: self.store.delete_decision(decision), decision, f"deleted {decision}")

    def promote_decision(self, decision: str, tier: str) -> Answer:
        return self._on(lambda: self.store.promote(decision, tier), decision, f"promoted {decision} to {tier}")

    def link_decision(self, decision: str, target: str, relation: str = "GOVERNS") -> Answer:
        return self._on(lambda: self.store.link_decision(decision, target, relation), decision, f"{decision} {relation} {target}")

    def get_decision(self, decision: str) -> Answer:
        row = joins.with_links(self.store.nodes, self.store.edges, decision).first()
        if row is None:
            return ok([], f"no decision {decision}")
        named = lambda part, ends: [f"{part} {e.name} ({e.target_id})" for e in ends or []]
        return ok([f"{row.name} [{row.tier}]", *named("governs", row.governs), *named("references", row.references)], "")

    def _docs(self) -> DataFrame:
        data = F.from_json("data", "description string, rationale string")
        return self.store.nodes.where("kind = 'decision'").select(F.col("id").alias("node_id"), F.col("name").alias("title"), data.description.alias("description"), data.rationale.alias("rationale"))

    def search_decisions(self, query: str, scope: str | None = None) -> Answer:
        try:
            found = fulltext.search_decisions(self._docs(), self.store.nodes, self.store.edges, query, scope).collect()
        except ValueError as e:
            return error("internal_error", str(e))
        return ok([f"{r.name} ({r.id})" for r in found], f"no decision matches {query!r}")

    def why_was_this_built(self, qualified_name: str) -> Answer:
        target = self.store.spark.createDataFrame([(qualified_name,)], "target string")
        found = traverse.why_built(target, self.store.nodes, self.store.edges)
        rows = found.join(self.store.nodes.select(F.col("id").alias("decision_id"), "name"), "decision_id").orderBy("name", "decision_id").collect()
        return ok([f"{r.name} ({r.decision_id})" for r in rows], f"nothing governs {qualified_name}")

    # code index

    def _own(self, name: str) -> DataFrame:
        return self.index[name].where(F.col("project") == self.project)

    def _missing(self) -> Answer | None:
        return None if self.index and self.project else error("project_not_found", "no indexed project is attached")

    def _line(self) -> F.Column:
        name = denormalize_name("qualified_name", "file_path")
        return F.format_string("%s %s (%s:%d-%d)", "label", name, "file_path", "start_line", "end_line")

    def search_graph(self, name_pattern: str | None = None, label: str | None = None, qn_pattern: str | None = None) -> Answer:
        if missing := self._missing():
            return missing
        if qn_pattern:
            qn_pattern = self.store.spark.range(1).select(normalize_name(F.lit(qn_pattern), F.lit(self.project))).first()[0]
        found = filters.search_symbols(self._own("nodes"), name_pattern, label, qn_pattern).select("id", self._line().alias("line"))
        return ok([r.line for r in found.collect()], "no symbol matches")

    def trace_path(self, function_name: str, mode: str = "calls", max_depth: int = 3) -> Answer:
        if missing := self._missing():
            return missing
        if mode not in ("calls", "callers") or not 1 <= max_depth <= 10:
            return error("malformed_input", "mode is calls or callers and max_depth from 1 to 10")
        text = lambda c: F.col(c).cast("string").alias(c)
        nodes = self._own("nodes").withColumn("id", F.col("id").cast("string"))
        edges = self._own("edges").select(text("source_id"), text("target_id"), F.col("type").alias("relation"))
        found = traverse.trace(nodes, edges, function_name, mode, max_depth).join(nodes.drop("name"), "id")
        lines = found.orderBy("depth", "name", "id").select(F.format_string("%s [d=%d]", self._line(), "depth").alias("line"))
        return ok([r.line for r in lines.collect()], f"nothing is reached from {function_name}")

    def get_code_snippet(self, qualified_name: str, files: DataFrame) -> Answer:
        """files: (file_path, text) of the project's sources."""
        if missing := self._missing():
            return missing
        name = self.store.spark.range(1).select(normalize_name(F.lit(qualified_name), F.lit(self.project))).first()[0]
        symbol = filters.symbol_by_name(self._own("nodes"), name).first()
        if symbol is None:
            return ok([], f"no symbol {qualified_name}")
        lines = filters.snippet(text_lines(files.where(F.col("file_path") == symbol.file_path), "file_path"), symbol.start_line, symbol.end_line)
        return ok([r.text for r in lines.orderBy("line").collect()], f"no source of {symbol.file_path}")

    def get_graph_schema(self) -> Answer:
        if missing := self._missing():
            return missing
        counts = filters.schema_counts(self._own("nodes"), self._own("edges").withColumnRenamed("type", "relation"))
        return ok([f"{r.part} {r.name}: {r['count']}" for r in counts.collect()], "the project is empty")

    def list_projects(self) -> Answer:
        if not self.index:
            return error("internal_error", "no index is attached")
        return ok([f"{r.name} {r.root_path} ({r.indexed_at})" for r in self.index["projects"].orderBy("name").collect()], "no project")

    def index_status(self, path: str) -> Answer:
        if not self.index:
            return error("internal_error", "no index is attached")
        row = self.index["projects"].where(F.col("root_path") == path).orderBy("name").first()
        return ok([f"{row.name} indexed at {row.indexed_at}"] if row else [], f"{path} is not indexed")

    def search_code(self, pattern: str, files: DataFrame) -> Answer:
        """Lines that a pattern finds with the innermost symbol around each; the first fifty if there is an index."""
        found = filters.grep(text_lines(files, "file_path"), pattern).orderBy("file_path", "line")
        if not self.index:
            return ok([f"{r.file_path}:{r.line}:{r.text}" for r in found.collect()], f"no line matches {pattern!r}")
        spans = self._own("nodes").select("file_path", F.col("name").alias("sym"), "start_line", "end_line")
        told = joins.enclosing_symbols(found.limit(50), spans, "file_path").orderBy("file_path", "line").collect()
        return ok([f"{r.file_path}:{r.line}:{r.text}" + (f" [{r.sym}]" if r.sym else "") for r in told], f"no line matches {pattern!r}")

    def index_repository(self, path: str | None = None) -> Answer:
        return error("binary_failed", "the indexer is a program of its own")

    def detect_changes(self, path: str | None = None) -> Answer:
        return error("binary_failed", "the indexer is a program of its own")

    def delete_project(self, project: str) -> Answer:
        if not self.index:
            return error("project_not_found", "no index is attached")
        key = {"projects": "name", "nodes": "project", "edges": "project"}
        self.index = {name: df.where(F.col(key[name]) != project) for name, df in self.index.items()}
        return Answer(f"deleted {project}")
