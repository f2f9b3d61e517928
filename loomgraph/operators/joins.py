"""Joins over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import checkpoint
from .filters import find


def connected(nodes: DataFrame, edges: DataFrame, node: str, relation: str | None = None, direction: str = "both") -> DataFrame:
    """Neighbours of a node, a row for each edge; a loop comes twice. Edges to missing nodes give none."""
    edges = find(edges, relation=relation)
    out = edges.where(F.col("source_id") == node).select(F.col("target_id").alias("id"), "relation", F.lit("out").alias("direction"))
    into = edges.where(F.col("target_id") == node).select(F.col("source_id").alias("id"), "relation", F.lit("in").alias("direction"))
    return {"both": out.unionByName(into), "out": out, "in": into}[direction].join(nodes.select("id", "name", "kind"), "id")


def decision_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(decision_id, relation, target_id, name) of what decisions govern and refer to."""
    decisions = nodes.where("kind = 'decision'").select(F.col("id").alias("decision_id"))
    linked = edges.where(F.col("relation").isin("GOVERNS", "REFERENCES")).withColumnsRenamed({"source_id": "decision_id"})
    targets = nodes.select(F.col("id").alias("target_id"), "name")
    return linked.join(decisions, "decision_id").join(targets, "target_id").select("decision_id", "relation", "target_id", "name")


def with_links(nodes: DataFrame, edges: DataFrame, decision: str) -> DataFrame:
    """One decision with what it governs and refers to as lists."""
    links = decision_links(nodes.where(F.col("id") == decision).unionByName(nodes.where("kind <> 'decision'")), edges.where(F.col("source_id") == decision))
    of = lambda r: F.array_sort(F.collect_list(F.when(F.col("relation") == r, F.struct("target_id", "name"))))
    lists = links.groupBy("decision_id").agg(of("GOVERNS").alias("governs"), of("REFERENCES").alias("references"))
    return nodes.where((F.col("id") == decision) & (F.col("kind") == "decision")).join(lists, F.col("id") == F.col("decision_id"), "left").drop("decision_id")


def governed_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, decision_id) of every governed node: its path, or its name without one; a row for each time that a decision governs it."""
    decisions = nodes.where("kind = 'decision'").select(F.col("id").alias("source_id"))
    governed = edges.where("relation = 'GOVERNS'").join(decisions, "source_id")
    named = nodes.select(F.col("id").alias("target_id"), F.coalesce("file_path", "name").alias("file"))
    return governed.join(named, "target_id").select("file", F.col("source_id").alias("decision_id"))


def governs_scope(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, scope: str) -> DataFrame:
    """Decisions that govern a node of this name or path, or of a path that the scope starts with."""
    own = (F.col("qualified_name") == scope) | (F.col("file_path") == scope) | (F.startswith(F.lit(scope), F.col("file_path")) & (F.col("file_path") != ""))
    targets = nodes.where(F.coalesce(own, F.lit(False))).select(F.col("id").alias("target_id"))
    governing = edges.where("relation = 'GOVERNS'").join(targets, "target_id", "left_semi").select(F.col("source_id").alias("id"))
    return decisions.join(governing, "id", "left_semi")


#: Levels of the bins below, enough for any number of a line.
LEVELS = 31


def _pieces(spans: DataFrame) -> DataFrame:
    """spans with the (level, bin) pairs whose bins, of 2^level lines, make up a span exactly: two to a level at most."""
    low, high = "-shiftright(-start_line, k)", "shiftright(end_line + 1, k)"  # a bin's number rounded up, and down
    each = f"filter(array(if({low} % 2 <> 0, {low}, null), if({high} % 2 <> 0, {high} - 1, null)), b -> b is not null)"
    cut = f"flatten(transform(sequence(0, {LEVELS - 1}), k -> if({low} < {high}, transform({each}, b -> struct(k as level, b as bin)), array())))"
    usable = spans.withColumns({c: F.col(c).cast("long") for c in ("start_line", "end_line")}).where("start_line <= end_line")
    return usable.withColumn("piece", F.explode(F.expr(cut))).select("*", "piece.*").drop("piece")


def enclosing_symbols(lines: DataFrame, spans: DataFrame, file: str) -> DataFrame:
    """For each (file, line) the symbol of the fewest lines around it, null where none is.

    Spans are cut into bins of powers of two, of which each keeps its narrowest span; a line looks into the one bin
    of each level that it lies in. So neither a file of very many spans and lines nor nested spans make more than
    some LEVELS rows a line or span. Of equally narrow ones the first by name counts.
    """
    width = F.struct((F.col("end_line") - F.col("start_line")).alias("width"), F.col("sym").alias("sym"))
    narrowest = checkpoint(_pieces(spans).groupBy(file, "level", "bin").agg(F.min(width).alias("best")))
    levels = narrowest.agg(F.max("level")).first()[0]
    probes = lines.select(file, F.col("line").cast("long").alias("line")).distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels or 0))))
    placed = probes.withColumn("bin", F.expr("shiftright(line, level)"))
    best = placed.join(narrowest, [file, "level", "bin"]).groupBy(file, "line").agg(F.min("best").alias("best")).select(file, "line", F.col("best.sym").alias("sym"))
    return lines.join(best, [file, "line"], "left")


def commit_links(files: DataFrame, governed: DataFrame) -> DataFrame:
    """(hash, decision_id): the decisions that govern files of a commit, each once.

    files: (hash, path); governed: as of governed_files.
    """
    governing = governed.distinct()
    return files.select("hash", "path").distinct().join(governing, F.col("path") == F.col("file")).select("hash", "decision_id").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbour) whichever way edges point, each neighbour once; a hub's stay rows."""
    ends = F.array(F.struct(F.col("source_id").alias("id"), F.col("target_id").alias("neighbour")), F.struct(F.col("target_id").alias("id"), F.col("source_id").alias("neighbour")))
    return edges.select(F.explode(ends).alias("e")).select("e.id", "e.neighbour").distinct()


def panel(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """A node's edges with the other end's name, or its id where that node is missing."""
    out = edges.where(F.col("source_id") == node).select("relation", F.lit("→").alias("arrow"), F.col("target_id").alias("other"))
    into = edges.where((F.col("target_id") == node) & (F.col("source_id") != node)).select("relation", F.lit("←").alias("arrow"), F.col("source_id").alias("other"))
    named = nodes.select(F.col("id").alias("other"), "name")
    return out.unionByName(into).join(named, "other", "left").select("relation", "arrow", "other", F.coalesce("name", "other").alias("name"))


def without_node(edges: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges neither of whose ends is among the removed ids."""
    gone = removed.select("id")
    return edges.join(gone, F.col("source_id") == F.col("id"), "left_anti").join(gone, F.col("target_id") == F.col("id"), "left_anti")


def annotations_left(annotations: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Annotations (id, decision_id, edge_id, ...) whose decision and edge (both by id) are still there."""
    explained = annotations.join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    return explained.join(nodes.select(F.col("id").alias("decision_id")), "decision_id", "left_semi").select(*annotations.columns)
