"""Lookups, conjunctive filters and name matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def find(rows: DataFrame, **equal: str | None) -> DataFrame:
    """Rows where every given column equals its value; None is no condition."""
    given = [F.col(c) == v for c, v in equal.items() if v is not None]
    return rows.where(reduce(Column.__and__, given)) if given else rows


def by_id(rows: DataFrame, value: str) -> DataFrame:
    return rows.where(F.col("id") == value).limit(1)


def search_symbols(nodes: DataFrame, name_pattern: str | None = None, label: str | None = None, qn_pattern: str | None = None, limit: int = 100) -> DataFrame:
    """Symbols whose name holds a pattern, of a label, whose qualified name is like a pattern; the first by id.

    Matches ignore case; ``%`` and ``_`` are wildcards in both patterns.
    """
    found = find(nodes, label=label)
    if name_pattern is not None:
        found = found.where(F.col("name").ilike(f"%{name_pattern}%"))
    if qn_pattern is not None:
        found = found.where(F.col("qualified_name").ilike(qn_pattern))
    return found.orderBy("id").limit(limit)


def symbol_by_name(nodes: DataFrame, qualified_name: str) -> DataFrame:
    """The symbol of exactly this name; only a name with wildcards is a pattern."""
    same = F.col("qualified_name").ilike(qualified_name) if set("%_") & set(qualified_name) else F.col("qualified_name") == qualified_name
    return nodes.where(same).orderBy((F.col("qualified_name") != qualified_name).cast("int"), "id").limit(1)


def schema_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, name, count) of node labels and edge relations."""
    labels = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("count")).withColumn("part", F.lit("label"))
    relations = edges.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("count")).withColumn("part", F.lit("relation"))
    return labels.unionByName(relations).select("part", "name", "count").orderBy("part", "name")


def name_holds(query: str) -> Column:
    """Whether the name holds the query, whatever the case; an empty query is in every name."""
    return F.contains(F.lower(F.coalesce("name", F.lit(""))), F.lit(query.lower()))


def list_matches(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes for a result list: an empty query finds none."""
    return nodes.where(name_holds(query) if query else F.lit(False))


def forced_visible(query: str) -> Column:
    """Whether a search shows the node wherever it is folded: by name or qualified name."""
    q = F.lit(query.lower())
    return F.coalesce(F.contains(F.lower("name"), q), F.lit(False)) | F.coalesce(F.contains(F.lower("qualified_name"), q), F.lit(False))


def match_counts(visible: DataFrame, query: str) -> DataFrame:
    return visible.agg(F.count_if(name_holds(query)).alias("matches"), F.count("*").alias("total"))


def label_shown(zoom: float) -> Column:
    """Whether a node's label is drawn at this zoom."""
    kind = F.col("kind")
    return F.when(kind.isin("group", "decision"), True).when(kind == "file", F.lit(zoom >= 0.7)).otherwise(F.lit(zoom >= 2.0))


def faded(query: str) -> Column:
    """How opaque a search leaves a node."""
    return F.when(name_holds(query), 1.0).otherwise(0.1)


def by_boxes(nodes: DataFrame, edges: DataFrame, boxes: dict[str, bool]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose kind is ticked or has no box, and edges between two of them."""
    shown = nodes.where(F.coalesce(~F.col("kind").isin(*(k for k, ticked in boxes.items() if not ticked)), F.lit(True)))
    ids = shown.select("id")
    both = edges.join(ids, F.col("source_id") == F.col("id"), "left_semi").join(ids, F.col("target_id") == F.col("id"), "left_semi")
    return shown, both


def grep(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that a regular expression finds something in."""
    return lines.where(F.col("text").rlike(pattern))


def snippet(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end of each file, both from 1."""
    return lines.where(F.col("line").between(max(1, start), end))
