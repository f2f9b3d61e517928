"""Traversals: breadth first with each node visited once, and walks up the directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors
from ..sources.schema import TRACED
from ..sources.session import checkpoint


def breadth_first(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, depth, parent) of all nodes within depth of the start ids; edges are (source_id, target_id).

    Each round joins the frontier with the edges, drops what has been seen and keeps one row a
    node, so cycles end and paths do not multiply. Rounds are checkpointed and stop at an empty frontier.
    """
    frontier = checkpoint(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")))
    seen = frontier
    for d in range(1, depth + 1):
        steps = edges.join(frontier.select(F.col("id").alias("source_id")), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min("source_id").alias("parent"))
        frontier = checkpoint(steps.join(seen, "id", "left_anti").select("id", F.lit(d).alias("depth"), "parent"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))


def trace(nodes: DataFrame, edges: DataFrame, name: str, mode: str = "calls", depth: int = 3, relations: tuple[str, ...] = TRACED) -> DataFrame:
    """(id, name, depth) of what the first symbol of this name reaches, or with mode callers is reached from."""
    if not 1 <= depth <= 10:
        raise ValueError("depth is from 1 to 10")
    start = nodes.where(F.col("name") == name).orderBy("id").limit(1)
    pairs = edges.where(F.col("relation").isin(*relations)).select("source_id", "target_id")
    reached = breadth_first(_reversed(pairs) if mode == "callers" else pairs, start, depth).where("depth > 0")
    return reached.join(nodes.select("id", "name"), "id").select("id", "name", "depth").orderBy("depth", "name", "id")


def shortest_path(edges: DataFrame, source: str, target: str, depth: int = 5) -> DataFrame:
    """(step, id) of one shortest directed path of at most depth edges; no rows without one.

    Of equally short ones, each node's smallest predecessor is taken.
    """
    start = edges.sparkSession.createDataFrame([(source,)], "id string")
    reached = checkpoint(breadth_first(edges.select("source_id", "target_id"), start, depth))
    here = reached.where(F.col("id") == target)
    path = here
    for _ in range(depth):
        before = here.select(F.col("parent").alias("id")).where("id is not null")
        here = reached.join(before, "id", "left_semi")
        path = path.unionByName(here)
    return path.select(F.col("depth").alias("step"), "id").distinct().orderBy("step")


def k_hop(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """(id, depth) within depth edges of the root, whichever way they point; the root included."""
    pairs = edges.select("source_id", "target_id")
    start = edges.sparkSession.createDataFrame([(root,)], "id string")
    return breadth_first(pairs.unionByName(_reversed(pairs)), start, depth).select("id", "depth")


def focus_set(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """The root and, from depth 1, what an edge joins it with; greater depths add nothing."""
    own = edges.sparkSession.createDataFrame([(root,)], "id string")
    if depth < 1:
        return own
    touching = edges.where((F.col("source_id") == root) | (F.col("target_id") == root))
    return own.unionByName(touching.select(F.explode(F.array("source_id", "target_id")).alias("id"))).distinct()


def superseded_chain(edges: DataFrame, decision: str, depth: int = 10) -> DataFrame:
    """(id, depth) of the decisions that one has replaced, directly or through others."""
    start = edges.sparkSession.createDataFrame([(decision,)], "id string")
    return breadth_first(edges.where("relation = 'SUPERSEDES'").select("source_id", "target_id"), start, depth).where("depth > 0").select("id", "depth")


def _governed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, decision_id) and (name, decision_id) of what decisions govern, by path without a slash at the end and by qualified name."""
    governing = edges.where("relation = 'GOVERNS'").join(nodes.where("kind = 'decision'").select(F.col("id").alias("source_id")), "source_id")
    governed = governing.join(nodes.select(F.col("id").alias("target_id"), "qualified_name", F.rtrim("file_path", F.lit("/")).alias("path")), "target_id")
    by_path = governed.where("path is not null and path <> ''").select("path", F.col("source_id").alias("decision_id"))
    return by_path, governed.where("qualified_name is not null").select(F.col("qualified_name").alias("name"), F.col("source_id").alias("decision_id"))


def _levels(targets: DataFrame) -> DataFrame:
    """(target, level, path) of each target path and the directories above it."""
    return targets.select("target", F.explode(ancestors("target")).alias("a")).select("target", "a.level", "a.path")


def why_built(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, decision_id, level) of the decisions nearest to each target path or qualified name.

    Level -1 is a node of that qualified name, 0 one of that path, and above that the directories in
    turn. The lowest level that has decisions answers, with all decisions of that level. Paths are
    compared without a slash at the end, so all levels are one equi join.
    """
    by_path, by_name = _governed(nodes, edges)
    found = _levels(targets).join(by_path, "path").select("target", "level", "decision_id")
    named = targets.join(by_name, F.col("target") == F.col("name")).select("target", F.lit(-1).alias("level"), "decision_id")
    every = found.unionByName(named)
    nearest = every.withColumn("first", F.min("level").over(Window.partitionBy("target"))).where("level = first")
    return nearest.select("target", "decision_id", "level").distinct()


def why_built_counts(targets: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(target, level, decisions, first_decision): how many decisions why_built gives each target that has any, and the first by id.

    Decisions are counted once for each path and name, and targets take the counts, so what is joined grows with the
    targets and the decisions and not with their product.
    """
    counted = lambda rows, key: rows.groupBy(key).agg(F.count_distinct("decision_id").alias("decisions"), F.min("decision_id").alias("first_decision"))
    by_path, by_name = _governed(nodes, edges)
    columns = ("target", "level", "decisions", "first_decision")
    found = _levels(targets).join(counted(by_path, "path"), "path").select(*columns)
    named = targets.join(counted(by_name, "name"), F.col("target") == F.col("name")).withColumn("level", F.lit(-1)).select(*columns)
    nearest = found.unionByName(named).groupBy("target").agg(F.min(F.struct(*columns[1:])).alias("nearest"))
    return nearest.select("target", "nearest.*")
