"""Directory, file and governance groups. Members stay rows, as one group may hold most nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import cap_depth, dir_of, group_id, owner_file, territory_id


def owned(nodes: DataFrame) -> DataFrame:
    """Nodes but decisions with the file they belong to as owner; nodes without one are left out."""
    return nodes.where("kind <> 'decision'").withColumn("owner", owner_file("kind", "qualified_name", "file_path")).where("owner is not null")


def dir_members(nodes: DataFrame, depth: int | None) -> DataFrame:
    """(id, dir): the directory, of at most depth parts, that each node belongs to."""
    return owned(nodes).select("id", cap_depth(dir_of("owner"), depth).alias("dir")).where("dir is not null")


def dir_groups(nodes: DataFrame, depth: int | None) -> DataFrame:
    """(id, kind, path, dir, first_member, member_count) of the directories of two members or more."""
    sized = dir_members(nodes, depth).groupBy("dir").agg(F.min("id").alias("first_member"), F.count_distinct("id").alias("member_count")).where("member_count >= 2")
    return sized.select(group_id("dir").alias("id"), F.lit("dir").alias("kind"), F.col("dir").alias("path"), "dir", "first_member", "member_count")


def file_groups(nodes: DataFrame) -> DataFrame:
    """The same of files that own nodes."""
    sized = owned(nodes).where("kind <> 'file'").groupBy("owner").agg(F.min("id").alias("first_member"), F.count_distinct("id").alias("member_count"))
    return sized.select(group_id("owner").alias("id"), F.lit("file").alias("kind"), F.col("owner").alias("path"), F.coalesce(dir_of("owner"), F.lit("")).alias("dir"), "first_member", "member_count")


def path_groups(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """All of them; where a file and a directory have one id, the file stands."""
    files = file_groups(nodes)
    return dir_groups(nodes, depth).join(files.select("id"), "id", "left_anti").unionByName(files)


def group_members(nodes: DataFrame, depth: int | None = None) -> DataFrame:
    """(group, id), a row for each member of each path group."""
    dirs = dir_members(nodes, depth).select(group_id("dir").alias("group"), "id")
    files = owned(nodes).where("kind <> 'file'").select(group_id("owner").alias("group"), "id")
    of_dirs = dirs.join(dir_groups(nodes, depth).select(F.col("id").alias("group")), "group", "left_semi").join(files.select("group"), "group", "left_anti")
    return of_dirs.unionByName(files).distinct()


def territory_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, decision_id, member), a row for each node that a decision governs."""
    decisions = nodes.where("kind = 'decision'").select(F.col("id").alias("source_id"))
    held = edges.where("relation = 'GOVERNS'").join(decisions, "source_id", "left_semi")
    return held.select(territory_id("source_id").alias("id"), F.col("source_id").alias("decision_id"), F.col("target_id").alias("member")).distinct()


def territories(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, decision_id, first_member, member_count) of what each decision governs."""
    return territory_members(nodes, edges).groupBy("id", "decision_id").agg(F.min("member").alias("first_member"), F.count("*").alias("member_count"))
