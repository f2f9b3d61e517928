"""Level-of-detail projection: folds a graph into directory and file groups with aggregated edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, base_name, cap_depth, dir_of, group_id
from ..operators.filters import forced_visible
from ..operators.groups import owned, path_groups, territories, territory_members
from ..operators.traverse import focus_set
from ..sources.schema import KINDS, band_for
from ..sources.session import checkpoint


@dataclass
class Projection:
    """nodes: (id, kind, name, group_kind, member_count); edges: (source_id, target_id, aggregate, count, relation,
    relations); groups: path groups shown; territories: those of which something is shown; representative: (id, rep) of every
    node that is shown or folded."""

    nodes: DataFrame
    edges: DataFrame
    groups: DataFrame
    territories: DataFrame
    representative: DataFrame


def group_chains(groups: DataFrame) -> DataFrame:
    """(id, above, level) of each path group with itself, level 0, and the directory groups above it.

    A file's directories count from its own one; a directory's from the next above. Every prefix is
    looked up at once by an equi join, instead of climbing.
    """
    dirs = groups.where("kind = 'dir'").select(F.col("path").alias("at"), F.col("id").alias("above"))
    own = groups.select("id", F.col("id").alias("above"), F.lit(0).alias("level"))
    climbed = groups.select("id", "kind", F.explode(ancestors(F.col("dir"))).alias("a")).where("kind = 'file' or a.level > 0")
    return own.unionByName(climbed.select("id", F.col("a.path").alias("at"), (F.col("a.level") + 1).alias("level")).join(dirs, "at").select("id", "above", "level"))


def counted_pairs(edges: DataFrame, representative: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, raw, n): edges counted by the representatives of their ends (id, rep) and relation.

    raw: whether the ends are their own representatives.
    """
    # whether an end is its own representative is told before the next shuffle, and its id stays behind
    end = lambda c: representative.select(F.col("id").alias(f"{c}_id"), F.col("rep").alias(f"{c}_rep"), (F.col("rep") == F.col("id")).alias(f"{c}_own"))
    placed = edges.join(end("source"), "source_id").select("target_id", "relation", "source_rep", "source_own").join(end("target"), "target_id").where("source_rep <> target_rep")
    raw = F.col("source_own") & F.col("target_own")
    return placed.select(F.col("source_rep").alias("source_id"), F.col("target_rep").alias("target_id"), "relation", raw.alias("raw")).groupBy("source_id", "target_id", "relation", "raw").agg(F.count("*").alias("n"))


def shaped(counts: DataFrame) -> DataFrame:
    """Edges as shown, from counted_pairs: raw ones as they are, one of each kind, others by pair. Ties for the commonest relation go to the first by name."""
    plain = counts.where("raw").select("source_id", "target_id", F.lit(False).alias("aggregate"), F.lit(1).cast("long").alias("count"), "relation", F.create_map("relation", F.lit(1).cast("long")).alias("relations"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "relation", "n")))
    folded = counts.where("not raw").groupBy("source_id", "target_id").agg(F.sum("n").alias("count"), ranked.alias("by"))
    entries = F.transform("by", lambda x: F.struct(x.relation, x.n))
    return plain.unionByName(folded.select("source_id", "target_id", F.lit(True).alias("aggregate"), "count", F.col("by")[0].relation.alias("relation"), F.map_from_entries(entries).alias("relations")))


def aggregate_edges(edges: DataFrame, representative: DataFrame) -> DataFrame:
    """Edges between representatives; representative is (id, rep)."""
    return shaped(counted_pairs(edges, representative))


def project(
    nodes: DataFrame, edges: DataFrame, zoom: float, focus: tuple[str, int] | None = None, filters: tuple[str, ...] = KINDS, search: str = ""
) -> Projection:
    """What is shown at a zoom, around a focus (root, depth), of some kinds, and for a search.

    A search shows every match, and takes away all groups that a match lies in.
    """
    band = band_for(zoom)
    groups = checkpoint(path_groups(nodes, band.depth))  # all that follows reads it several times
    closest = _closest(nodes, groups, band.depth)
    shown = groups.where(F.when(F.col("kind") == "dir", F.lit(band.dirs)).otherwise(F.lit(band.files)))
    chains = checkpoint(group_chains(groups))

    wanted = nodes.where(F.col("kind").isin(*filters) | (F.col("kind") == "decision"))
    if focus:
        wanted = wanted.join(focus_set(edges, *focus), "id", "left_semi")
    matches = wanted.where(forced_visible(search)) if search else wanted.where(F.lit(False))
    before = _folded(closest, chains, shown)
    bare = wanted.join(before, "id", "left_anti") if band.dirs or band.files else wanted
    own = bare.where(F.col("kind").isin(*band.kinds) & (F.lit(band.leaf_files) | (F.col("kind") != "file")))
    leaves = wanted.where("kind = 'decision'").unionByName(own.where("kind <> 'decision'"))
    folded = before
    if search:
        leaves = leaves.unionByName(matches).dropDuplicates(["id"])
        taken = matches.select("id").join(closest, "id").join(chains.withColumnRenamed("id", "group"), "group").select(F.col("above").alias("id"))
        shown = shown.join(taken, "id", "left_anti")
        folded = _folded(closest, chains, shown)
    leaves = checkpoint(leaves.select("id", "kind", "name"))
    folded = folded.join(leaves.select("id"), "id", "left_anti")

    label = F.when(F.col("kind") == "dir", F.concat(F.substring_index("path", "/", -1), F.lit("/"))).otherwise(base_name("path"))
    none = F.lit(None)
    visible = leaves.select("*", none.cast("string").alias("group_kind"), none.cast("long").alias("member_count"))
    visible = visible.unionByName(shown.select("id", F.lit("group").alias("kind"), label.alias("name"), F.col("kind").alias("group_kind"), "member_count"))
    representative = leaves.select("id", F.col("id").alias("rep")).unionByName(folded.select("id", F.col("above").alias("rep")))
    seen = leaves.select("id").unionByName(closest.join(shown.select(F.col("id").alias("group")), "group", "left_semi").select("id"))
    alive = territory_members(nodes, edges).join(seen.select(F.col("id").alias("member")), "member", "left_semi").select("id")
    return Projection(visible, aggregate_edges(edges, representative), shown, territories(nodes, edges).join(alive, "id", "left_semi"), representative)


def _closest(nodes: DataFrame, groups: DataFrame, depth: int | None) -> DataFrame:
    """(id, group): the file group of what a file owns, the directory group of files themselves."""
    group = F.when(F.col("kind") == "file", group_id(cap_depth(dir_of("owner"), depth))).otherwise(group_id("owner"))
    return owned(nodes).select("id", group.alias("group")).join(groups.select(F.col("id").alias("group")), "group", "left_semi").select("id", "group")


def _folded(closest: DataFrame, chains: DataFrame, shown: DataFrame) -> DataFrame:
    """(id, above): the nearest shown group of each node that has one. Groups climb, then their members follow."""
    climbed = chains.join(shown.select(F.col("id").alias("above")), "above", "left_semi").groupBy(F.col("id").alias("group")).agg(F.min_by("above", "level").alias("above"))
    return closest.join(climbed, "group").select("id", "above")


def diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(id, change) of the ids that only the current or only the previous set of nodes has."""
    come = current.join(previous.select("id"), "id", "left_anti").select("id", F.lit("entering").alias("change"))
    return come.unionByName(previous.join(current.select("id"), "id", "left_anti").select("id", F.lit("exiting").alias("change")))


def reclassified(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(source_id, target_id, change) of directed pairs whose edges became or ceased to be aggregates."""
    before = previous.groupBy("source_id", "target_id").agg(F.max("aggregate").alias("was"))
    now = current.groupBy("source_id", "target_id").agg(F.max("aggregate").alias("aggregate"))
    changed = before.join(now, ["source_id", "target_id"]).where("was <> aggregate")
    return changed.select("source_id", "target_id", F.when(F.col("aggregate"), "folded").otherwise("unfolded").alias("change"))


def interesting(previous: Projection, current: Projection) -> bool:
    """Whether other nodes or edges are shown than before."""
    keys = ["source_id", "target_id", "aggregate", F.when(F.col("aggregate"), F.lit("")).otherwise(F.col("relation")).alias("relation")]
    a, b = previous.edges.select(*keys), current.edges.select(*keys)
    return not (diff(previous.nodes, current.nodes).isEmpty() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
