"""More queries of the catalog: what a view draws, labels and hits, annotations, and searches with a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import drawing, paths, wire
from ..operators import events, filters, fulltext, joins
from ..sources.tables import graph_edges, graph_nodes, table
from . import projection
from .catalog import _BM25, GRAPH, SQL, query  # noqa: F401  (SQL: for live_catalog, with the queries of this module in it)

#: Every node stands at a place made from the number in its id.
_PLACED = "placed as (select *, (cast(substr(id, 3) as bigint) % 97)::double as x, (cast(substr(id, 3) as bigint) % 89)::double as y from g_nodes)"


def _placed(nodes: DataFrame) -> DataFrame:
    number = F.substring("id", 3, 20).cast("long")
    return nodes.withColumns({"x": (number % 97).cast("double"), "y": (number % 89).cast("double")})


@query("governance_pull", f"""{GRAPH}, {_PLACED}, t as (select e.source_id as id, avg(x) as x, avg(y) as y, count(*) as n from g_edges e join placed p on p.id = e.target_id where relation = 'GOVERNS' group by 1)
    select t.id, t.x, t.y, n, (t.x - d.x) * 0.125 as vx, (t.y - d.y) * 0.125 as vy from t join placed d on d.id = t.id where d.kind = 'decision'""")  # fmt: skip
def governance_pull(spark: SparkSession, d: str) -> DataFrame:
    nodes = _placed(graph_nodes(spark, d, ("decision", "path", "file")))
    return drawing.governance_pull(nodes, graph_edges(spark, d, ("GOVERNS",)), alpha=0.5)


@query("hit_node", f"""{GRAPH}, {_PLACED}, near as (select id, kind, sqrt((x - 30.2) * (x - 30.2) + (y - 40.1) * (y - 40.1)) as away, case kind when 'decision' then 10 when 'file' then 5 else 2.5 end as world from placed where kind in ('decision', 'path', 'file'))
    select id, kind from near where away < (world + 3) / 2 order by away, id limit 1""")  # fmt: skip
def hit_node(spark: SparkSession, d: str) -> DataFrame:
    return drawing.hit_node(_placed(graph_nodes(spark, d, ("decision", "path", "file"))), 30.2, 40.1, 2.0).select("id", "kind")


@query("hit_edge", f"""{GRAPH}, {_PLACED}, ends as (select source_id, target_id, a.x as ax, a.y as ay, b.x - a.x as dx, b.y - a.y as dy from g_edges join placed a on a.id = source_id join placed b on b.id = target_id where relation = 'GOVERNS' and cast(substr(source_id, 3) as bigint) % 3 = 0),
    nearest as (select *, case when dx * dx + dy * dy = 0 then 0 else least(1, greatest(0, ((30.5 - ax) * dx + (40.5 - ay) * dy) / (dx * dx + dy * dy))) end as t from ends)
    select source_id, target_id from nearest where sqrt(pow(30.5 - ax - t * dx, 2) + pow(40.5 - ay - t * dy, 2)) <= 4 order by source_id, target_id limit 1""")  # fmt: skip
def hit_edge(spark: SparkSession, d: str) -> DataFrame:
    edges = graph_edges(spark, d, ("GOVERNS",)).withColumn("aggregate", F.substring("source_id", 3, 20).cast("long") % 3 == 0)
    return drawing.hit_edge(edges, _placed(graph_nodes(spark, d, ("decision", "path", "file"))), 30.5, 40.5, 4.0).select("source_id", "target_id")


@query("cameras", """with c as (select c_custkey, c_acctbal as x, c_custkey % 700 as y, (0.5 + c_custkey % 9)::double as zoom, least(5, greatest(0.2, (0.5 + c_custkey % 9) * 1.5))::double as z from customer)
    select c_custkey, round((10 - x) * zoom + 400, 6) as screen_x, round((20 - y) * zoom + 300, 6) as screen_y, round(x - 350 / zoom, 6) as world_x, round(y - 275 / zoom, 6) as world_y,
      round(x - 350 / zoom + 350 / z, 6) as zoomed_x, round(y - 275 / zoom + 275 / z, 6) as zoomed_y, z as zoomed, round(x * 0.75, 6) as midway_x, round(zoom * 0.75 + 0.25, 6) as midway_zoom from c""")  # fmt: skip
def cameras(spark: SparkSession, d: str) -> DataFrame:
    key, camera = F.col("c_custkey"), F.col("camera")
    made = F.struct(F.col("c_acctbal").cast("double").alias("x"), (key % 700).cast("double").alias("y"), (key % 9 + 0.5).cast("double").alias("zoom"))
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("zoom"))
    shown = table(spark, d, "customer").select(key, made.alias("camera")).select(
        key, drawing.to_screen(camera, F.lit(10.0), F.lit(20.0), 800.0, 600.0).alias("s"), drawing.to_world(camera, F.lit(50.0), F.lit(25.0), 800.0, 600.0).alias("w"),
        drawing.zoom_at(camera, F.lit(1.5), F.lit(50.0), F.lit(25.0), 800.0, 600.0).alias("z"), drawing.between(camera, start, F.lit(0.25)).alias("m"),
    )
    rounded = {"screen_x": "s.x", "screen_y": "s.y", "world_x": "w.x", "world_y": "w.y", "zoomed_x": "z.x", "zoomed_y": "z.y", "midway_x": "m.x", "midway_zoom": "m.zoom"}
    return shown.select(key, *(F.round(c, 6).alias(n) for n, c in rounded.items()), F.col("z.zoom").alias("zoomed"))


@query("transitions", """with m as (select event_id, event_id % 2 = 0 as enters, (event_id % 200 + 50)::double as age, user_id::double as x0, (event_id % 31)::double as x1 from events),
    u as (select *, least(1, age / case when enters then 280 else 220 end) as t from m where age < case when enters then 280 else 220 end)
    select event_id, round(case when enters then x1 else x0 + (x1 - x0) * t end, 6) as x, round(case when enters then 1 - (1 - t) * (1 - t) * (1 - t) else 1 - t * t end, 6) as opacity,
      round(case when enters then 1 + 2.70158 * pow(t - 1, 3) + 1.70158 * pow(t - 1, 2) else 1 - 0.4 * t * t end, 6) as scale from u""")  # fmt: skip
def transitions(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct(F.col("user_id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("opacity"), F.lit(1.0).alias("scale"))
    to = F.struct((F.col("event_id") % 31).cast("double").alias("x"), F.lit(0.0).alias("y"))
    phase = F.when(F.col("event_id") % 2 == 0, "entering").otherwise("exiting")
    rows = table(spark, d, "events").select("event_id", phase.alias("phase"), (F.col("event_id") % 200).cast("double").alias("age"), at.alias("start"), to.alias("end"))
    seen = drawing.moving(rows, 50.0).select("event_id", drawing.appearance(F.col("phase"), F.col("age"), F.col("start"), F.col("end")).alias("a"))
    return seen.select("event_id", *(F.round(f"a.{c}", 6).alias(c) for c in ("x", "opacity", "scale")))


@query("kind_boxes", GRAPH + """ select 'node' as part, kind as name, count(*) as count from g_nodes where kind not in ('path', 'function') group by kind
    union all select 'edge', relation, count(*) from g_edges join g_nodes a on a.id = source_id join g_nodes b on b.id = target_id where a.kind not in ('path', 'function') and b.kind not in ('path', 'function') group by relation""")  # fmt: skip
def kind_boxes(spark: SparkSession, d: str) -> DataFrame:
    boxes = {"function": False, "component": True, "decision": True, "path": False, "reference": True}
    nodes, edges = filters.by_boxes(graph_nodes(spark, d), graph_edges(spark, d), boxes)
    count = lambda rows, part, name: rows.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("count")).select(F.lit(part).alias("part"), "name", "count")
    return count(nodes, "node", "kind").unionByName(count(edges, "edge", "relation"))


@query("labels_shown", GRAPH + """ select kind, kind in ('decision', 'file') as shown, count(*) filter (where contains(lower(name), '1')) as found, count(*) as nodes,
    sum(case when contains(lower(coalesce(name, '')), '1') then 1 else 0 end)::bigint as opaque from g_nodes group by kind""")  # fmt: skip
def labels_shown(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph_nodes(spark, d).withColumn("shown", filters.label_shown(0.7))
    found = filters.list_matches(nodes, "1").groupBy("kind").agg(F.count("*").alias("found"))
    counted = nodes.groupBy("kind", "shown").agg(F.count("*").alias("nodes"), F.count_if(filters.faded("1") == 1.0).alias("opaque"))
    return counted.join(found, "kind", "left").select("kind", "shown", F.coalesce("found", F.lit(0)).alias("found"), "nodes", "opaque")


@query("link_forces", GRAPH + """ select relation, case relation when 'GOVERNS' then 45 when 'CALLS' then 55 when 'IMPORTS' then 70 when 'SUPERSEDES' then 40 else 70 end::double as distance,
    case relation when 'GOVERNS' then 0.8 when 'CALLS' then 0.5 when 'IMPORTS' then 0.4 when 'SUPERSEDES' then 0.6 else 0.4 end::double as strength, count(distinct source_id || '|' || target_id || '|' || relation) as keys from g_edges group by relation""")  # fmt: skip
def link_forces(spark: SparkSession, d: str) -> DataFrame:
    keyed = graph_edges(spark, d).withColumn("key", paths.edge_key("source_id", "target_id", "relation")).groupBy("relation").agg(F.count_distinct("key").alias("keys"))
    return keyed.select("relation", drawing.link_distance(F.col("relation")).alias("distance"), drawing.link_strength(F.col("relation")).alias("strength"), "keys")


@query("annotations_left", GRAPH + """, a as (select 'a-' || source_id as id, source_id as decision_id, source_id || '>' || target_id as edge_id, target_id from g_edges where relation = 'GOVERNS')
    select id, decision_id, edge_id from a where cast(substr(decision_id, 3) as bigint) % 5 <> 0 and target_id <> 'n-3'""")  # fmt: skip
def annotations_left(spark: SparkSession, d: str) -> DataFrame:
    """Every decision explains its governing edge; a fifth of the decisions go, and a node with its edges."""
    decisions = graph_nodes(spark, d, ("decision",)).where(F.substring("id", 3, 20).cast("long") % 5 != 0)
    edges = graph_edges(spark, d, ("GOVERNS",)).withColumn("id", F.concat("source_id", F.lit(">"), "target_id"))
    rows = edges.select(F.concat(F.lit("a-"), "source_id").alias("id"), F.col("source_id").alias("decision_id"), F.col("id").alias("edge_id"))
    removed = spark.createDataFrame([("n-3",)], "id string")
    left = joins.without_node(edges.select("id", "source_id", "target_id").withColumnRenamed("id", "key"), removed).withColumnRenamed("key", "id")
    return joins.annotations_left(rows, decisions, left)


@query("search_in_scope", GRAPH + ", " + _BM25.removeprefix("with ") + """ join (select distinct e.source_id as governing from g_edges e join g_nodes t on t.id = e.target_id where relation = 'GOVERNS' and t.file_path <> '' and starts_with((select fp from cust where c_custkey = 21), t.file_path)) on governing = 'd-' || doc_id""")
def search_in_scope(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = graph_nodes(spark, d, ("decision", "path", "file")), graph_edges(spark, d, ("GOVERNS",))
    scope = graph_nodes(spark, d, ("file",)).where("id = 'c-21'").first().file_path
    texts = table(spark, d, "documents").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("node_id"), F.col("text").alias("description"))
    found = fulltext.search_decisions(texts.withColumns({"title": F.lit(None).cast("string"), "rationale": F.lit(None).cast("string")}), nodes, edges, "the OR and", scope)
    return found.select(F.col("id").alias("node_id"), F.round("rank", 9).alias("rank"))


@query("git_log", """with c as (select o_orderkey, o_custkey % 20 as source, row_number() over (partition by o_custkey % 20 order by o_orderkey) as n, o_orderpriority, p_partkey from (select * from orders left join (select l_orderkey, min(l_partkey) as p_partkey from lineitem group by 1) on l_orderkey = o_orderkey))
    select 'h' || o_orderkey as hash, 'order ' || o_orderkey as message, o_orderpriority as author, o_orderkey::bigint as timestamp, case when p_partkey is not null then 'parts/' || p_partkey || '.ts' end as path from c where n < 4""")  # fmt: skip
def git_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits of twenty logs, of which the fourth is the last seen."""
    from pyspark.sql import Window

    source = F.col("o_custkey") % 20
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"))
    rows = table(spark, d, "orders").withColumns({"source": source, "n": F.row_number().over(Window.partitionBy(source).orderBy("o_orderkey"))}).join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    key = F.col("o_orderkey").cast("string")
    head = F.concat_ws("\x00", F.concat(F.lit("h"), key), F.concat(F.lit("order "), key), "o_orderpriority", key)
    file = F.concat(F.lit("M\tparts/"), F.col("part").cast("string"), F.lit(".ts"))
    lines = rows.select("source", F.explode(F.array(F.struct((F.col("n") * 2).alias("line_no"), head.alias("text")), F.struct((F.col("n") * 2 + 1).alias("line_no"), file.alias("text")))).alias("l"))
    seen = rows.where("n = 4").select("source", F.concat(F.lit("h"), key).alias("hash"))
    commits, _ = events.scan_git(lines.select("source", "l.*").where("text is not null"), seen)
    return commits.select("hash", "message", "author", "timestamp", F.explode_outer(F.col("files").path).alias("path"))


@query("reclassified", """select 'c-' || o_custkey as source_id, 'p-' || (o_custkey % 7) as target_id, case when max(o_orderkey % 23) = 22 then 'folded' else 'unfolded' end as change from orders group by 1, 2 having (max(o_orderkey % 17) = 16) <> (max(o_orderkey % 23) = 22)""")
def reclassified(spark: SparkSession, d: str) -> DataFrame:
    ends = [F.concat(F.lit("c-"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("p-"), (F.col("o_custkey") % 7).cast("string")).alias("target_id")]
    side = lambda k: table(spark, d, "orders").select(*ends, (F.col("o_orderkey") % k == k - 1).alias("aggregate"))
    return projection.reclassified(side(17), side(23))


@query("escaped_html", "select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') as html from documents where text is not null")
def escaped_html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", wire.escape_html(F.col("text")).alias("html"))
