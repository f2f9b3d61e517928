"""Small graphs with results known by hand."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import drawing, paths
from loomgraph.operators import events, filters, fulltext, groups, joins, traverse
from loomgraph.operators.store import Store
from loomgraph.plans import catalog, projection
from loomgraph.sources.session import checkpoint
from loomgraph.sources.tables import unified_nodes

NODES = "id string, kind string, name string, qualified_name string, file_path string"


def edges_of(spark, *rows):
    return spark.createDataFrame(list(rows), "source_id string, target_id string, relation string")


def pairs(df):
    return sorted(map(tuple, df.collect()))


def test_cycles_end(spark):
    nodes = spark.createDataFrame([(x, "function", x, None, None) for x in "abc"], NODES)
    edges = edges_of(spark, ("a", "b", "CALLS"), ("b", "a", "CALLS"), ("b", "c", "CALLS"))
    assert [(r.id, r.depth) for r in traverse.trace(nodes, edges, "a").collect()] == [("b", 1), ("c", 2)]
    assert [(r.id, r.depth) for r in traverse.trace(nodes, edges, "c", "callers").collect()] == [("b", 1), ("a", 2)]
    assert traverse.trace(nodes, edges, "missing").count() == 0
    with pytest.raises(ValueError):
        traverse.trace(nodes, edges, "a", depth=11)


def test_shortest_path(spark):
    edges = edges_of(spark, ("a", "b", "X"), ("b", "c", "Y"))
    assert pairs(traverse.shortest_path(edges, "a", "c", 2)) == [(0, "a"), (1, "b"), (2, "c")]
    assert pairs(traverse.shortest_path(edges, "a", "c", 1)) == []
    assert pairs(traverse.shortest_path(edges, "a", "a")) == [(0, "a")]


def test_why_climbs_to_a_governed_folder(spark):
    nodes = spark.createDataFrame([("d", "decision", "D", None, None), ("p", "path", "src", None, "src/"), ("q", "file", "x", None, "lib/x.ts")], NODES)
    edges = edges_of(spark, ("d", "p", "GOVERNS"))
    targets = spark.createDataFrame([("src/auth/jwt.ts",), ("lib/x.ts",)], "target string")
    assert pairs(traverse.why_built(targets, nodes, edges)) == [("src/auth/jwt.ts", "d", 2)]


def test_why_counts_each_path_once_and_gives_what_why_gives(spark, monkeypatch):
    rnd = random.Random(4)
    folders = ["a", "a/b", "a/c", "e"]
    files = [f"{rnd.choice(folders + ['z'])}/f{k}.ts" for k in range(60)]
    rows = [(f"d{k}", "decision", "D", None, None) for k in range(300)] + [(f"p{k}", "path", p, None, f"{p}/") for k, p in enumerate(folders)]
    rows += [("p9", "path", "again", None, "a/b"), *((f"q{k}", "file", "f", None, p) for k, p in enumerate(files)), ("s", "function", "s", "a/b/f.ts::s", "a/b/f.ts"), ("r", "function", "s", "e/none", None)]
    ends = ["p0", "p1", "p9", "q1", "q2", "s", "r"]
    edges = edges_of(spark, *((f"d{k}", rnd.choice(ends), "GOVERNS") for k in range(300)), ("d1", "p1", "GOVERNS"), ("d1", "p9", "GOVERNS"), ("s", "p2", "GOVERNS"), ("d2", "p3", "SUPERSEDES"))
    nodes, targets = spark.createDataFrame(rows, NODES), spark.createDataFrame([(t,) for t in [*files, files[0], "a/b/f.ts::s", "e/none", "a/b", None]], "target string")
    want = traverse.why_built(targets, nodes, edges).groupBy("target", "level").agg(F.count_distinct("decision_id"), F.min("decision_id"))
    got = traverse.why_built_counts(targets, nodes, edges)
    assert pairs(got) == pairs(want) and {r.level for r in got.collect()} == {-1, 0, 1, 2}
    # the query's joins make no row for each target and decision: 200 files under the folder that 200 decisions govern
    monkeypatch.setattr(catalog, "graph_nodes", lambda spark, d, kinds: frames[0].where(F.col("kind").isin(*kinds)))
    monkeypatch.setattr(catalog, "graph_edges", lambda spark, d, relations: frames[1])
    many = [(f"d{k}", "decision", "D", None, None) for k in range(200)] + [(f"c{k}", "file", "f", None, f"top/f{k}.ts") for k in range(200)] + [("p", "path", "top", None, "top/")]
    frames = checkpoint(spark.createDataFrame(many, NODES)), checkpoint(edges_of(spark, *((f"d{k}", "p", "GOVERNS") for k in range(200))))
    asked = catalog.why_built(spark, "")
    assert {tuple(r)[1:] for r in asked.collect()} == {(1, 200, "d0")} and asked.count() == 200
    assert largest_join(asked) <= 1000


def largest_join(df):
    """The most rows that a join of the plan made when it ran."""
    df.collect()
    walk, most = [df._jdf.queryExecution().executedPlan()], 0
    while walk:
        node = walk.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            walk.append(node.executedPlan())
        elif name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
            walk.append(node.plan())
        else:
            if "Join" in name:
                most = max(most, node.metrics().apply("numOutputRows").value())
            children = node.children()
            walk += [children.apply(k) for k in range(children.size())]
    return most


def test_neighbours_and_loops(spark):
    nodes = spark.createDataFrame([(x, "file", x, None, None) for x in "ab"], NODES)
    edges = edges_of(spark, ("a", "b", "X"), ("a", "a", "X"), ("a", "gone", "X"))
    assert pairs(joins.connected(nodes, edges, "a").select("id", "direction")) == [("a", "in"), ("a", "out"), ("b", "out")]
    assert pairs(joins.panel(nodes, edges, "a").select("other", "name")) == [("a", "a"), ("b", "b"), ("gone", "gone")]


def test_innermost_span(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 9), ("f", "inner", 3, 5)], "file string, sym string, start_line int, end_line int")
    lines = spark.createDataFrame([("f", 4), ("f", 8), ("f", 20), ("g", 1)], "file string, line int")
    assert pairs(joins.enclosing_symbols(lines, spans, "file").fillna("-")) == [("f", 4, "inner"), ("f", 8, "outer"), ("f", 20, "-"), ("g", 1, "-")]


def test_scope(spark):
    nodes = spark.createDataFrame([("d", "decision", "D", None, None), ("f", "function", "c", "src/db.ts::dbConnect", "src/db.ts")], NODES)
    edges = edges_of(spark, ("d", "f", "GOVERNS"))
    decisions = nodes.where("kind = 'decision'")
    for scope, found in (("src/db.ts::dbConnect", 1), ("src/db.ts", 1), ("src/other.ts", 0)):
        assert joins.governs_scope(decisions, nodes, edges, scope).count() == found


def test_groups_need_two_members(spark):
    rows = [(f"n{i}", "file", f"f{i}", None, f"src/{d}/sub/f{i}.ts") for i, d in enumerate(["events", "events", "viewer", "viewer", "lone"])]
    found = groups.dir_groups(spark.createDataFrame(rows, NODES), 2)
    assert pairs(found.select("id", "member_count")) == [("group:path:src/events", 2), ("group:path:src/viewer", 2)]


def lod(spark):
    rows = [(f"n{i}", "file", f"f{i}", None, f"src/{d}/f{i}.ts") for i, d in enumerate("aabb")] + [("d", "decision", "D", None, None)]
    edges = edges_of(spark, ("n0", "n2", "CALLS"), ("n1", "n3", "CALLS"), ("n0", "n3", "IMPORTS"), ("d", "n0", "GOVERNS"))
    return spark.createDataFrame(rows, NODES), edges


def test_far_zoom_folds_edges(spark):
    made = projection.project(*lod(spark), 0.3)
    assert pairs(made.nodes.select("id")) == [("d",), ("group:path:src/a",), ("group:path:src/b",)]
    folded = made.edges.where("source_id = 'group:path:src/a'").collect()
    assert [(r.target_id, r["count"], r.relation, r.relations) for r in folded] == [("group:path:src/b", 3, "CALLS", {"CALLS": 2, "IMPORTS": 1})]
    assert made.territories.count() == 1


def test_search_takes_groups_away(spark):
    made = projection.project(*lod(spark), 0.3, search="F0")
    assert pairs(made.nodes.select("id")) == [("d",), ("group:path:src/b",), ("n0",)]


def test_focus_and_changes(spark):
    nodes, edges = lod(spark)
    near = projection.project(nodes, edges, 3.0, focus=("n0", 1))
    assert pairs(near.nodes.select("id")) == [("d",), ("n0",), ("n2",), ("n3",)]
    far = projection.project(nodes, edges, 0.3)
    assert projection.interesting(far, near) and not projection.interesting(far, far)


def test_queries_of_words(spark):
    docs = spark.createDataFrame([("1", "use sqlite", "a store of rows", ""), ("2", "use postgres", "rows of a store", ""), ("3", None, None, None)], "node_id string, title string, description string, rationale string")
    index = fulltext.index(docs)
    sizes = fulltext.lengths(index, docs)
    find = lambda q: sorted(r.node_id for r in fulltext.search(index, sizes, q).collect())
    assert find("store rows") == ["1", "2"] and find('"store of"') == ["1"] and find("use NOT sqlite") == ["2"]
    assert find("postg*") == ["2"] and find("title:rows") == [] and find("sqlite OR postgres") == ["1", "2"]
    with pytest.raises(ValueError):
        fulltext.Query("NOT a")


MUTATIONS = "seq long, pos int, op string, id string, kind string, name string, status string, data string, source_id string, target_id string, relation string"


def mutation(seq, op, **f):
    return (seq, 0, op, *(f.get(k) for k in ("id", "kind", "name", "status", "data", "source_id", "target_id", "relation")))


def test_fold(spark):
    edge = {"source_id": "a", "target_id": "b", "relation": "X"}
    rows = [mutation(1, "add_node", id="a", name="A", status="new"), mutation(2, "update_node", id="a", status="old"), mutation(3, "add_edge", **edge), mutation(4, "remove_node", id="b"), mutation(5, "update_node", id="zz", name="Z")]
    log = spark.createDataFrame(rows, MUTATIONS)
    assert pairs(events.fold_nodes(log).select("id", "name", "status")) == [("a", "A", "old")]
    assert events.fold_edges(log).count() == 0
    assert events.fold_edges(events.as_of(log, 3)).count() == 1
    again = log.unionByName(spark.createDataFrame([mutation(6, "add_edge", **edge)], MUTATIONS))
    assert events.fold_edges(again).count() == 1


def test_pages(spark):
    log = spark.createDataFrame([(str(i), "x") for i in range(5)], "id string, kind string")
    rows, more = events.page(log, None, 3)
    assert [r.id for r in rows.collect()] == ["4", "3", "2"] and more
    rows, more = events.page(log, "2", 3)
    assert [r.id for r in rows.collect()] == ["1", "0"] and not more
    assert events.append_new(log, log.limit(2)).count() == 0


def test_git_log(spark):
    text = ["h1\x00first\x00ann\x00100", "M\ta.ts", "R100\told.ts\tnew.ts", "h2\x00second\x00\x00200", "A\tb.ts"]
    lines = spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "source string, line_no int, text string")
    rows = events.parse_git_log(lines).orderBy("commit").collect()
    assert [(r.hash, r.timestamp, [(f.path, f.status) for f in r.files]) for r in rows] == [("h1", 100, [("a.ts", "M"), ("new.ts", "R")]), ("h2", 200, [("b.ts", "A")])]


def test_names(spark):
    rows = [("src/a.ts::f",), ("plain",), ("a/b.mjs::g::h",)]
    df = spark.createDataFrame(rows, "x string").withColumn("y", paths.normalize_name("x", F.lit("p")))
    assert [r.y for r in df.collect()] == ["p.src.a.f", "plain", "p.a.b.g"]
    back = spark.createDataFrame([("p.src.a.f", "src/a.ts"), ("p.x.f", "src/a.ts")], "q string, f string").select(paths.denormalize_name("q", "f"))
    assert [r[0] for r in back.collect()] == ["src/a.ts::f", "p.x.f"]
    dirs = spark.createDataFrame([("a/b/c",), ("/x",), ("x",)], "p string").select(paths.dir_of("p"))
    assert [r[0] for r in dirs.collect()] == ["a/b", None, None]


def test_store(spark):
    store = Store(spark)
    file = store.create_node("file", "x.ts", file_path="src/x.ts")
    decision = store.create_decision("Use X", "d", "r", governs=[file, "src/new/"])
    assert store.edges.where("relation = 'GOVERNS'").count() == 2 and store.nodes.where("kind = 'path'").count() == 1
    with pytest.raises(ValueError):
        store.create_decision("bad", "", "", references=["nope"])
    assert store.update_decision(decision, title="Use Y", rationale="r") == ["title"]
    store.promote(decision, "team")
    store.delete_node(file)
    assert store.edges.count() == 1 and [e["kind"] for e in store.events] == ["decision.created", "decision.updated", "decision.promoted"]
    store.delete_decision(decision)
    assert store.edges.count() == 0


def test_annotations_go_with_their_decision_and_edge(spark):
    store = Store(spark)
    a, b = store.create_node("file", "a.ts"), store.create_node("file", "b.ts")
    decision = store.create_node("decision", "D")
    edges = [store.create_edge(a, b, r) for r in ("CALLS", "IMPORTS")] + [store.create_edge(b, b, "CALLS")]
    made = [store.create_annotation(decision, e) for e in edges]
    assert store.find_annotations(decision=decision).count() == 3 and [r.id for r in store.find_annotations(edge=edges[0]).collect()] == made[:1]
    with pytest.raises(ValueError):
        store.create_annotation(decision, "gone")
    store.delete_edge(edges[0])
    assert sorted(r.id for r in store.annotations.collect()) == sorted(made[1:])
    store.delete_node(a)
    assert [r.id for r in store.annotations.collect()] == made[2:]
    assert store.sql("select n.name from {nodes} n join {annotations} a on a.decision_id = n.id where kind = :kind", kind="decision").collect()[0].name == "D"
    store.delete_node(decision)
    assert store.annotations.isEmpty()


def test_many_writes_keep_the_plan_short(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.operators.store.FOLD_AFTER", 5)
    store = Store(spark)
    for i in range(12):
        store.create_node("file", f"f{i}")
    assert store.nodes.count() == 12 and store.nodes._jdf.queryExecution().analyzed().toString().count("Union") < 5


def test_git_scan_starts_at_the_head(spark):
    rows = [(s, i, t) for s in ("new", "known", "rebased") for i, t in enumerate(["h3\x00c\x00x\x003", "M\ta.ts", "h2\x00b\x00x\x002", "h1\x00a\x00x\x001"])]
    seen = spark.createDataFrame([("known", "h1"), ("rebased", "h0"), ("silent", "h9")], "source string, hash string")
    found, heads = events.scan_git(spark.createDataFrame(rows, "source string, line_no int, text string"), seen)
    assert pairs(found.select("source", "hash")) == [("known", "h2"), ("known", "h3")]
    assert pairs(heads) == [("known", "h3"), ("new", "h3"), ("rebased", "h3"), ("silent", "h9")]


def test_views(spark):
    at = F.struct(F.lit(2.0).alias("x"), F.lit(4.0).alias("y"), F.lit(1.0).alias("opacity"), F.lit(1.0).alias("scale"))
    to = F.struct(F.lit(6.0).alias("x"), F.lit(8.0).alias("y"))
    look = lambda phase, age: tuple(spark.range(1).select(drawing.appearance(F.lit(phase), F.lit(age), at, to).alias("a")).first().a)
    assert look("entering", -5.0) == (6, 8, 0, 0) and look("entering", 280.0) == (6, 8, 1, 1) and look("entering", 200.0)[3] > 1
    assert look("exiting", 0.0) == (2, 4, 1, 1) and look("exiting", 110.0) == (4, 6, 0.75, 0.9) and look("exiting", 999.0) == (6, 8, 0, 0.6)
    nodes = spark.createDataFrame([("d", "decision", 0.0, 0.0), ("e", "decision", 1.0, 1.0), ("a", "file", 4.0, 0.0), ("b", None, 0.0, 8.0)], "id string, kind string, x double, y double")
    edges = edges_of(spark, ("d", "a", "GOVERNS"), ("d", "b", "GOVERNS"), ("e", "gone", "GOVERNS"), ("a", "b", "CALLS"))
    assert pairs(drawing.governance_pull(nodes, edges)) == [("d", 2.0, 4.0, 2, 0.5, 1.0)]
    folded = edges.withColumn("aggregate", F.col("relation") == "CALLS")
    assert [r.source_id for r in drawing.hit_edge(folded, nodes, 2.0, 4.0, 0.1).collect()] == ["a"] and drawing.hit_edge(folded, nodes, 4.0, 8.0, 0.1).isEmpty()
    shown, left = filters.by_boxes(nodes, edges, {"file": False, "decision": True})
    assert pairs(shown.select("id")) == [("b",), ("d",), ("e",)] and pairs(left) == [("d", "b", "GOVERNS")]
    camera = F.struct(F.lit(3.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("zoom"))
    zoomed = drawing.zoom_at(camera, F.lit(9.0), F.lit(10.0), F.lit(20.0), 100.0, 80.0)
    before, after, zoom = spark.range(1).select(drawing.to_world(camera, F.lit(10.0), F.lit(20.0), 100.0, 80.0), drawing.to_world(zoomed, F.lit(10.0), F.lit(20.0), 100.0, 80.0), zoomed.zoom).first()
    assert tuple(before) == pytest.approx(tuple(after)) and zoom == 5


def test_search_and_union(spark):
    nodes = spark.createDataFrame([("1", "Function", "parseBody", "p.f"), ("2", "Class", "Router", "p_f")], "id string, label string, name string, qualified_name string")
    assert [r.id for r in filters.search_symbols(nodes, "BODY").collect()] == ["1"]
    assert [r.id for r in filters.symbol_by_name(nodes, "p_f").collect()] == ["2"]
    local = nodes.selectExpr("id", "label as kind", "name", "qualified_name", "null as file_path", "'personal' as tier", "null as created_at")
    index = {"projects": spark.createDataFrame([("x", "t", "/")], "name string, indexed_at string, root_path string"), "nodes": spark.createDataFrame([(7, "x", "Method", "m", "q", "")], "id long, project string, label string, name string, qualified_name string, file_path string")}
    assert pairs(unified_nodes(local, index, "x").where("id like 'cbm%'").select("id", "kind")) == [("cbm-7", "function")]
    assert unified_nodes(local, index).count() == 2


def test_hull_and_camera(spark):
    points = spark.createDataFrame([("g", float(x), float(y)) for x, y in [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)]], "part string, x double, y double")
    assert drawing.convex_hulls(points, "part").count() == 4
    camera = drawing.bounding_camera(points, 100, 100, 10).first()
    assert (camera.x, camera.y, camera.zoom) == (2, 2, 5)
    assert drawing.bounding_camera(points.limit(0), 100, 100).first().zoom == 1


def test_quotes_compare_all_short_items(spark):
    from loomgraph.sources.tables import quotes

    docs = spark.createDataFrame([(1, " ".join(f"w{i}x" for i in range(1200)))], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"w{i}x") for i in range(1200)], "item_id long, text string")
    assert quotes(docs, items).distinct().count() == 1200


def test_lines_in_very_many_spans(spark):
    rnd = random.Random(8)
    spans = [("f", f"s{k}", a, a + rnd.choice((0, 1, 5, 40, 300))) for k in range(300) for a in [rnd.randint(0, 400)]] + [("f", "none", 9, 3), ("g", "all", 0, 10**6)]
    lines = [("f", k) for k in range(-2, 750)] + [("g", 10**6), ("g", 10**6 + 1), ("h", 1)]
    got = joins.enclosing_symbols(spark.createDataFrame(lines, "file string, line int"), spark.createDataFrame(spans, "file string, sym string, start_line int, end_line int"), "file")
    narrowest = lambda f, line: min(((b - a, s) for g, s, a, b in spans if g == f and a <= line <= b), default=(0, None))[1]
    assert pairs(got) == sorted((f, line, narrowest(f, line)) for f, line in lines)
    # spans around one another: a product of lines and spans would have ten billion rows
    n = 100_000
    nested = spark.range(n).select(F.lit("f").alias("file"), F.concat(F.lit("s"), "id").alias("sym"), F.col("id").alias("start_line"), (2 * n - F.col("id")).alias("end_line"))
    found = joins.enclosing_symbols(spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("line")), nested, "file")
    assert found.where(F.concat(F.lit("s"), "line") == F.col("sym")).count() == n


def test_hulls_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    groups = {"square": [(rnd.randint(0, 9), rnd.randint(0, 9)) for _ in range(400)], "line": [(k, 2 * k) for k in range(50)], "one": [(1, 1)] * 3, "two": [(0, 1), (0, 5)], None: [(rnd.gauss(0, 1), rnd.gauss(0, 1)) for _ in range(300)]}
    ring = [(math.cos(k / 40 * math.pi), math.sin(k / 40 * math.pi)) for k in range(80)]
    points = spark.createDataFrame([(g, float(x), float(y)) for g, p in (groups | {"ring": ring}).items() for x, y in p] + [("one", None, 3.0)], "part string, x double, y double")

    def found():
        rows = {}
        for r in drawing.convex_hulls(points, "part").collect():
            rows.setdefault(r.part, []).append((r.position, r.x, r.y))
        return {g: [c[1:] for c in sorted(p)] for g, p in rows.items()}

    whole = found()
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    for g, p in (groups | {"ring": ring}).items():
        corners = whole[g]
        assert corners[0] == min((float(x), float(y)) for x, y in p) and len(set(corners)) == len(corners)
        if len(corners) > 2:  # every point is on the left of every side, and sides turn left
            sides = list(zip(corners, corners[1:] + corners[:1], strict=True))
            assert all(turn(a, b, c) >= -1e-12 for a, b in sides for c in p) and all(turn(a, b, c) > 0 for (a, b), (_, c) in zip(sides, sides[1:] + sides[:1], strict=True))
    assert whole["line"] == [(0, 0), (49, 98)] and whole["one"] == [(1, 1)] and whole["two"] == [(0, 1), (0, 5)] and len(whole["ring"]) == 80
    monkeypatch.setattr(drawing, "HULL_POINTS", 20)
    assert found() == whole
