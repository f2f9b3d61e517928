"""Views kept up to date against views from scratch."""

import random
from pathlib import Path

from loomgraph.plans.maintained import EdgeView
from loomgraph.plans.projection import aggregate_edges

EDGE, REP = "source_id string, target_id string, relation string", "id string, rep string"


def shown(rows):
    return sorted((r.source_id, r.target_id, r.aggregate, r["count"], r.relation, tuple(sorted(r.relations.items()))) for r in rows.collect())


def test_changes_give_what_a_view_from_scratch_gives(spark, tmp_path):
    rnd = random.Random(7)
    nodes = [f"n{k}" for k in range(14)]
    edge = lambda: (rnd.choice(nodes), rnd.choice(nodes), rnd.choice("XY"))
    rep = lambda n: rnd.choice((n, n, "g1", "g2"))
    edges, reps = {edge() for _ in range(40)}, {n: rep(n) for n in nodes[:11]}
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    view = EdgeView(spark, str(tmp_path / "view"), 4).start(frame(edges, EDGE), frame(reps.items(), REP))
    for _ in range(4):
        before = {x[:2]: x for x in shown(view.edges())}
        added = {edge() for _ in range(rnd.randint(0, 6))}
        removed = {*rnd.sample(sorted(edges), rnd.randint(0, 6)), edge()} - added
        moves = {n: rnd.choice((None, rep(n))) for n in rnd.sample(nodes, rnd.randint(0, 5))}
        changed = view.apply(frame(added, EDGE), frame(removed, EDGE), spark.createDataFrame(list(moves.items()), REP))
        edges = (edges - removed) | added
        reps = {n: r for n, r in (reps | moves).items() if r is not None}
        want = shown(aggregate_edges(frame(edges, EDGE), frame(reps.items(), REP)))
        assert shown(view.edges()) == want
        pairs = {tuple(r) for r in changed.collect()}
        told = lambda rows: {p: sorted(x for x in rows if x[:2] == p) for p in {x[:2] for x in rows}}
        old, new = told(list(before.values())), told(want)
        assert {p for p in old.keys() | new.keys() if p not in pairs and (p in old) != (p in new)} == set()
        assert shown(view.edges(changed)) == [x for x in want if x[:2] in pairs]


def test_a_change_reads_and_writes_only_the_buckets_it_touches(spark, tmp_path):
    edges = [(f"a{k}", f"b{k}", "X") for k in range(400)]
    view = EdgeView(spark, str(tmp_path / "view"), 32).start(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(e, e) for x in edges for e in x[:2]], REP))
    view.apply(spark.createDataFrame([], EDGE), spark.createDataFrame(edges[:1], EDGE), spark.createDataFrame([], REP))
    live = view.counts.live()
    assert sum(v == 2 for v in live.values()) == 1 and sum(v == 2 for v in view.incident.live().values()) <= 2
    touched = view.counts.touched(spark.createDataFrame(edges[:1], EDGE))
    files = {f.split("bucket=")[1].split("/")[0] for f in view.counts.read(touched).inputFiles()}
    assert files <= {str(b) for b in touched} and "PartitionFilters" in view.counts.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert view.edges().count() == 399


def test_a_small_change_leaves_the_ends_and_no_shuffle_files(spark, tmp_path):
    edges = [(f"a{k}", f"b{k}", "X") for k in range(100)]
    view = EdgeView(spark, str(tmp_path / "view"), 4).start(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(e, e) for x in edges for e in x[:2]], REP))
    none = spark.createDataFrame([], EDGE)
    ends = {f: f.stat().st_mtime_ns for f in (tmp_path / "view" / "incident").rglob("*.parquet")}
    shuffles = lambda: {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    before = shuffles()
    view.apply(none, spark.createDataFrame(edges[:2], EDGE), spark.createDataFrame([("a9", "g")], REP))
    assert shuffles() <= before
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "view" / "incident").rglob("*.parquet")} == ends and view.changes.read().count() == 4
    view.apply(spark.createDataFrame(edges[:1], EDGE), none, spark.createDataFrame([], REP))
    assert {r.source_id for r in view.edges().collect()} == {"g", *(f"a{k}" for k in range(100) if k not in (1, 9))}
    view.apply(none, spark.createDataFrame(edges[20:60], EDGE), spark.createDataFrame([], REP))
    assert view.changes.read().count() == 0 and view.incident.read().count() == 2 * 59 and view.edges().count() == 59
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
