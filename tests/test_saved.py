import pytest

from loomgraph.sources.saved import SavedGraph

NODE, EDGE = "id string, kind string, name string, qualified_name string, file_path string, data string, tier string, created_at string, updated_at string", "id string, source_id string, target_id string, relation string, data string, created_at string"


def node(i, name="n", at="1", tier="personal"):
    return (i, "file", name, None, None, "{}", tier, "0", at)


def test_changes_last_and_reach_their_buckets_alone(spark, tmp_path):
    folder = str(tmp_path / "graph")
    kept = SavedGraph(spark, folder, buckets=4)
    kept.upsert("nodes", spark.createDataFrame([node(c) for c in "abcdefgh"], NODE))
    kept.upsert("edges", spark.createDataFrame([(f"{s}{t}", s, t, "CALLS", "{}", "0") for s, t in ("ab", "bc", "cc", "de")], EDGE))
    kept.upsert("annotations", spark.createDataFrame([("1", "a", "de", "0"), ("2", "e", "bc", "0"), ("3", "e", "de", "0")], "id string, decision_id string, edge_id string, created_at string"))
    kept.upsert("nodes", spark.createDataFrame([node("a", "old", "2"), node("a", "new", "3"), node("z")], NODE))  # one id twice
    changed = kept._table("nodes").live()
    assert set(changed.values()) == {1, 2} or len(set(changed)) < 4
    kept.remove_nodes(spark.createDataFrame([("b",), ("none",)], "id string"))
    again = SavedGraph(spark.newSession(), folder, "again", buckets=9)  # buckets stay as they were
    assert again.number == 4 and again.version == 3
    assert sorted((r.id, r.name) for r in again.read("nodes").collect()) == [("a", "new"), *((c, "n") for c in "cdefghz")]
    assert sorted(r.id for r in again.read("edges").collect()) == ["cc", "de"]
    assert sorted(r.id for r in again.read("annotations").collect()) == ["1", "3"]
    assert [r.id for r in again.read("nodes", spark.createDataFrame([("z",), ("b",)], "id string")).collect()] == ["z"]
    assert again.list_tables() == ["again_annotations", "again_edges", "again_events", "again_nodes"]
    assert ("tier", "string") in again.columns("nodes") and again.spark.sql("select count(*) from again_events").first()[0] == 0


def test_an_older_version_is_migrated_once(spark, tmp_path, monkeypatch):
    from loomgraph.sources import saved

    folder = str(tmp_path / "graph")
    old = SavedGraph(spark, folder, buckets=4, version=1)
    old.load("nodes", spark.createDataFrame([("a", "file", "A", None, None, None, "1"), ("b", "file", None, None, None, "{}", "2")], saved.VERSIONS[1]["nodes"]))
    old.load("edges", spark.createDataFrame([("a", "b", "CALLS", "1"), ("a", "b", "CALLS", "0"), ("a", None, "CALLS", "1")], saved.VERSIONS[1]["edges"]))

    def fails(tables):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setitem(saved.STEPS, 3, fails)
        with pytest.raises(RuntimeError):
            SavedGraph(spark, folder)
    assert SavedGraph(spark, folder, version=2).version == 2  # the first step was done, and holds
    new = SavedGraph(spark, folder)
    assert sorted((r.id, r.name, r.tier, r.updated_at) for r in new.read("nodes").collect()) == [("a", "A", "personal", "1"), ("b", None, "personal", "2")]
    edges = new.read("edges").collect()
    assert sorted((r.source_id, r.target_id or "", r.created_at, r.data) for r in edges) == [("a", "", "1", "{}"), ("a", "b", "0", "{}")] and len({r.id for r in edges}) == 2
    with pytest.raises(ValueError):
        SavedGraph(spark, folder, version=2)  # what is newer is not opened


def test_an_empty_graph(spark, tmp_path):
    kept = SavedGraph(spark, str(tmp_path / "graph"), "empty")
    kept.remove_nodes(spark.createDataFrame([], "id string"))
    kept.upsert("nodes", spark.createDataFrame([], NODE))
    assert kept.read("nodes").isEmpty() and spark.sql("select * from empty_edges").isEmpty()
