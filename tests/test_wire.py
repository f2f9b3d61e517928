from pyspark.sql import functions as F

from loomgraph.functions import wire

NODES = "id string, kind string, name string, qualified_name string, file_path string, data string, tier string, created_at string, updated_at string"


def test_decoding(spark):
    rows = [("1", "decision", "T", None, None, '{"status": "deprecated", "alternatives": [{"name": "a", "reason_rejected": "b"}]}', "team", "t", "t"), ("2", "decision", "U", None, None, "oops", "team", "t", "t")]
    nodes = spark.createDataFrame(rows, NODES)
    got = {r.id: r for r in wire.decisions(nodes).collect()}
    assert got["1"].status == "deprecated" and got["1"].alternatives[0].name == "a" and got["2"].status == "active" and got["2"].alternatives == []
    assert [(r.status, r.data[:1]) for r in wire.wire_nodes(nodes).orderBy("id").collect()] == [("deprecated", "{"), (None, "{")]
    asked = spark.createDataFrame([('{"type": "ping"}',), ('{"type": "x"}',), ("no",)], "m string").select(wire.decode_client(F.col("m")).alias("c")).collect()
    assert [r.c is not None for r in asked] == [True, False, False]


def test_ids_sort(spark):
    rows = [(0, 0), (0, 1), (0, 40), (1, 0), (1 << 40, 5)]
    ids = [r[0] for r in spark.createDataFrame(rows, "t long, n long").coalesce(1).select(wire.ulid(F.col("t"), F.col("n"))).collect()]
    assert ids == sorted(ids) and {len(i) for i in ids} == {26} and len(set(ids)) == 5
    assert spark.range(1).select(wire.escape_html(F.lit("<a & 'b'>"))).first()[0] == "&lt;a &amp; &#39;b&#39;&gt;"
    log = spark.createDataFrame([(1, "a", "x"), (2, "a", "y")], "seq int, key string, value string")
    assert [tuple(r) for r in wire.latest(log).collect()] == [("a", "y")]
