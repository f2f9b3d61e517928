import pyarrow as pa
import pyarrow.parquet as pq

from loomgraph.sources.connector import Connector, ReferenceReader
from pyspark.sql.datasource import EqualTo, StringEndsWith


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_and_resolve_are_pushed(spark, tmp_path):
    rows = [(k, None if k % 10 == 9 else "" if k % 10 == 8 else f"title {k} ümlaut 100%") for k in range(1000)]
    for half in (0, 1):
        own = rows[half * 500 : half * 500 + 500]
        pq.write_table(pa.table({"id": [k for k, _ in own], "extra": ["x"] * 500, "text": [t for _, t in own]}), tmp_path / f"{half}.parquet", row_group_size=100)
    jira = Connector(spark, "jira", str(tmp_path), url="https://jira/")
    assert jira.rows.count() == 1000 and jira.rows.where("title is null").count() == 100
    found = jira.search("le 77")
    assert sorted(int(r.id) for r in found.collect()) == sorted(k for k, t in rows if t and "le 77" in t)
    assert sorted(r.id for r in jira.search("100%").where("title like 'title 12%'").collect()) == sorted(str(k) for k, t in rows if t and t.startswith("title 12"))
    one = jira.resolve("123")
    assert [tuple(r) for r in one.collect()] == [("123", "jira", "title 123 ümlaut 100%", "https://jira/123", '{"length":21}')]
    assert one.rdd.getNumPartitions() == 1  # one of ten row groups
    assert "(id = 123)" not in plan(one).split("BatchScan")[0]  # the source sees to it
    assert sorted(r.id for r in jira.resolve("5", "999", "0005", "none", "1000").collect()) == ["5", "999"]
    assert jira.resolve("none", "nothing").collect() == [] and jira.resolve("4").where("id = '5'").collect() == []
    assert [r.metadata for r in jira.resolve("9").collect()] == [None]


def test_what_is_not_known_stays_with_spark():
    reader = ReferenceReader({"path": "/nowhere"})
    left = [EqualTo(("url",), "u"), StringEndsWith(("title",), "x")]
    assert list(reader.pushFilters([EqualTo(("id",), "1"), *left])) == left and reader.ids == {"1"}


def test_ids_of_text_and_empty_files(spark, tmp_path):
    pq.write_table(pa.table({"key": pa.array([], pa.string()), "body": pa.array([], pa.string())}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"key": ["b", None, "a", "a"], "body": ["x", "y", "x", None]}), tmp_path / "b.parquet")
    wiki = Connector(spark, "wiki", str(tmp_path), "key", "body")
    assert sorted((r.id, r.title or "") for r in wiki.resolve("a").collect()) == [("a", ""), ("a", "x")]
    assert wiki.rows.where("id is null").count() == 1 and wiki.search("x").count() == 2 and wiki.search("").count() == 3
