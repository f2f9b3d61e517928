"""A segmented index against an index of all documents made anew."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import fulltext
from loomgraph.operators.segments import SegmentedIndex

DOC = "node_id string, title string, description string, rationale string"


def test_updates_rank_as_a_rebuilt_index_does(spark, tmp_path):
    rnd = random.Random(10)
    words = [f"w{a}{b}" for a in "abc" for b in range(6)] + ["Über", "x"]
    text = lambda: rnd.choice((None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 12)))))
    kept, docs = SegmentedIndex(spark, str(tmp_path / "index"), buckets=8), {}
    for step in range(6):
        changed = {f"d{rnd.randint(0, 90)}": (text(), text(), text()) for _ in range(rnd.randint(10, 15))}
        removed = set(rnd.sample(sorted(docs), min(len(docs), 2))) - changed.keys()
        kept.update(spark.createDataFrame([(k, *v) for k, v in changed.items()], DOC), spark.createDataFrame([(k,) for k in sorted(removed)], "node_id string") if step else None)
        docs = {k: v for k, v in (docs | changed).items() if k not in removed}
        assert sum(n for n, _ in kept.segments().values()) == len(docs)
    assert len(kept.segments()) < 6  # some were merged
    frame = spark.createDataFrame([(k, *v) for k, v in docs.items()], DOC)
    anew = fulltext.index(frame)
    sizes = fulltext.lengths(anew, frame)
    for query in ("wa0", "wa1 OR wb2", "wa1 wb1", "wa2 NOT wc3", "w*", "wb*", '"wa0 wb1"', "title:wa3", "über", "nowhere"):
        want = [(r.node_id, pytest.approx(r["rank"])) for r in fulltext.search(anew, sizes, query).collect()]
        assert [(r.node_id, r["rank"]) for r in kept.search(query).collect()] == want


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    kept = SegmentedIndex(spark, str(tmp_path / "index"), ("title",), buckets=16)
    kept.update(spark.createDataFrame([(str(k), chr(97 + k) * 3 + " zz") for k in range(26)], "node_id string, title string"))
    found = kept.postings(fulltext.Query("aaa OR bb*"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    read = plan.split("PartitionFilters")[1].split("]")[0]
    assert len({b for b in range(16) if f"{b}" in read.replace(",", " ").replace(")", " ").replace("(", " ").split()}) <= 2
    assert sorted(r.node_id for r in kept.search("aaa OR bb*").collect()) == ["0", "1"]


def test_postings_of_rows_are_those_of_the_index_without_shuffles_or_copies(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda: rnd.choice((None, "", "x", "Über uber", " ".join(rnd.choices(("a", "B", "b", "é", "of-the", "10"), k=rnd.randint(1, 40)))))
    docs = spark.createDataFrame([(f"d{k}", text(), text(), text()) for k in range(80)], DOC)
    key = ["node_id", "column", "term", "at"]
    made, want = fulltext.row_postings(docs), fulltext.index(docs)
    assert sorted(map(tuple, made.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    sizes = {r.node_id: r.words for r in fulltext.lengths(want, docs).collect()}
    assert {r.node_id: r.words for r in fulltext.word_counts(docs).collect()} == sizes
    assert {(r.node_id, r.words) for r in made.collect()} <= set(sizes.items())
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    # an update writes the segment and little besides: neither a second copy of the postings nor shuffle files stay
    files = lambda folder: sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())
    local = lambda: {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in Path(d.getPath()).rglob("shuffle_*")}
    shared, kept = spark.sparkContext.getCheckpointDir().removeprefix("file:"), SegmentedIndex(spark, str(tmp_path / "index"), buckets=4)
    large = spark.range(20).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("node_id"), F.lit(None).cast("string").alias("title"), F.expr("array_join(transform(sequence(1, 4000), k -> 'w' || hash(id, k)), ' ')").alias("description"), F.lit("").alias("rationale"))
    before, held = local(), files(shared)
    kept.update(large)
    assert local() <= before and files(shared) - held < 200_000
    assert spark.read.parquet(str(tmp_path / "index" / "segments")).count() > 79_000
