"""The pipeline against its stages' verdicts applied one by one in plain Python."""

import collections
import hashlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import bpe, jaccard, mixing, quality, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    frame = lambda ids: spark.createDataFrame([rows[i] for i in sorted(ids)], docs.schema)
    left = {r.doc_id for r in quality.quality(docs).collect() if r.kept}
    left = {r.doc_id for r in toxicity.toxicity(frame(left), spark.read.parquet(f"{SF}/labels.parquet")).collect() if not r.predicted}
    left = {r.doc_id for r in jaccard.jaccard(frame(left)).collect() if r.component_id == r.doc_id}
    key_of = {r.row_key: r.row.doc_id for r in corpus_pipeline._keyed(docs).collect()}  # ranks documents of one size
    copies = {key_of[r.doc_id]: r.copies for r in mixing.mix(corpus_pipeline._by_key(frame(left))).collect() if r.copies}
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter(r.doc_id for r in got) == copies
    table = bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))).bytes
    for r in got:
        text = rows[r.doc_id].text.encode()
        assert b"".join(table[i] for i in np.frombuffer(r.ids, "<u4")) == text and r.decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_rows_that_share_an_id(spark):
    """Verdicts hold for rows without an id, and for one of two rows of an id."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdict = {r.doc_id: r.kept for r in quality.quality(docs).collect()}
    clean, junk = ([r for r in docs.collect() if verdict[r.doc_id] == v] for v in (True, False))
    same = lambda r, i: (i, *r[1:])
    rows = [*map(tuple, clean[:40]), *map(tuple, junk[:10]), same(junk[0], clean[0].doc_id), same(junk[1], None), same(clean[1], None), same(clean[2], None)]
    odd = spark.createDataFrame(rows, docs.schema)
    left = corpus_pipeline.quality_rules(spark, odd, SF).collect()
    assert collections.Counter(r.text for r in left if r.doc_id is None) == collections.Counter([clean[1].text, clean[2].text])
    assert [r.text for r in left if r.doc_id == clean[0].doc_id] == [clean[0].text]
    left = corpus_pipeline.one_of_each(spark, odd.unionByName(odd), SF).collect()
    assert len({r.text for r in left}) == len(left) and {r.doc_id for r in left if r.text == clean[1].text} == {clean[1].doc_id}
    twice = spark.createDataFrame([same(clean[0], 5), same(clean[1], 5), same(clean[1], 5)], docs.schema)
    sizes = {r.text: len(r.text.split()) for r in clean[:2]}
    mixed = corpus_pipeline.mixed(spark, twice, SF).collect()
    assert abs(sum(sizes[r.text] for r in mixed) - sum(sizes[t] for t in (clean[0].text, clean[1].text, clean[1].text))) <= max(sizes.values())


def test_extra_columns_of_any_name_keep_their_values(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    names = ["n", "copies", "mix_copies", "row_key", "row", "component", "first", "order", "kept", "predicted", "component_id", "a.b"]
    wide = docs
    for k, name in enumerate(names):
        wide = wide.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, wide, SF)
        assert left.columns == wide.columns
        rows = left.collect()
        assert rows and all(r[name] == f"{k}-{r.doc_id}" for r in rows for k, name in enumerate(names))
    assert corpus_pipeline.encoded(spark, wide, SF).count() == 60


def test_run_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
