"""Ranked search against a plain scoring of every document."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np

from loomgraph.llm import lexical, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, top=20):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for doc, c in counts:
            m = 75 + (25 * c.total() * n_docs) // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def test_search_against_every_document(spark):
    rnd = random.Random(13)
    words = [f"w{k}" for k in range(60)] + ["Ärger", "ß", "中文", "ÀB", "àb"]
    docs = [(k, rnd.choice((" ", ", ", "\n", "-")).join(rnd.choices(words, k=rnd.choice((1, 5, 30, 80))))) for k in range(1, 300)]
    docs += [(k + 1000, t) for k, t in docs[:60]]  # ties
    docs += [(2001, None), (2002, ""), (2003, "?! \x7f"), (None, "w1 w2 w3"), (-5, "W1 w2 W3"), (2004, "w1 " * 30000)]
    rnd.shuffle(docs)
    items = [(k, " ".join(rnd.choices(words, k=rnd.choice((1, 3, 12))))) for k in range(40)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w1 w1 w2 W2"), (94, "ÀB")]
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, docs int, hashes string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item int, score int")
    got = lexical.search(lexical.build(table), asked)
    assert [*got.dtypes] == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == plain(docs, items)
    few = lexical.search(lexical.build(table), asked, 3)
    assert sorted(map(tuple, few.collect())) == plain(docs, items, 3)


def test_blocks_of_queries_give_what_one_block_gives(spark, monkeypatch):
    docs = [(k, f"a b c{k % 7} d{k % 11}") for k in range(90)]
    items = [(k, f"a c{k % 7} d{k}") for k in range(12)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "BLOCK", 20)
    assert sorted(map(tuple, lexical.search(index, asked).collect())) == plain(docs, items)


def test_merge_and_bytes():
    rnd = random.Random(2)
    for _ in range(500):
        values = np.array([rnd.randint(0, 1 << rnd.randint(0, 60)) for _ in range(rnd.randint(0, 20))], np.int64)
        assert (lexical.unpack(lexical.pack(values)[0]) == values).all()
        n, lists = rnd.randint(1, 60), []
        for _ in range(rnd.randint(0, 8)):
            places = sorted(rnd.sample(range(n), rnd.randint(0, n)))
            adds = [rnd.randint(0, rnd.choice((3, 50))) for _ in places]
            lists.append((places, adds, max(adds, default=0)))
        total = Counter()
        for places, adds, _ in lists:
            total.update(dict(zip(places, adds, strict=True)))
        top = rnd.randint(1, 6)
        assert lexical.best(lists, top) == sorted(((s, p) for p, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:top]


def test_no_documents_or_queries(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(docs), items).count() == 0
    assert lexical.search(lexical.build(spark.createDataFrame([(1, None)], "doc_id long, text string")), items).count() == 0
    assert lexical.search(lexical.build(spark.createDataFrame([(1, "a")], "doc_id long, text string")), items.limit(0)).count() == 0


def test_the_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from '{folder}/{name}.parquet'")
    assert sorted(map(tuple, queries.op13_ranked_search(spark, folder).collect())) == sorted(duckdb.sql(queries.SEARCH_SQL).fetchall())
