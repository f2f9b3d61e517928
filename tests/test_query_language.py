"""The whole query language against SQLite's full-text search, where that is there."""

import random
import sqlite3

import pytest

from loomgraph.operators import fulltext
from loomgraph.operators.segments import SegmentedIndex

DOC = "node_id string, title string, description string, rationale string"
QUERIES = (
    "aa", "aa bb", "aa OR bb", "aa NOT bb", "aa aa", '"aa bb"', "aa + bb", '"aa" + "bb cc"', "a*", "aa + b*", '"aa bb c" *', "^aa", '^"bb aa"', "^b*",
    "title:aa", "title : aa OR bb", "{title rationale}: aa", "- title: aa", "- {title rationale}: aa bb", "title: (aa OR bb)", "title: (aa NOT description: bb)", "title: ^aa",
    "NEAR(aa bb)", "NEAR(aa bb, 0)", "NEAR(aa bb, 1)", 'NEAR("aa bb" cc, 2)', "NEAR(aa bb cc, 3)", "NEAR(aa aa, 2)", "description: NEAR(aa c*, 1)", "NEAR(aa bb, 1) OR NEAR(cc dd, 1)", "cc NOT NEAR(aa bb, 2)", "NEAR(aa, 3)",
    "(aa OR bb) AND (cc OR dd)", "aa OR bb AND cc", "(aa OR bb) AND cc", "aa AND bb NOT cc", "aa NOT bb NOT cc", "aa NOT (bb OR cc)", "(aa NOT bb) OR cc", "((aa))", "aa bb OR cc dd",
    "été", "ete", "ÉTÉ", "été", "ộn", "on", '"l\'été"', "uber*", 'aa ""', "aa_bb", "nowhere",
)
BROKEN = ("NOT aa", "aa NOT", "(aa", "aa)", "aa OR", "AND aa", "NEAR(aa bb", "NEAR(aa bb, x)", "aa +", "^", "aa & bb", "title:", "{title: aa", '"aa', "")


def corpus(number: int) -> list[tuple]:
    rnd = random.Random(7)
    words = ["aa", "aa", "bb", "bb", "cc", "dd", "ab", "ba", "Été", "été", "ộn", "on", "l'été", "Über", "aa_bb"]
    text = lambda: rnd.choice((None, "", *(" ".join(rnd.choices(words, k=rnd.randint(1, 14))) for _ in range(4))))
    return [(f"d{k:03}", text(), text(), text()) for k in range(number)]


@pytest.fixture(scope="module")
def oracle():
    found = sqlite3.connect(":memory:")
    try:
        found.execute("create virtual table docs using fts5(node_id unindexed, title, description, rationale)")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text search")
    found.executemany("insert into docs values (?, ?, ?, ?)", corpus(120))
    return lambda q: dict(found.execute("select node_id, bm25(docs) from docs where docs match ?", (q,)).fetchall())


def test_every_form_as_the_oracle_ranks_it(spark, oracle, tmp_path):
    docs = spark.createDataFrame(corpus(120), DOC).coalesce(1).cache()
    index = fulltext.index(docs).coalesce(1).cache()
    sizes = fulltext.lengths(index, docs).coalesce(1).cache()
    wrong = []
    for query in QUERIES:
        want = {k: round(v, 6) for k, v in oracle(query).items()}
        for way, rows in (("index", fulltext.search(index, sizes, query)), ("texts", fulltext.search_texts(docs, query))):
            got = {r.node_id: round(r["rank"], 6) for r in rows.collect()}
            if got.keys() != want.keys() or any(abs(got[k] - want[k]) > 2e-6 for k in got):
                wrong.append((query, way, len(want), len(got), sorted(want.items() ^ got.items())[:4]))
    assert not wrong, "\n".join(map(str, wrong))


def test_segments_know_the_same_language(spark, oracle, tmp_path):
    kept = SegmentedIndex(spark, str(tmp_path / "index"), buckets=4)
    kept.update(spark.createDataFrame(corpus(120), DOC))
    for query in ("NEAR(aa bb, 1) OR ^cc", "(été OR uber*) NOT title: aa"):
        assert {r.node_id: pytest.approx(r["rank"], abs=1e-6) for r in kept.search(query).collect()} == oracle(query)


@pytest.mark.parametrize("query", BROKEN)
def test_what_cannot_be_read(query):
    with pytest.raises(ValueError):
        fulltext.Query(query)
