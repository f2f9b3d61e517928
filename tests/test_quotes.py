import random

import pytest

from loomgraph.sources import tables


@pytest.mark.parametrize("rows", [200_000, 0])
def test_every_quote_is_found(spark, monkeypatch, rows):
    monkeypatch.setattr(tables, "ITEM_ROWS", rows)
    rnd = random.Random(3)
    words = ["a", "b", "ab", "ba", "of", "the"]
    docs = [(k, rnd.choice((None, "", *(rnd.choice((" ", "\n", "")).join(rnd.choices(words, k=rnd.randint(1, 40))) for _ in range(3)), " ".join(rnd.choices(words, k=60))))) for k in range(150)]
    items = [(k, rnd.choice((" ", " ", "\n", "  ")).join(rnd.choices(words, k=n))) for k, n in enumerate([1, 1, 2, 2, 3, 3, 3, 4, 4, 4, 5, 6] * 3)] + [(90, None), (91, ""), (92, " "), (93, "a "), (94, " a b"), (95, "the of "), (96, "b a b a ")]
    long = [t for _, t in docs if t and len(t) > 60]
    items += [(100 + k, rnd.choice(long)[k % 7 : 50 + k]) for k in range(12)]  # also cut within words
    items += [(200, items[-1][1])]
    found = tables.quotes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = sorted((f"d-{d}", f"b-{i}") for d, t in docs for i, x in items if t is not None and x and x in t)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 300
    if rows:
        assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString())
        assert all("text" not in line.split("[plan_id")[0] for line in plan.splitlines() if "Exchange hashpartitioning" in line)  # only what is found is shuffled
    none = tables.quotes(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert none.collect() == []
