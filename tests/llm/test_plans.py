"""Plans of operators that join their own results in rounds do not grow with the rounds."""

import numpy as np
from loomgraph.llm import mixing, quality


def estimated(df) -> int:
    """Bytes that the planner expects, by which it chooses joins."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_mixing_rounds_keep_their_size_estimate(spark):
    docs = [(k, f"s{k % 3}", "w " * (1 + k * k % 97)) for k in range(300)]
    sized = mixing.sizes(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    wanted = mixing.targets(sized)
    counts = sized.groupBy("key", "size").count().withColumnRenamed("count", "n")
    tilts = mixing.balance(counts, wanted)
    made = mixing.rounded(counts, tilts, wanted)
    assert tilts.count() == 3 and estimated(tilts) < 1 << 20
    assert made.columns == ["key", "size", "n", "rate", "copies"] and estimated(made) < 1 << 20


def test_quality_steps_keep_their_size_estimate(spark):
    points = np.random.default_rng(5).normal(size=(400, len(quality.FLOORS)))
    rows = [(f"p{k % 2}", k % quality.SALTS, k, *map(float, x)) for k, x in enumerate(points)]
    got = quality.estimates(spark.createDataFrame(rows, "part string, salt int, h long, " + ", ".join(f"{v} double" for v in quality.FLOORS)))
    assert got.count() == 2 and estimated(got) < 1 << 20
