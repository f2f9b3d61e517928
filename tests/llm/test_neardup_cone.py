"""Vectors in narrow cones, as real embeddings lie, against all pairs."""

import numpy as np

from loomgraph.llm import neardup


def cone(rnd, n, closeness, dims=64):
    centre = rnd.standard_normal(dims)
    spread = rnd.standard_normal((n, dims)) / np.sqrt(dims)
    x = centre / np.linalg.norm(centre) + spread * np.sqrt(1 / closeness**2 - 1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_links_in_cones(spark):
    rnd = np.random.default_rng(4)
    # one label of one cone, one of many, one spread evenly with near pairs
    spread = rnd.standard_normal((3000, 64))
    spread[1500:] = spread[:1500] + 0.35 * rnd.standard_normal((1500, 64))
    groups = {"one": cone(rnd, 6000, 0.94), "many": np.concatenate([cone(rnd, 1200, 0.935) for _ in range(5)]), "even": spread}
    rows, want = [], {}
    for label, x in groups.items():
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        at = len(rows)
        rows += [(at + k, label, v.tolist()) for k, v in enumerate(x)]
        for a in range(0, len(x), 1000):
            linked = x[a : a + 1000] @ x.T >= neardup.COSINE
            want |= {at + a + k: int(v) - 1 for k, v in enumerate(linked.sum(1))}
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")).collect()}
    found, true = sum(got.values()), sum(want.values())
    assert true > 20000 and all(got[k] <= want[k] for k in want)
    for low, high in ((0, 6000), (6000, 12000), (12000, 15000)):
        assert sum(got[k] for k in range(low, high)) >= 0.99 * sum(want[k] for k in range(low, high)), (low, found, true)
