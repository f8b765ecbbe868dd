"""Boosted trees per silo: the table of leaves gives the same scores as the fitted models."""

import numpy as np
import pytest

from silovalue.operators import combine as A, trees


def test_leaf_table_scores_like_the_models(spark):
    random = np.random.RandomState(0)
    x = random.normal(size=(80, 2))
    data = [(i, i % 2, [float(a), float(b)], [1.0 if a * b > 0 else 0.0, 1.0 if a * b <= 0 else 0.0]) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(data, "row_id bigint, client_id bigint, features array<double>, target array<double>")
    models = trees.fit_trees_per_client(df, 2, rounds=2, depth=2)
    table = trees.tree_table(spark, models).collect()
    assert {(r.client_id, r.tree_id) for r in table} == {(s, t) for s in "01" for t in range(4)}
    scored = trees.silo_scores(df.select("row_id", "features"), models).collect()
    for r in scored[:20]:
        for silo in "01":
            want = np.zeros(2)
            for leaf in table:
                inside = all((r.features[c.feature] <= c.threshold) == c.below for c in leaf.conditions)
                if leaf.client_id == silo and inside:
                    want[leaf["class"]] += leaf.score
            assert r.silo_scores[silo] == pytest.approx(list(want))
    pooled = A.bag_trees(None, trees.tree_table(spark, models))
    assert pooled.select("tree_id").distinct().count() == 8
