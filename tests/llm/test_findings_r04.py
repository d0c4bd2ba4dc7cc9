"""Cases from the findings of round 4 on the training-data operators."""

import re

import numpy as np

from tidemark.llm import common, embedding_dedup


def test_nn_descent_broadcasts_nothing_that_grows(spark, monkeypatch):
    plans = []

    def seen(df, name):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return common.cut(df, name)

    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, base[i % 60].tolist() if i < 90 else (base[0] + 0.02 * rng.standard_normal(16)).tolist(), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    key = lambda x: sorted(map(tuple, x.collect()))
    want = key(embedding_dedup.near_duplicates(df))
    monkeypatch.setattr(embedding_dedup, "cut", seen)
    monkeypatch.setattr(embedding_dedup, "SENT_ROWS", 0)
    out = embedding_dedup.near_duplicates(df)
    plans.append(out._jdf.queryExecution().sparkPlan().toString())
    assert key(out) == want
    assert len(plans) > 10 and not [m for p in plans for m in re.findall(r"BroadcastHashJoin \[(?:id|a|b|component|embedding|label#\d+, )[^\]]*\]", p)]


def test_components_by_joins_that_are_not_sent(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 3)], "a long, b long")
    assert sorted(map(tuple, common.components(edges, most=0).collect())) == sorted(map(tuple, common.components(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 1)]
