"""Greedy diversity orders over tables larger than what the driver holds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from loomsift.operators import selection
from loomsift.plans import catalog


def slow_order(keys, m, u, k, penalty=None):
    """The order by plain loops; without a penalty by farthest point."""
    m = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1)
    order = []
    while len(order) < min(k, len(keys)):
        near = np.max([m @ m[i] for i in order], axis=0) if order else np.zeros(len(keys))
        value = u - penalty * near if penalty is not None else 1 - near if order else m @ m.mean(axis=0)
        value[order] = -np.inf
        order.append(int(np.argmax(value)))
    return [keys[i] for i in order]


@pytest.mark.parametrize("held", [1, 12, 20_000])
def test_orders_of_a_table_of_any_size(spark, monkeypatch, held):
    monkeypatch.setattr(selection, "MOST_SHORTLISTED", held)
    rnd = random.Random(held)
    m = np.array([[rnd.gauss(0, 1) for _ in range(5)] for _ in range(150)])
    u = np.array([rnd.random() for _ in range(150)])
    df = spark.createDataFrame([(i, m[i].tolist(), float(u[i])) for i in range(150)], "id bigint, v array<double>, u double")
    assert selection.k_center(df, "id", "v", 25) == slow_order(range(150), m, u, 25)
    assert selection.marginal_relevance(df, "id", "v", "u", 25, 0.7) == slow_order(range(150), m, u, 25, 0.7)
    assert sorted(selection.k_center(df.where("id < 7"), "id", "v", 25)) == list(range(7))
    assert selection.k_center(df.where("id < 0"), "id", "v", 25) == []


def test_orders_take_every_label(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)], i % 3) for i in range(90)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    m = np.array([v for _, v, _ in rows], np.float32).astype(float)
    got = {n: [r.vec_id for r in catalog.QUERIES[n](spark, str(tmp_path)).orderBy("place").collect()] for n in ("diverse_order", "relevant_order")}
    assert got == {"diverse_order": slow_order(range(90), m, None, 50), "relevant_order": slow_order(range(90), m, m[:, 0], 50, 0.5)}
