"""Vector links in tables of several hundred lists, a third of them one group of near copies."""

import os
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import helpers as H  # noqa: E402

from lotwise.llm import pq  # noqa: E402


@pytest.mark.parametrize("block", [None, 300])
def test_all_links_of_a_hot_group(spark, monkeypatch, block):
    monkeypatch.setattr(pq, "LIST_ROWS", 16)  # 375 lists
    if block:
        monkeypatch.setattr(pq, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 64))
    centre = rng.normal(size=64)
    x[::3] = centre + rng.normal(scale=0.175, size=(2000, 64))  # pairwise cosine about 0.97
    x[1::300] = x[2::300] + rng.normal(scale=0.25, size=(20, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -1)
    assert not ((g > 0.9 - 1e-9) & (g < 0.9 + 1e-9)).any()
    a, b = np.nonzero(g >= 0.9)
    assert len(a) > 3_000_000
    n = Counter(a.tolist())
    want = H.components(range(len(x)), [(int(i), int(j)) for i, j in zip(a, b) if i % 3 or j % 3 or i == 0])
    got = {r.vec_id: r for r in pq.link_vectors(df).collect()}
    assert {i: r.n_links for i, r in got.items()} == {i: n[i] for i in range(len(x))}
    assert {i: r.component_id for i, r in got.items()} == want


def test_recall_of_spread_vectors(spark, monkeypatch):
    """Vectors spread evenly over many lists, with links right at the threshold: found links are true, 95 % and more
    of the links are found, of a wide group as well."""
    monkeypatch.setattr(pq, "LIST_ROWS", 16)  # 500 lists
    monkeypatch.setattr(pq, "BLOCK", 700)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for i in range(0, 4000, 2):  # pairs of cosine 0.9 to 0.92
        side = rng.normal(size=64)
        side -= (side @ x[i]) * x[i]
        c = rng.uniform(0.9002, 0.92)
        x[i + 1] = c * x[i] + np.sqrt(1 - c * c) * side / np.linalg.norm(side)
    x[7000:] = x[7000] + rng.normal(scale=0.041, size=(1000, 64))  # a group about as wide as links are
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T
    np.fill_diagonal(g, -1)
    n = (g >= 0.9).sum(1)
    got = {r.vec_id: r.n_links for r in pq.link_vectors(df).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= n).all()
    assert found[:7000].sum() >= 0.95 * n[:7000].sum()
    assert found[7000:].sum() >= 0.95 * n[7000:].sum() > 1000
