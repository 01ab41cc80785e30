"""The cell index against all pairs: exact bounds, recall of probes, ties, and groups that are cut into tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import links, vectors

SCHEMA = "service string, id long, embedding array<float>, cell string"


def clustered(n, seed, dims=16, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(12, size=n)] + spread * rng.normal(size=(n, dims)) * np.linalg.norm(centres, axis=1).mean() / 4
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def table(spark):
    x = clustered(1500, 4).astype(np.float32)
    rows = [("hot" if i % 3 else f"s{i % 7}", i, v.tolist(), "own") for i, v in enumerate(x)]
    rows += [("hot", 2000 + i, x[1].tolist(), "own") for i in range(20)] + [("hot", 3000, None, ""), ("hot", 3001, [0.0] * 16, ""), ("hot", 3002, (3 * x[1]).tolist(), "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def all_pairs(table, least):
    by = {}
    for r in table.collect():
        if r.embedding and any(r.embedding):
            by.setdefault(r.service, []).append((r.id, np.array(r.embedding, np.float64)))
    out = {}
    for own in by.values():
        ids, x = [i for i, _ in own], np.stack([v for _, v in own])
        sim = x @ x.T
        out |= {(ids[i], ids[j]): sim[i, j] for i, j in zip(*np.nonzero(sim >= least), strict=True) if i != j}
    return out


@pytest.mark.parametrize("least", [0.9, -2.0])
def test_bounds_lose_no_pair(table, monkeypatch, least):
    monkeypatch.setattr(vectors, "BLOCK", 200)  # the hot service is many tiles
    want = all_pairs(table, least)
    index = vectors.CellIndex(table, ["service"])
    got = index.matches(table, least).toPandas()
    assert not got.duplicated(["id", "other"]).any()
    have = dict(zip(zip(got["id"], got["other"], strict=True), got["sim"], strict=True))
    assert have.keys() == want.keys() and all(abs(have[p] - want[p]) < 1e-9 for p in want)
    compared = index.searched(table, least).agg(F.sum("members")).first()[0]
    if least == 0.9:
        assert compared < len(all_pairs(table, -2.0)) / 3  # most cells are out of reach


def test_best_of_each(table):
    want = links.nearest(table.sparkSession.createDataFrame([(a, b, round(float(s), 9)) for (a, b), s in all_pairs(table, -2.0).items()], "id long, other long, sim double"), 3)
    index = vectors.CellIndex(table, ["service"])
    exact = links.nearest(index.matches(table, k=3).withColumn("sim", F.round("sim", 9)), 3).select("id", "other", "rn").cache()
    assert sorted(exact.collect()) == sorted(want.select("id", "other", "rn").collect())
    near = links.nearest(index.matches(table, k=3, probes=24).withColumn("sim", F.round("sim", 9)), 3)
    assert vectors.recall(near, exact) >= 0.9
    assert index.searched(table, probes=24).agg(F.sum("members")).first()[0] < index.searched(table).agg(F.sum("members")).first()[0] / 2


def test_no_vectors(table):
    assert vectors.CellIndex(table.limit(0), ["service"]).matches(table, 0.5).collect() == []
    assert vectors.CellIndex(table, ["service"]).matches(table.limit(0), 0.5).collect() == []
