"""Inverted lists against the exact search."""

import numpy as np

from lantern.operators import neighbours, vector


def test_recall_at_a_tenth_of_the_vectors(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 3000)] + 0.25 * rng.normal(size=(3000, 16))
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (None, [1.0] * 16)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    path = f"{tmp_path}/lists"
    neighbours.build(v, path)
    centres, sizes = neighbours._centres(spark, path)
    assert sizes.sum() == 3000 and len(sizes) == 55
    queries = v.where("vec_id % 50 = 0")
    found = neighbours.search_many(spark, path, queries, 10, 0.1)
    assert neighbours.recall(v, queries, found, 10) >= 0.95
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    read = [sizes[p].sum() for p in neighbours.probed(units[::50], centres, sizes, 0.1)]
    assert max(read) <= max(300, sizes.max())
    # All lists: the exact search
    every = {(r["query_id"], r["rank"]): r["id"] for r in neighbours.search_many(spark, path, queries, 5, 1.0).collect()}
    assert every == {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.batch_top_k(v, queries, 5).collect()}
    one = [r["id"] for r in neighbours.search(spark, path, points[7].tolist(), 3, 1.0).collect()]
    assert one == [r["vec_id"] for r in vector.top_k(v.where("vec_id < 9000"), points[7].tolist(), 3).collect()]


def test_blocks_of_crowded_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 7)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(120)], "vec_id long, embedding array<double>")
    neighbours.build(v, f"{tmp_path}/l", lists=3)
    got = {(r["query_id"], r["rank"]): r["id"] for r in neighbours.search_many(spark, f"{tmp_path}/l", v, 4, 1.0).collect()}
    assert got == {(r["query_id"], r["rank"]): r["vec_id"] for r in vector.batch_top_k(v, v, 4).collect()}


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    neighbours.build(none, f"{tmp_path}/l")
    assert neighbours.search_many(spark, f"{tmp_path}/l", none, 3).count() == 0
