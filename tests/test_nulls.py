"""Nulls of clustering against plain Python, draws and all; the registered queries run all draws, at all neighbourhood sizes."""

import hashlib

import numpy as np
import pytest

from voxloom.operators import components, inference
from voxloom.plans import catalog, spatial
from voxloom.scratch import Scratch

def test_clustering_null_runs_the_whole_sweep(spark, sf_dir, monkeypatch):
    seen, sweep = {}, inference.clustering_sweep

    def spy(points, broken, radius, eps, draws, seed):
        seen.update(eps=tuple(eps), draws=draws)
        return sweep(points, broken, radius, eps, 3, seed)

    monkeypatch.setattr(spatial.inference, "clustering_sweep", spy)
    got = catalog.QUERIES["clustering_null"](spark, sf_dir)
    assert seen == {"eps": inference.SWEEP, "draws": 400}
    assert sorted(r["eps_d"] for r in got.collect()) == [0.6, 0.8, 1.0, 1.25, 1.5, 2.0]


def test_stratified_null_has_sixty_draws(spark, sf_dir):
    got = catalog.QUERIES["stratified_null"](spark, sf_dir)
    assert sorted(r["replica"] for r in got.collect()) == list(range(60))


def clusters(points, eps, min_points, least):
    """{id: cluster} of one draw, by definition; points is {id: place}."""
    ids = sorted(points)
    near = {i: [j for j in ids if np.linalg.norm(points[i] - points[j]) <= eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= min_points}
    top, left = {}, set(core)
    while left:
        first = min(left)
        todo, left = [first], left - {first}
        while todo:
            at = todo.pop()
            top[at] = first
            todo += [j for j in near[at] if j in left]
            left -= set(near[at])
    out = top | {i: min(top[j] for j in near[i] if j in core) for i in ids if i not in core and core & set(near[i])}
    sizes = {c: sum(v == c for v in out.values()) for c in out.values()}
    return {i: c for i, c in out.items() if sizes[c] >= least}


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_clusters_of_all_draws(spark, monkeypatch, one_task):
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    draw = np.random.default_rng(3)
    places = {i: draw.random(3) * [1, 1, 0.2] for i in range(150)}
    member = {d: sorted(draw.choice(150, 60, replace=False).tolist()) for d in range(70)}
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in places.items()], "id long, z double, y double, x double")
    rows = spark.createDataFrame([(i, d) for d, ids in member.items() for i in ids], "id long, draw int")
    eps = [0.08, 0.13, 0.2, 0.3]
    got = inference.draw_clusters(Scratch(spark, "draws"), points, rows, 70, eps, 4, 5).collect()
    found = {}
    for r in got:
        assert found.setdefault((r["level"], r["draw"]), {}).setdefault(r["id"], r["cluster"]) == r["cluster"]
    some = 0
    for d, ids in member.items():
        for k, e in enumerate(eps):
            want = clusters({i: places[i] for i in ids}, e, 4, 5)
            assert found.get((k, d), {}) == want, (d, k)
            some += len(want)
    assert some == len(got) > 1000
    with pytest.raises(ValueError, match="rising"):
        inference.draw_clusters(Scratch(spark, "draws"), points, rows, 70, eps[::-1])


def test_draws_are_those_of_the_digest(spark):
    from voxloom.operators import stats

    got = {(r["replica"], r["id"]) for r in stats.resampled(spark.range(500), 40, 6, "id", 9).collect()}
    for k in range(6):
        want = sorted(range(500), key=lambda i: (hashlib.md5(f"9:{k}:{i}".encode()).hexdigest(), i))[:40]
        assert {i for r, i in got if r == k} == set(want)
    assert stats.resampled(spark.range(30), 40, 2, "id", 9).count() == 60
