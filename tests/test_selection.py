"""Ranks by refined histograms against sorting."""

from __future__ import annotations

import math
import random

import pytest

from corpusloom.operators import evaluation as E


def sorted_ranks(rows, shares):
    groups = {}
    for g, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {(g, p): sorted(v)[max(1, math.ceil(p * len(v))) - 1] for g, v in groups.items() for p in shares}


@pytest.mark.parametrize("small", [1, 40, 10_000])
def test_ranks_are_those_of_sorting(spark, small):
    rng = random.Random(small)
    rows = [("hot", rng.lognormvariate(0, 9)) for _ in range(3000)] + [(None, float(rng.randint(0, 3))) for _ in range(900)]
    rows += [("wide", rng.choice([-1e308, -5.0, 0.0, 1e-300, 2e-300, 3.0, 1e308])) for _ in range(500)] + [("one", 7.5)] + [("odd", None), ("odd", float("nan"))]
    rows += [("close", 1.0 + k * 2**-52) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = E.select_ranks(df, "v", shares, ["g"], small=small, buckets=16).collect()
    assert {(r.g, r.share): r.value for r in got} == sorted_ranks(rows, shares) and len(got) == 25
    assert all(r.held <= small for r in got)


def test_ranks_of_the_whole_and_of_nothing(spark):
    df = spark.range(1001).selectExpr("id AS v")
    assert {r.share: (r.value, r.held <= 10) for r in E.select_ranks(df, "v", [0.5, 0.95], small=10).collect()} == {0.5: (500.0, True), 0.95: (950.0, True)}
    assert E.select_ranks(df.where("false"), "v", [0.5]).count() == 0
