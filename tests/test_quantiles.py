"""Exact percentiles, with refinement forced by small bounds, against plain sorting."""

from __future__ import annotations

import math
import random

import pytest

from quayline.operators import quantiles as Q

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def by_hand(values: list[float], share: float) -> float:
    values = sorted(values)
    at = share * (len(values) - 1)
    low = math.floor(at)
    a, b = values[low], values[min(low + 1, len(values) - 1)]
    return a + (b - a) * (at - low)


def some(kind: str, n: int, r: random.Random) -> list[float]:
    make = {"ties": lambda: float(r.randrange(3)), "even": r.random, "far": lambda: 10.0 ** r.randint(-300, 300) * r.choice((1, -1)), "steps": lambda: float(r.randrange(5000))}
    return [make[kind]() for _ in range(n)]


@pytest.mark.parametrize("most", [Q.MOST, 50, 4])
def test_percentiles_of_groups(spark, most):
    """One group has nearly all rows; refinement goes several rounds deep with most = 4."""
    r = random.Random(most)
    groups = {("a", "hot"): some("steps", 6000, r), ("b", "even"): some("even", 900, r), (None, "far"): some("far", 700, r), ("c", "ties"): some("ties", 800, r), ("d", "one"): [5.0], ("e", None): some("even", 30, r)}
    rows = [(*k, v, 1) for k, vs in groups.items() for v in vs] + [("n", "nulls", None, 1), ("a", "hot", None, 3), ("d", "one", 7.0, 0)]
    df = spark.createDataFrame(rows, "k string, g string, v double, w bigint").repartition(4)
    for weight in (None, "w") if most == 4 else ("w",):
        got = {(x.k, x.g): x.q for x in Q.percentiles(df, ["k", "g"], "v", SHARES, weight, most=most).collect()}
        want = {k: [by_hand(vs + ([7.0] if weight is None and k == ("d", "one") else []), s) for s in SHARES] for k, vs in groups.items()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == pytest.approx(want[k], rel=1e-9, abs=0), k


def test_weights_and_whole_tables(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1), (10.0, 4), (None, 9)], "v double, w bigint")
    for most in (1, Q.MOST):
        assert [x.q for x in Q.percentiles(df, [], "v", [0.5, 1.0], "w", most=most).collect()] == [[6.0, 10.0]]
    assert Q.percentiles(df.limit(0), ["w"], "v", [0.5]).collect() == []
