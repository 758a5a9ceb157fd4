"""Exact quantiles by selection against sorted lists."""

import math
import random

import pytest


def plain(values, share, between):
    held = sorted(v for v in values if v is not None and math.isfinite(v))
    if not held:
        return 0, None
    place = (len(held) - 1) * share if between else max(math.ceil(round(len(held) * share, 9)) - 1, 0)
    low = int(place)
    high, part = held[min(low + 1, len(held) - 1)], place - low
    return len(held), held[low] * (1 - part) + high * part if part else held[low]


@pytest.mark.parametrize("share,between", [(0.5, True), (0.95, False)])
def test_quantiles_equal_sorted_lists(spark, share, between):
    from rostrum.operators.quantiles import quantiles

    rng = random.Random(7)
    keys = {
        "even": [rng.random() for _ in range(3000)], "tail": [math.exp(rng.gauss(0, 40)) for _ in range(3001)], "ties": [rng.choice([1.0, 2.0, 2.0]) for _ in range(2000)],
        "same": [5.0] * 700, "one": [3.0], "two": [1.0, 4.0], "none": [None, float("nan"), float("inf")], None: [1.0, 2.0, None, 9.0],
        "huge": [1.7e308, -1.7e308, 0.0, 5e-324] * 50,
    }
    rows = [(k, v) for k, vs in keys.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.quantile) for r in quantiles(df, ["k"], "v", share, between, few=20).collect()}
    for k, vs in keys.items():
        n, want = plain(vs, share, between)
        assert got[k][0] == n and (got[k][1] == want or math.isclose(got[k][1], want, rel_tol=1e-12)), k
    assert len(got) == len(keys)
    assert quantiles(df.where("k = 'no'"), ["k"], "v", share, between).count() == 0


def test_one_key_holds_all_rows(spark):
    """A million rows of one key: the ranks are found although no task sorts more than a few rows."""
    from pyspark.sql import functions as F

    from rostrum.operators.quantiles import quantiles

    df = spark.range(1_000_001).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 1_000_001).alias("v"))
    assert [tuple(r) for r in quantiles(df, ["k"], "v", 0.5, few=1000).collect()] == [(1, 1_000_001, 500_000.0)]
