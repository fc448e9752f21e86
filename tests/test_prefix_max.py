"""The greatest value so far against a plain scan."""

import random

import pytest

from tablewatch.operators.prefix_max import greatest_so_far


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_equals_a_plain_scan(spark, keys):
    pick = random.Random(4)
    left = [(i, pick.choice(["a", "a", "b", "c", None]), pick.choice([None, *range(60)])) for i in range(300)]
    left += [(1000 + i, "a", 30) for i in range(200)]  # one busy moment
    right = [(pick.choice(["a", "b", None]), pick.choice([None, *range(60)]), pick.choice([None, *range(90)])) for _ in range(80)]
    got = greatest_so_far(
        spark.createDataFrame(left, "id INT, k STRING, at INT").repartition(4), spark.createDataFrame(right, "k STRING, at INT, v INT"), keys, "at", "v"
    )
    assert got.columns == ["id", "k", "at", "v"]
    def best(k, at):
        fits = [v for rk, ra, v in right if None not in (ra, v) and ra <= at and (not keys or (rk == k and k is not None))] if at is not None else []
        return max(fits, default=None)
    # values of the null key meet no row from an earlier range; the callers give none
    rows = [tuple(r) for r in got.collect() if not (keys and r["k"] is None)]
    assert sorted(rows) == sorted(((i, k, at, best(k, at)) for i, k, at in left if not (keys and k is None)), key=lambda r: r[0])


def test_no_rows_on_a_side(spark):
    left, right = spark.createDataFrame([(1, 5)], "id INT, at INT"), spark.createDataFrame([(3, 4)], "at INT, v INT")
    assert [tuple(r) for r in greatest_so_far(left, right.limit(0), [], "at", "v").collect()] == [(1, 5, None)]
    assert greatest_so_far(left.limit(0), right, [], "at", "v").collect() == []
    assert [tuple(r) for r in greatest_so_far(left, right, [], "at", "v").collect()] == [(1, 5, 4)]
