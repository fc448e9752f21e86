"""Hard negatives against all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewatch.llm import slot_negatives

SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, anchor STRING, slot STRING"


def product(a, b):
    return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b, strict=False))


def by_all_pairs(rows, anchor):
    ok = [(i, v, lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, v, lab in ok:
        if not anchor(i):
            continue
        scored = sorted(((-product(v, w), j, other) for j, w, other in ok if j != i))
        positives = [(-s, j) for s, j, other in scored if other == lab][:5]
        for p, j in positives:
            fits = [(n, -s) for s, n, other in scored_negatives(v, ok, lab) if 30 * p <= -100 * s <= 90 * p][:10]
            out.update((i, j, k + 1, n, p, s) for k, (n, s) in enumerate(fits))
    return out


def scored_negatives(v, ok, lab):
    return sorted((-product(v, w), n, other) for n, w, other in ok if other != lab)


def made(spark, rows):
    return spark.createDataFrame([(i, v, lab, "a", "b") for i, v, lab in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("group_bytes", [slot_negatives.GROUP_BYTES, 300])
def test_equals_all_pairs(spark, group_bytes):
    pick = random.Random(11)
    rows = [(k, [pick.randint(-40, 60) / 64 for _ in range(4)], pick.choice([0, 0, 0, 1, 2])) for k in range(400)]
    rows += [(1000 + k, rows[0][1], 0 if k % 2 else 1) for k in range(60)]  # one vector many times
    rows += [(2000, None, 1), (2010, [0.5] * 4, None), (None, [0.5] * 4, 1), (2020, [0.5, None, 0.1, 0.1], 1), (2030, [float("nan")] * 4, 1)]
    rows += [(2040, [float("inf"), 0.0, 0.0, 0.0], 1), (2050, [], 0), (2060, [0.25], 1), rows[0], rows[7], (2070, [0.5, 0.25] * 4, 2), (2080, [0.5] * 4, 9)]
    got = slot_negatives.mine(made(spark, rows), F.col("vec_id") % 10 == 0, group_bytes=group_bytes)
    assert dict(got.dtypes)["rank"] == "int"
    assert Counter(tuple(r) for r in got.collect()) == by_all_pairs(rows, lambda i: i % 10 == 0)


def test_large_components(spark):
    """Products beyond 2^24, 2^53 and the range of a long."""
    pick = random.Random(12)
    for size in (2.0**6, 2.0**22, 2.0**40):
        rows = [(k, [pick.choice([-1.0, 1.0]) * size * pick.random() for _ in range(3)], k % 2) for k in range(60)]
        rows = [(i, [float(x) for x in v], lab) for i, v, lab in rows]
        docs = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>, label INT")
        got = [tuple(r) for r in slot_negatives.mine(docs, F.col("vec_id") % 10 == 0).collect()]
        if size < 2**30:
            assert Counter(got) == by_all_pairs(rows, lambda i: i % 10 == 0)
        else:
            assert all(abs(r[4]) <= 2**63 - 1 for r in got)


def test_no_anchor(spark):
    assert slot_negatives.mine(made(spark, []), F.lit(True)).collect() == []
    assert slot_negatives.mine(made(spark, [(1, [0.5], 1)]), F.lit(True)).collect() == []
    assert slot_negatives.mine(made(spark, [(1, [0.5], 1), (2, [0.5], 1)]), F.col("vec_id") == 5).collect() == []
