"""Hard negatives against a plain sort of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from gregale.llm import negatives, registry


def brute(rows, positives=5, k=10, low=30, high=90):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, label, v, *_ in [r for r in rows if r[0] is not None and r[0] % 10 == 0]:
        for score, p in sorted([(dot(v, w), i) for i, own, w, *_ in rows if own == label and i != a], key=order)[:positives]:
            fit = sorted([(s, i) for i, own, w, *_ in rows if own != label and low * score <= 100 * (s := dot(v, w)) <= high * score], key=order)[:k]
            out += [(a, p, rank, i, score, s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(map(str, out))


def table(seed, n=300, width=4, most=6):
    r = random.Random(seed)
    rows = [(i, r.randrange(4), [r.randint(-most, most) for _ in range(width)]) for i in range(n)]
    rows += [(i, 1, [3] * width) for i in range(1000, 1150)]  # one common vector
    rows += [rows[20], rows[20], (None, 2, [4] * width), (None, 0, [4] * width), (40, 3, [1] * (width + 2)), (50, 0, []), (7, None, [1]), (8, 1, None)]
    return [(*row, "x") for row in rows]


@pytest.mark.parametrize(("seed", "cells", "block"), [(1, 1 << 20, 4096), (2, 60, 37), (3, 8, 1)])
def test_equals_a_plain_sort(spark, seed, cells, block):
    """Also with many blocks of anchors and of rows; ties, repeated rows, rows without an id, vectors of odd lengths, negative scores."""
    rows = table(seed, n=300 if block > 1 else 60)
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<int>, rank string").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, anchor_cells=cells, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    schema = "vec_id long, label int, vector array<int>"
    assert negatives.hard_negatives(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1])], schema), F.lit(False)).collect() == []
    assert negatives.hard_negatives(spark.createDataFrame([(1, 1, [1])], schema), F.lit(True)).collect() == []


def test_limits_are_exact():
    for score in range(-300, 301):
        lower, upper = negatives.limits(score, 30, 90)
        fit = [s for s in range(-400, 401) if 30 * score <= 100 * s <= 90 * score]
        assert fit == list(range(lower, upper + 1))


def test_large_scores_are_whole(spark):
    big = 1 << 25
    rows = [(0, 1, [big, 1], ""), (1, 1, [big, 1], ""), (2, 2, [big // 2, 1], ""), (3, 2, [big // 2, 2], "")]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<bigint>, x string")
    assert sorted(str(tuple(r)) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()) == brute(rows)
    wrong = spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [1 << 40])], "vec_id long, label int, vector array<bigint>")
    with pytest.raises(Exception, match="too large"):
        negatives.hard_negatives(wrong, F.col("vec_id") == 0).collect()


def test_op12(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(3)], r.randrange(10)) for i in range(401)]
    rows += [(500, [0.5, None, 1.0], 1), (600, [float("nan"), 1.0, 1.0], 1), (700, [float("inf"), 1.0, 1.0], 2), (800, None, 3), (900, [1.0, 1.0, 1.0], None), (1000, [0.5, 0.5, 0.25], 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    import numpy as np

    floor = lambda v: None if v is None or any(x is None or x != x or abs(x) == float("inf") for x in v) else [int(np.floor(256 * float(np.float32(x)))) for x in v]
    own = [(i, None if label is None else (label + 1) % 10 if i % 7 == 0 else label, floor(v)) for i, v, label in rows]
    got = sorted(str(tuple(r)) for r in registry.QUERIES["op12_negatives"](spark, str(tmp_path)).collect())
    # the plain version's anchors are multiples of 10, so keep those of 100
    assert got == [x for x in brute(own) if int(x[1:].split(",")[0]) % 100 == 0] and len(got) > 50
