import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstream.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, positives=5, n=3, low=50, high=95, scale=256):
    """All scores of each anchor, sorted."""
    kept = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if i not in kept or (label, v) < kept[i]:
            kept[i] = (label, v)
    whole = {i: (label, [math.floor(scale * x) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a in sorted(i for i in whole if i % every == 0):
        label, q = whole[a]
        scored = sorted(
            (-sum(x * y for x, y in zip(q, v)), i, other) for i, (other, v) in whole.items() if i != a and len(v) == len(q)
        )
        for ps, p, _ in [s for s in scored if s[2] == label][:positives]:
            fine = [(-ns, i) for ns, i, other in scored if other != label and low * -ps <= 100 * -ns <= high * -ps]
            out += [(a, p, rank, i, -ps, ns) for rank, (ns, i) in enumerate(fine[:n], 1)]
    return sorted(out)


def run(spark, rows, every, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("id", "v", "key", "block", "asks")})
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % every == 0, **how).collect()))


def vectors(n, dim, seed, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)) / dim**0.5 + 0.2
    return [(int(i), [float(c) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("rows,parts", [(1 << 19, 1 << 17), (200, 40)])
def test_equal_brute_force_for_any_blocks(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", rows)
    monkeypatch.setattr(negatives, "PART_COMPONENTS", parts)
    data = vectors(400, 8, 1)
    found = run(spark, data, 10)
    assert found == brute(data, 10) and len(found) > 300


def test_ties_signs_and_zero_scores(spark):
    # Few distinct scores: ties at each rank, positives of score zero or less.
    rng = np.random.default_rng(2)
    data = [(int(i), [float(c) for c in rng.integers(-2, 3, 3) / 256], int(rng.integers(20))) for i in range(120)]
    found = run(spark, data, 5, negatives=2)
    assert found == brute(data, 5, n=2)
    assert any(r[4] == 0 for r in found)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(60, 4, 3) + [
        (None, [1.0] * 4, 0), (100, None, 0), (101, [], 1), (102, [1.0, None, 1.0, 1.0], 0), (103, [nan] * 4, 0),
        (104, [inf] * 4, 1), (105, [1.0] * 4, None), (110, [0.5] * 3, 0), (111, [0.4] * 3, 0), (112, [0.3] * 3, 1),
        (0, [0.9] * 4, 0), (0, [0.9] * 4, 0), (-10, [0.1, 0.2, 0.3, 0.4], 1),
    ]
    assert run(spark, data, 10) == brute(data, 10)


def test_scores_beyond_double_precision(spark):
    data = [(i, [float(2 ** (20 + i % 3)), float(i)], i % 2) for i in range(30)]
    assert run(spark, data, 10, scale=2.0**8) == brute(data, 10, scale=2**8)
    huge = [(i, [1e30, 1.0], i % 2) for i in range(20)]
    with pytest.raises(Exception, match="does not fit"):
        run(spark, huge, 10)


def test_keys_sort_as_packed():
    rng = np.random.default_rng(4)
    a, s, i = (rng.integers(-5, 5, 200) for _ in range(3))
    keys = negatives.pack(a, s, 1, i) + negatives.pack(a, s, 0, i)
    edge = np.array([-(1 << 63), (1 << 63) - 1])
    keys += negatives.pack(edge, edge, 0, edge)
    assert [negatives.unpack(k) for k in sorted(keys)] == sorted(
        (negatives.unpack(k) for k in keys), key=lambda k: (k[0], -k[1], k[2], k[3])
    )


def test_empty_and_alone(spark):
    assert run(spark, [], 10) == []
    assert run(spark, [(0, [1.0, 2.0], 1)], 10) == []
