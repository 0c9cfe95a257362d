import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalstream.llm import ann


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string").repartition(3)


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        i = ids.index(q)
        ranked = sorted((-float((np.asarray(vectors[j]) * np.asarray(vectors[i])).sum()), ids[j]) for j in range(len(ids)) if j != i)
        out[q] = ranked[:k]
    return out


@pytest.mark.parametrize("scaled", [False, True])
def test_recall_and_scores(spark, scaled):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    if scaled:
        x *= rng.uniform(0.2, 3, (3000, 1))
    found = ann.nearest(frame(spark, x), F.col("vec_id") % 20 == 0, block_rows=700, query_rows=60).collect()
    want = brute(list(range(3000)), x, range(0, 3000, 20), 20)
    hits = 0
    for q, best in want.items():
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        keys = [(-r.score, r.vec_id) for r in mine]
        assert keys == sorted(keys)
        for r in mine:
            assert abs(r.score - x[q] @ x[r.vec_id]) < 1e-12 and r.vec_id != q
        hits += len({r.vec_id for r in mine} & {i for _, i in best})
    assert hits >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("dim", [64, 256])
def test_recall_without_clusters(dim):
    x = np.random.default_rng(2).standard_normal((2000, dim))
    asked = np.arange(0, 2000, 20)
    found = ann.Block(np.arange(2000), x, np.linalg.norm(x, axis=1).max()).search(asked, x[asked], 20)
    want = brute(list(range(2000)), x, asked.tolist(), 20)
    hits = sum(len(set(ids.tolist()) & {i for _, i in want[q]}) for q, (ids, _) in zip(asked.tolist(), found))
    assert hits >= 0.95 * 20 * len(asked)


@pytest.mark.parametrize("distance", [0.5, 1.0])
def test_vectors_within_the_radius_are_verified(distance):
    """A vector at the radius itself collides often enough in 0.95 of all cases."""
    axes = np.random.default_rng(3).standard_normal((20000, ann.HASHES)) * distance
    assert ((np.abs(axes) <= ann.WIDTH * distance).sum(1) >= ann.THRESHOLD * ann.HASHES).mean() >= 0.95


def test_what_takes_part(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [0, 0], None, [1, None], [nan, 1], [inf, 0], [], [1, 2, 3], [2, 1], [1, 1], [1, 1], [-1, 0]]
    ids = [0, 20, 40, 60, 80, 100, 120, 140, 8, 10, 9, 160]
    found = ann.nearest(frame(spark, [*vectors, [5, 5]], [*ids, None]), F.col("vec_id") % 20 == 0).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q] for q in {r.query_id for r in found}}
    assert got == {0: [(8, 2.0), (9, 1.0), (10, 1.0), (160, -1.0)], 160: [(0, -1.0), (9, -1.0), (10, -1.0), (8, -2.0)]}


def test_empty(spark):
    assert ann.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(frame(spark, [[1, 2]]), F.col("vec_id") % 20 == 0).count() == 0


def selected(x, break_it=False):
    """Recall at 20 and share of rows verified in one block."""
    n = len(x)
    block = ann.Block(np.arange(n), x, np.linalg.norm(x, axis=1).max())
    if break_it:
        block.order = np.tile(np.arange(n), (len(block.order), 1))
    asked = np.arange(0, n, n // 40)
    found = block.search(asked, x[asked], 20)
    want = brute(list(range(n)), x, asked.tolist(), 20)
    hits = sum(len(set(ids.tolist()) & {i for _, i in want[q]}) for q, (ids, _) in zip(asked.tolist(), found))
    return hits / 20 / len(asked), block.verified / len(asked) / n


@pytest.mark.parametrize("rows, dim, clusters", [(8192, 64, 0), (2000, 64, 10), (2000, 256, 0)])
def test_collisions_select(rows, dim, clusters):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((rows, dim))
    if clusters:
        x = x + 2 * rng.standard_normal((clusters, dim))[np.arange(rows) % clusters]
    recall, share = selected(x)
    assert recall >= 0.9 and share < 0.25
    recall, share = selected(x, break_it=True)
    assert recall < 0.9 or share > 0.5


def test_lengths_are_searched_apart(spark):
    vectors = [[1, 0], [1, 2, 3], [2, 1], [1, 0, 1], [3, 0, 0], [5]]
    found = ann.nearest(frame(spark, vectors, [0, 20, 1, 2, 3, 40]), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [(0, 1, 1, 2.0), (20, 1, 2, 4.0), (20, 2, 3, 3.0)]


@pytest.mark.parametrize("arrays", [1, 2, 3, 512, 613])
def test_bits_are_counted(arrays):
    bits = np.random.default_rng(arrays).integers(0, 2, (arrays, 3, 128), np.uint8)
    planes = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
    sums = ann.count_bits(iter(planes))
    want = bits.sum(0, dtype=int)
    got = sum(np.unpackbits(s.view(np.uint8), axis=1, bitorder="little").astype(int) << w for w, s in enumerate(sums))
    assert (got == want).all()
    for least in (1, arrays // 2 + 1, arrays, arrays + 1, 5000):
        found = np.unpackbits(ann.at_least(sums, least).view(np.uint8), axis=1, bitorder="little")
        assert (found == (want >= least)).all()


@pytest.mark.parametrize("rows", [1, 7, 200, 3000])
def test_windows_reach_the_nearest_step(rows):
    """Counts are those of the windows themselves, but for half a step at either end; without steps of several rows they are equal."""
    rng = np.random.default_rng(rows)
    x = rng.standard_normal((rows, 16))
    norm = np.linalg.norm(x, axis=1).max()
    block = ann.Block(np.arange(rows), x, norm)
    lifted = np.column_stack([x, np.sqrt(np.maximum(0, norm**2 - (x**2).sum(1)))]) @ block.axes
    queries = rng.standard_normal((5, 16)) @ block.axes[:-1]
    for half in (0.1, 2.0, 100.0):
        sums = block.collisions(queries.T.copy(), np.full(5, half))
        got = sum(np.unpackbits(s.view(np.uint8), axis=1, count=rows, bitorder="little").astype(int) << w for w, s in enumerate(sums))
        want = (np.abs(lifted[None] - queries[:, None]) <= half).sum(2)
        assert np.abs(got - want).max() <= (0 if rows <= ann.STEPS else 20)


def test_few_rounds_for_many_queries(monkeypatch):
    """The first radius is near the last, and the queries of a round are counted together."""
    x = np.random.default_rng(5).standard_normal((4096, 64))
    block, asked, counted = ann.Block(np.arange(4096), x, np.linalg.norm(x, axis=1).max()), np.arange(0, 4096, 16), []
    collisions = ann.Block.collisions
    monkeypatch.setattr(ann.Block, "collisions", lambda self, at, half: counted.append(len(half)) or collisions(self, at, half))
    block.search(asked, x[asked], 20)
    assert sum(counted) <= 6 * len(asked) and len(counted) <= len(asked) // 2
