"""Approximate nearest neighbours by collision counting on single projections.

Largest inner products become nearest neighbours: with M the greatest norm,
a vector x gets the further coordinate sqrt(M^2 - |x|^2), a query q is scaled to
norm M and gets 0, and the nearest of these points have the largest products.
Each of some random projections (``hashes_for``) orders the vectors of a block in one
sorted array, which bit arrays at equal steps stand for. Around a query's own projection a window is opened, to the nearest step; a vector in
it collides. Collisions are added up bit by bit, 64 vectors and many queries at a time. A round widens all windows (virtual rehashing: nothing is
hashed again), and a vector that collides in enough of the projections (``least_share``) is verified
by its exact product. At each radius a vector within it is verified with a probability of
0.95 or more. The search in a block ends if the ``k`` best so far lie within the radius, or if nothing is left; there is no
cap on what is verified. The first radius is what a quarter of up to ``SOME`` vectors of the block need for ``k`` neighbours; the next is the distance of the ``k``-th best so far, or, with fewer than ``k``, what the
``k``-th greatest count makes likely; it grows by ``GROWTH`` at least, and by no more once there are ``k``.

Distances of vectors without clusters differ by about one part in the root of their dimension, so
the projections needed to tell them apart grow with the dimension. The rows of a block shrink alike, and a block's arrays
keep their size.

Vectors are dealt to blocks of a fixed mean size by a hash of id and content, the stated queries to
blocks of theirs, and each pair of blocks is one task's group; per
query only the best ``k`` of a block leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import cached_property
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalstream.llm.common import col, materialise

#: Projections for vectors of 64 components or fewer, and for each component of longer ones.
K, HASHES, PER_COMPONENT = 20, 512, 8
#: The least first radius as a share of M, its growth by round, and half a window's width by radius.
RADIUS, GROWTH, WIDTH = 0.5, 1.05, 0.95
BLOCK_CELLS, QUERY_ROWS, SEED = 1 << 22, 4096, 42
#: Parts of a sorted array in a block of full size, queries counted together, and vectors that the first radius is taken from, at most.
STEPS, TOGETHER, SOME = 256, 128, 64
NORMAL = NormalDist()


def hashes_for(dim: int) -> int:
    return max(HASHES, PER_COMPONENT * dim)


def least_share(hashes: int) -> float:
    """The share of the projections in which a vector at the radius collides with a probability of 0.95."""
    share = 2 * NORMAL.cdf(WIDTH) - 1
    return share - NORMAL.inv_cdf(0.95) * (share * (1 - share) / hashes) ** 0.5 - 0.5 / hashes


THRESHOLD = least_share(HASHES)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and only finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    df: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K,
    block_rows: int | None = None, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` vectors found with the largest inner products.

    Candidates are all rows but the query's own id; fewer than ``k`` give fewer
    rows. Scores are products of the original vectors in double precision, ties go to the
    smaller id. Vectors that are null, empty, zero, hold a null or non-finite component
    or have a null id take no part; vectors of different lengths have no product and are searched apart. Rows that repeat an id
    and a vector count once. An empty table gives an empty result; other columns are not read.
    ``block_rows`` is the mean size of a block, by default what keeps a block's arrays at ``BLOCK_CELLS`` places.
    """
    rows = df.select(
        col(vec_id).cast("long").alias("vec_id"), col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("vec_id", "v").agg(F.max("asks").alias("asks")).withColumn("dim", F.size("v"))
    rows = materialise(rows, "vectors")
    hashes = F.greatest(F.lit(HASHES), PER_COMPONENT * F.col("dim"))
    size = F.lit(block_rows) if block_rows else F.greatest(F.lit(1), F.floor(F.lit(BLOCK_CELLS) / hashes))
    lengths = rows.groupBy("dim").agg(
        F.count("*").alias("n"), F.count_if("asks").alias("asking"),
        F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm"),
    ).select(
        "dim", "norm", (F.floor(F.col("n") / size) + 1).cast("int").alias("blocks"),
        (F.floor(F.col("asking") / query_rows) + 1).cast("int").alias("parts"),
    )
    rows = rows.join(lengths, "dim")
    # Named anew, so that columns of both sides can be told apart.
    queries = rows.where("asks").select(
        F.col("dim").alias("dim"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"),
        F.col("vec_id").alias("vec_id"), F.col("v").alias("v"),
    )
    # A block meets every part of the queries: sent once per part.
    data = rows.select(
        "dim", F.pmod(F.xxhash64("vec_id", "v"), "blocks").cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "vec_id", "v", "norm",
    )

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, ids, scores = [], [], []
        if left.num_rows and right.num_rows:
            index, own = Block(_ids(left), _matrix(left), left.column("norm")[0].as_py()), _ids(right)
            for query, (found, products) in zip(own, index.search(own, _matrix(right), k)):
                asked.append(np.full(len(found), query))
                ids.append(found)
                scores.append(products)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        return pa.table({
            "query_id": join(asked, np.int64), "vec_id": join(ids, np.int64), "score": join(scores, np.float64)
        })

    # Few bytes, but much work: a stated number of partitions is not merged by their size.
    group, tasks = ["dim", "block", "part"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = data.repartition(tasks, *group).groupBy(*group).cogroup(queries.repartition(tasks, *group).groupBy(*group))
    found = pairs.applyInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("vec_id").to_numpy()


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def count_bits(planes: Iterable[np.ndarray]) -> list[np.ndarray]:
    """Column sums of many bit arrays of one shape, as bit arrays again: the ones, twos, fours and so on.

    A full adder makes one array of a weight and one of the next out of three, for all 64 columns of a word at once.
    """
    waiting: list[list[np.ndarray]] = []

    def add(plane: np.ndarray, weight: int) -> None:
        if weight == len(waiting):
            waiting.append([])
        waiting[weight].append(plane)
        if len(waiting[weight]) == 3:
            x, y, z = waiting[weight]
            odd = x ^ y
            waiting[weight] = [odd ^ z]
            add((x & y) | (odd & z), weight + 1)

    for plane in planes:
        add(plane, 0)
    for weight, held in enumerate(waiting):  # carries may add a weight
        if len(held) == 2:
            add(np.zeros_like(held[0]), weight)
    return [held[0] for held in waiting]


def at_least(sums: list[np.ndarray], least: int) -> np.ndarray:
    """The columns whose sum, as ``count_bits`` gives it, is ``least`` or more."""
    if least >> len(sums):
        return np.zeros_like(sums[0])
    out = ~np.zeros_like(sums[0])
    for weight, bits in enumerate(sums):
        out = bits & out if least >> weight & 1 else bits | out
    return out


class Block:
    """Sorted projections of some vectors; ``verified`` counts the products taken by all searches.

    A sorted array is cut into equal parts, ``STEPS`` in a block of full size and more in smaller ones, down to single rows. A bit array tells for each cut which rows stand before it. A window
    ends at the nearest cuts; its rows are the difference of two bit arrays, and the collisions of all rows
    are added up 64 at a time.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float):
        n, dim = vectors.shape
        self.ids, self.vectors, self.norm, self.verified = ids, vectors, norm, 0
        rest = np.sqrt(np.maximum(0.0, norm**2 - np.einsum("ij,ij->i", vectors, vectors)))
        hashes = hashes_for(dim)
        self.axes = np.random.default_rng(SEED).standard_normal((dim + 1, hashes))
        self.least = math.ceil(least_share(hashes) * hashes)
        projected = np.ascontiguousarray((vectors @ self.axes[:-1] + rest[:, None] * self.axes[-1]).T)
        order = np.argsort(projected, axis=1)
        self.order = order.astype(np.min_scalar_type(n))
        steps = min(n, max(STEPS, STEPS * BLOCK_CELLS // self.order.size))
        self.cuts = np.arange(steps + 1) * n // steps
        #: The value in the middle of each part.
        self.middles = np.take_along_axis(projected, order[:, (self.cuts[:-1] + self.cuts[1:]) // 2], axis=1)

    @cached_property
    def bits(self) -> np.ndarray:
        """By sorted array and cut the rows before the cut."""
        hashes, n = self.order.shape
        steps = len(self.cuts) - 1
        numbers = np.repeat(np.arange(1, steps + 1, dtype=np.int16), np.diff(self.cuts))
        out = np.zeros((hashes, steps + 1, -(-n // 64) * 8), np.uint8)
        # By array, so that what is written stays in the processor's cache.
        parts = np.empty(n, np.int16)
        for order, bits in zip(self.order, out):
            parts[order] = numbers
            for bit in range(8):  # rows eight apart: no byte is written twice at once
                own = parts[bit::8]
                bits[own, np.arange(len(own))] |= np.uint8(1 << bit)
            np.bitwise_or.accumulate(bits, axis=0, out=bits)
        return out.view(np.uint64)

    def start(self, k: int) -> float:
        """A first radius: what a quarter of some vectors of the block need for their ``k`` nearest, ``RADIUS`` of M at least."""
        some = self.vectors[:: -(-len(self.ids) // SOME)]
        sizes = np.sqrt(np.einsum("ij,ij->i", some, some))
        products = some @ self.vectors.T * (self.norm / sizes)[:, None]
        at = max(0, len(self.ids) - k - 1)
        near = np.partition(products, at, axis=1)[:, at]
        return max(RADIUS * self.norm, float(np.quantile(np.sqrt(np.maximum(0.0, 2 * self.norm**2 - 2 * near * self.norm)), 0.25)))

    def collisions(self, at: np.ndarray, half: np.ndarray) -> list[np.ndarray]:
        """Per query the collisions of all rows, as ``count_bits`` gives them; ``at`` has an array's places in a row."""

        def planes():
            for j, bits in enumerate(self.bits):
                low = self.middles[j].searchsorted(at[j] - half)
                high = self.middles[j].searchsorted(at[j] + half, "right")
                yield bits[low] ^ bits[high]

        return count_bits(planes())

    def likely(self, counts: np.ndarray, radius: float, k: int) -> float:
        """The distance at which a vector collides as often as that with the ``k``-th greatest count does at ``radius``."""
        k = min(k, len(counts))
        share = np.partition(counts, len(counts) - k)[len(counts) - k] / len(self.axes.T)
        return WIDTH * radius / NORMAL.inv_cdf(0.5 + min(max(share, 1e-3), 0.999) / 2)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (id ``own``) the ids and products of the best found."""
        n, total = len(self.ids), len(own)
        sizes = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        at = np.ascontiguousarray((queries @ self.axes[:-1] * (self.norm / sizes)[:, None]).T)
        done = np.zeros((total, self.bits.shape[2]), np.uint64)
        rows = done.view(np.uint8)
        by_id = np.argsort(self.ids, kind="stable")
        first, last = (self.ids[by_id].searchsorted(own, side) for side in ("left", "right"))
        for i in np.flatnonzero(first < last):
            np.bitwise_or.at(rows[i], by_id[first[i] : last[i]] >> 3, (1 << (by_id[first[i] : last[i]] & 7)).astype(np.uint8))
        left = n - (last - first)
        found, scores = [np.empty(0, np.int64)] * total, [np.empty(0)] * total
        radius, active = np.full(total, self.start(k)), np.flatnonzero(left > 0)
        while len(active):
            goes_on = []
            for some in np.split(active, range(TOGETHER, len(active), TOGETHER)):
                sums = self.collisions(at[:, some], WIDTH * radius[some])
                fresh = at_least(sums, self.least) & ~done[some]
                done[some] |= fresh
                fresh = np.unpackbits(fresh.view(np.uint8), axis=1, bitorder="little").view(bool)
                for place, i in enumerate(some):
                    new = np.flatnonzero(fresh[place])
                    found[i] = np.concatenate([found[i], new])
                    scores[i] = np.concatenate([scores[i], np.einsum("ij,j->i", self.vectors[new], queries[i])])
                    if len(found[i]) == left[i]:
                        continue
                    if len(found[i]) < k:
                        counts = sum(
                            np.unpackbits(bits[place].view(np.uint8), count=n, bitorder="little").astype(np.int64) << weight
                            for weight, bits in enumerate(sums)
                        )
                        radius[i] = max(radius[i] * GROWTH, 0.95 * self.likely(counts, radius[i], k))
                        goes_on.append(i)
                        continue
                    # |x - q|^2 = 2 M^2 - 2 M x.q / |q| for the lifted points.
                    worst = np.partition(scores[i], len(scores[i]) - k)[len(scores[i]) - k]
                    reach = max(0.0, 2 * self.norm**2 - 2 * self.norm * worst / sizes[i]) ** 0.5
                    if reach > radius[i]:
                        radius[i] = min(radius[i] * GROWTH, reach * (1 + 1e-12))
                        goes_on.append(i)
            active = np.array(goes_on, np.int64)
        out = []
        for i in range(total):
            self.verified += len(found[i])
            best = np.lexsort((self.ids[found[i]], -scores[i]))[:k]
            out.append((self.ids[found[i][best]], scores[i][best]))
        return out
