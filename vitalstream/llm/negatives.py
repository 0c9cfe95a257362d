"""Hard negatives by a secondary sort of pair scores.

Anchors meet all rows in blocks, and scores of a block are one matrix product. A
pair is packed into a key of 25 bytes: anchor, descending score, kind (positives before
negatives of the same score), id. ``repartitionAndSortWithinPartitions`` deals
keys by their anchor and sorts them, so an iterator sees each anchor's
pairs from the best score downwards: a positive opens the window of scores its
negatives may have, and a negative is emitted for every open window that it lies in and that is
not yet full. The iterator holds the windows of one anchor and nothing else.

It runs twice. The first run finds the positives. With their windows known, a block
packs only negatives that may still be among the first of a window: those that are among the first of
the block. Nothing that could be emitted is left out, and what is shuffled does not grow with the
rows of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import Column, DataFrame, functions as F

from vitalstream.llm.common import col, materialise

#: Components of the vectors of one block of rows, and of one part of the anchors.
BLOCK_COMPONENTS, PART_COMPONENTS = 1 << 19, 1 << 17
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1
SIGN = np.uint64(1 << 63)
#: Sums of integers below this are exact in double precision, in any order.
EXACT = float(1 << 53)


def pack(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> list[bytes]:
    """Keys whose order as bytes is anchor, score from the greatest, kind, id."""
    out = np.empty(len(ids), KEY)
    unsigned = lambda x: np.ascontiguousarray(x, np.int64).view(np.uint64) ^ SIGN
    out["anchor"], out["score"], out["kind"], out["id"] = unsigned(anchor), ~unsigned(score), kind, unsigned(ids)
    packed = out.tobytes()
    return [packed[k : k + KEY.itemsize] for k in range(0, len(packed), KEY.itemsize)]


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """Anchor, score, kind and id of a key."""
    shift = 1 << 63
    number = lambda a: int.from_bytes(key[a : a + 8], "big")
    return number(0) - shift, (shift - 1) - number(8), key[16], number(17) - shift


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer n with ``low * score <= 100 * n <= high * score``; the least may exceed the greatest."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(
    df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the hardest negatives.

    Components become ``floor(scale * x)`` and a row's score is its integer inner product with the
    anchor. An anchor's positives are its first ``positives`` other rows of its label; for each, the first
    ``negatives`` rows of another label whose score is ``low`` to ``high`` percent of the positive's are
    returned. Higher scores come first, ties go to the smaller id; fewer rows are returned where there are no more. Rows
    with a null id, label, vector or component, a component that is not finite, or an empty vector take no part; rows
    meet anchors of their own vector length only. Of rows that repeat an id the one with the least
    label, then the least vector, counts. A score beyond a long raises an error. An empty table gives an empty result;
    other columns are not read.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(
        col(vec_id).cast("long").alias("id"), col(label).alias("label"), col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where("id is not null and label is not null and size(v) > 0").where(fine)
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "asks")).alias("r")).select("id", "r.*")
    rows = materialise(rows, "labelled-vectors")
    sizes = rows.agg(F.sum(F.size("v").cast("long")), F.sum(F.when(F.col("asks"), F.size("v")).cast("long"))).first()
    blocks, parts = (sizes[0] or 0) // BLOCK_COMPONENTS + 1, (sizes[1] or 0) // PART_COMPONENTS + 1
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    data = rows.select(F.size("v").alias("dim"), dealt(blocks).alias("block"), every(parts).alias("part"), "id", "label", "v")
    anchors = rows.where("asks").select(
        F.size("v").alias("dim"), every(blocks).alias("block"), dealt(parts).alias("part"), "id", "label", "v"
    )

    first = _sorted(_meet(data, anchors, _nearest_same(positives, scale))).mapPartitions(_first(positives))
    spark = df.sparkSession
    kind = "anchor_id long, positive_id long, positive_score long"
    found = materialise(spark.createDataFrame(first, kind), "positives")
    scores = found.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("positive_score", "positive_id"))).alias("positives")
    ).select(F.col("anchor_id").alias("id"), F.transform("positives", lambda p: p["positive_score"]).alias("scores"))
    windowed = anchors.join(scores, "id")
    # A positive is packed once, beside the negatives of all blocks.
    again = found.mapInArrow(_packed_positives, "key binary")
    others = _meet(data, windowed, _nearest_others(negatives, low, high, scale))
    mined = _sorted(again.unionByName(others)).mapPartitions(_emit(negatives, low, high))
    return spark.createDataFrame(
        mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


def _meet(data: DataFrame, anchors: DataFrame, choose) -> DataFrame:
    """The keys ``choose`` packs from each block of rows and part of the anchors."""
    by = ["dim", "block", "part"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys = choose(left, right) if left.num_rows and right.num_rows else []
        return pa.table({"key": pa.array(keys, pa.binary())})

    renamed = anchors.toDF(*anchors.columns)  # columns of its own
    return data.groupBy(*by).cogroup(renamed.groupBy(*by)).applyInArrow(run, "key binary")


def _sorted(keys: DataFrame) -> RDD:
    """The keys, those of an anchor in one partition and in order."""
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.rdd.map(lambda r: (bytes(r.key), None)).repartitionAndSortWithinPartitions(
        tasks, lambda key: xxhash.xxh32_intdigest(key[:8])
    )


def _products(left: pa.Table, right: pa.Table, scale: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and integer products with all rows of ``left``, for each anchor of ``right``."""
    whole = lambda t: np.floor(
        scale * t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    ).reshape(t.num_rows, -1)
    x, y = whole(left), whole(right)
    if x.shape[1] * np.abs(x).max() * np.abs(y).max() < EXACT:
        for at in range(0, len(y), 64):
            for k, scores in enumerate((y[at : at + 64] @ x.T).astype(np.int64), at):
                yield k, scores
        return
    x, y = ([[int(c) for c in v] for v in m.tolist()] for m in (x, y))
    for k, q in enumerate(y):
        scores = [sum(a * b for a, b in zip(v, q)) for v in x]
        if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
            raise OverflowError("a score does not fit into a long")
        yield k, np.array(scores, np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Of the places ``among``, the first ``n`` by descending score, then id."""
    if len(among) > n:
        some = scores[among]
        among = among[some >= np.partition(some, len(some) - n)[len(some) - n]]
    return among[np.lexsort((ids[among], ~scores[among]))[:n]]


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table.column("id").to_numpy(), table.column("label").to_numpy(zero_copy_only=False)


def _nearest_same(n: int, scale: float):
    def choose(left: pa.Table, right: pa.Table) -> list[bytes]:
        (ids, labels), (own, own_labels) = _columns(left), _columns(right)
        keys = []
        for k, scores in _products(left, right, scale):
            best = _best(scores, ids, np.flatnonzero((labels == own_labels[k]) & (ids != own[k])), n)
            keys += pack(np.full(len(best), own[k]), scores[best], POSITIVE, ids[best])
        return keys

    return choose


def _nearest_others(n: int, low: int, high: int, scale: float):
    def choose(left: pa.Table, right: pa.Table) -> list[bytes]:
        (ids, labels), (own, own_labels) = _columns(left), _columns(right)
        wanted, keys = right.column("scores").to_pylist(), []
        for k, scores in _products(left, right, scale):
            other = np.flatnonzero(labels != own_labels[k])
            some = scores[other]
            found = set()
            for score in set(wanted[k]):
                least, most = window(score, low, high)
                if least <= most:
                    found.update(_best(scores, ids, other[(some >= least) & (some <= most)], n).tolist())
            best = np.array(sorted(found), np.int64)
            keys += pack(np.full(len(best), own[k]), scores[best], NEGATIVE, ids[best])
        return keys

    return choose


def _packed_positives(batches):
    for batch in batches:
        anchor, ids, scores = (batch.column(c).to_numpy() for c in ("anchor_id", "positive_id", "positive_score"))
        yield pa.RecordBatch.from_arrays([pa.array(pack(anchor, scores, POSITIVE, ids), pa.binary())], ["key"])


def _first(n: int):
    """The first ``n`` pairs of each anchor of a sorted partition."""

    def run(pairs):
        at, seen = None, 0
        for key, _ in pairs:
            anchor, score, _, ids = unpack(key)
            if anchor != at:
                at, seen = anchor, 0
            seen += 1
            if seen <= n:
                yield anchor, ids, score

    return run


def _emit(n: int, low: int, high: int):
    """Opens a window at each positive, and emits each negative for the open windows around it."""

    def run(pairs):
        at, open_windows = None, []
        for key, _ in pairs:
            anchor, score, kind, ids = unpack(key)
            if anchor != at:
                at, open_windows = anchor, []
            if kind == POSITIVE:
                open_windows.append([ids, score, *window(score, low, high), 0])
                continue
            for w in open_windows:
                if w[2] <= score <= w[3] and w[4] < n:
                    w[4] += 1
                    yield anchor, w[0], w[4], ids, w[1], score

    return run
