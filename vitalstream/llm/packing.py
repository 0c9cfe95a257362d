"""Packing of documents into training windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the window: whole windows stand alone,
and what is left over is cut into pieces of at most ``PIECE`` ids. These meet in
groups of about ``GROUP`` by a hash. In a group each piece is a partial
partition into as many windows as their ids need at least; the two partitions
with the largest imbalance merge, the fullest window of one with the emptiest
of the other, until one is left. If a window then exceeds the capacity, the
group is dealt anew with more windows. A group has a fixed mean size,
so memory and time of a task do not follow the corpus.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from vitalstream.llm.common import col, materialise, pieces_of
from vitalstream.llm.tokens import encoder, tokenizer_path

WINDOW, PIECE, GROUP, END_ID = 1024, 512, 256, 0
#: Bytes of text that are encoded together.
TEXT_BYTES = 1 << 24
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, whole boolean"


def balanced(lengths: Sequence[int], windows: int, capacity: int | None = None) -> np.ndarray | None:
    """The window of each length, by multiway differencing into ``windows`` windows.

    None as soon as a window exceeds the capacity: windows only grow when partitions merge.
    """
    n = len(lengths)
    nodes = [(-1, -1)] * n  # a node: a length, or two nodes merged
    # A partition lists its filled windows, emptiest first, as (ids, node).
    heap = [(-length, i, [(length, i)]) for i, length in enumerate(map(int, lengths))]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # Fullest meets emptiest; where windows are left empty, nothing is added up.
        both = max(0, len(a) + len(b) - windows)
        merged = a[both:] + b[both:]
        for (x, left), (y, right) in zip(a[:both], reversed(b[:both])):
            merged.append((x + y, len(nodes)))
            nodes.append((left, right))
        merged.sort()
        if capacity is not None and merged[-1][0] > capacity:
            return None
        least = merged[0][0] if len(merged) == windows else 0
        heapq.heappush(heap, (least - merged[-1][0], order, merged))
        order += 1
    out = np.zeros(n, np.int64)
    for window, (_, node) in enumerate(heap[0][2] if heap else []):
        stack = [node]
        while stack:
            at = stack.pop()
            if at < n:
                out[at] = window
            else:
                stack.extend(nodes[at])
    return out


def pack(lengths: Sequence[int], capacity: int = WINDOW) -> np.ndarray:
    """The window of each length; as few windows as differencing fits into the capacity, from the least possible number on."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return np.empty(0, np.int64)
    if lengths.max() > capacity:
        raise ValueError("a piece exceeds the window")
    windows = max(1, -(-int(lengths.sum()) // capacity))
    while windows < len(lengths):
        found = balanced(lengths, windows, capacity)
        if found is not None:
            return found
        windows += max(1, windows // 128)
    return np.arange(len(lengths))


def _edges(n: int, window: int, piece: int) -> np.ndarray:
    """Where a document of ``n`` ids is cut: whole windows, then its rest evenly, into pieces of nearly the same length."""
    full = n - n % window
    parts = -(-(n - full) // piece)
    rest = full + (n - full) * np.arange(1, parts + 1, dtype=np.int64) // max(parts, 1)
    return np.concatenate([np.arange(0, full + 1, window, dtype=np.int64), rest])


def _cut(window: int, piece: int, tokenizer: str, end_id: int):
    names = [f.split()[0] for f in PIECES.split(", ")]
    end = end_id.to_bytes(4, "little")

    def run(batches):
        encode_all = encoder(tokenizer).encode_all
        for batch in batches:
            for part in pieces_of(batch, "text", TEXT_BYTES):
                found = pc.binary_join_element_wise(encode_all(part.column("text").to_pylist()), end, b"")
                sizes = pc.binary_length(found).to_numpy() // 4
                edges = [_edges(n, window, piece) for n in sizes.tolist()]
                row = np.repeat(np.arange(len(sizes)), [len(e) - 1 for e in edges])
                start = np.concatenate([e[:-1] for e in edges])
                length = np.concatenate([np.diff(e) for e in edges])
                # Pieces follow each other in the joined ids.
                ends = np.concatenate([[0], 4 * np.cumsum(length)]).astype(np.int32)
                ids = pa.Array.from_buffers(
                    pa.binary(), len(row), [None, pa.py_buffer(ends.tobytes()), found.buffers()[2]]
                )
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length),
                    pa.array(sizes.astype(np.int64)[row]), ids, pa.array(length == window),
                ], names)

    return run


def pack_documents(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", tokenizer: str | None = None, window: int = WINDOW,
    piece: int = PIECE, group: int = GROUP, end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``doc_tokens``, ``ids``, ``sequence_id``, ``offset``.

    ``ids`` are little-endian unsigned 32-bit numbers; ``start`` counts the
    document's ids before the piece, ``offset`` those before it in its
    sequence. Every document ends with ``end_id``, so one with a null or
    empty text is one id. Each id lies in exactly one piece, and repeated rows are documents of their own. A
    sequence holds at most ``window`` ids; its id is unique, not dense. An empty table gives
    an empty result; other columns are not read.
    """
    docs = df.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    cut = materialise(docs.mapInArrow(_cut(window, piece, tokenizer or tokenizer_path(), end_id), PIECES), "pieces")
    left = cut.where("not whole")
    groups = left.count() // group + 1
    # A number of the row, not of its content: repeated rows do not meet in one group.
    numbered = cut.withColumn("at", F.monotonically_increasing_id())
    whole = numbered.where("whole").select(
        "doc_id", "start", "length", "doc_tokens", "ids", (F.col("at") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    groups_of = F.pmod(F.xxhash64("at"), F.lit(groups)).alias("grp")
    rest = numbered.where("not whole").select("doc_id", "start", "length", "doc_tokens", "ids", groups_of)
    return whole.unionByName(_packed(rest, window).drop("grp"))


def _packed(pieces: DataFrame, window: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        key = table.column("grp")[0].as_py()
        lengths = table.column("length").to_numpy()
        found = pack(lengths, window)
        by = np.argsort(found, kind="stable")
        ends = np.cumsum(lengths[by])
        firsts = np.flatnonzero(np.diff(found[by], prepend=-1))
        offsets = np.empty(len(by), np.int64)
        offsets[by] = ends - lengths[by] - np.repeat((ends - lengths[by])[firsts], np.diff(np.append(firsts, len(by))))
        table = table.append_column("sequence_id", pa.array(((key << 32) + found) * 2 + 1))
        return table.append_column("offset", pa.array(offsets))

    return pieces.groupBy("grp").applyInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, ids binary, grp long, sequence_id long, offset long"
    )
