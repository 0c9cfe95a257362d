"""Benchmark decontamination by spaced seeds.

Words of benchmark items and documents become 64-bit hashes. A mask selects
some of the next words and ignores the others, so a masked hash survives the
substitution of an ignored word. Masked hashes of items and documents are
joined; around each hit the aligned words are compared, and an overlap is a
stretch with ``MIN_MATCHES`` equal words at least, ``MIN_SHARE`` of its length.
For an item with fewer words than that, the threshold is ``MIN_SHARE`` of the item's own words,
``LEAST_MATCHES`` at least. No stretch that meets its threshold, of whatever length and wherever
its unequal words lie, is without a seed.

A document position goes into the join only if its hash passes a Bloom filter
of the items' hashes, whose size is fixed (``BLOOM_BITS``): a large benchmark
lets more positions through, and loses none.

A masked hash that more than ``HOT`` items hold is not joined: a phrase that many items and many
documents share would meet in all pairs. Such items have seeds of the wide masks instead, which fit into no phrase
below ten words, and a document has these where it holds such a hash. A minimal stretch that meets the threshold has
at most ``NEAR`` words and holds both kinds of seeds, so none is lost.

Hits carry ``REACH`` words to each side. Diagonals on which an overlap with a longer item was found
are compared once more over the whole texts of the two.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vitalstream.llm.common import col, kept_rows, materialise, pieces_of, rows_of

#: Three masks of five words, found by a greedy search: one at least fits into any stretch that meets the threshold.
MASKS = ("110111", "1101000011", "100010000111")
#: The same for items of fewer than ``MIN_MATCHES`` words; documents are looked through with these only if there are any.
SHORT_MASKS = ("11101", "100111", "1101001")
#: Masks of seven words over ten to thirteen, found likewise.
WIDE_MASKS = (
    "1101001111", "11110101001", "10001101111", "1110100000111", "1110110011", "1100010101011", "111101100001", "1100001100111",
    "1011100001011", "1001000011111", "11101010101", "111110001001", "10110010111", "110010110101", "1000000111111", "1011010111",
)
ALL_MASKS = MASKS + SHORT_MASKS + WIDE_MASKS
EVERY, FEW, WIDE = range(len(MASKS)), range(len(MASKS), len(MASKS + SHORT_MASKS)), range(len(MASKS + SHORT_MASKS), len(ALL_MASKS))
#: Items that may share a hash which is joined, and the words of the longest stretch without a smaller one that meets the threshold.
HOT, NEAR = 32, 30
MIN_MATCHES, MIN_SHARE, LEAST_MATCHES = 12, 0.75, 5
#: Words compared on each side of a hit; bits and probes of the filter.
REACH, BLOOM_BITS, PROBES = 48, 22, 3
GAP = re.compile(r"[\W_]+")
#: Characters looked at together; a word longer than that may be cut.
STRIDE = 1 << 16
#: An odd base of the word hashes, and the multiplier that mixes them.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors))
    return _powers[0], _powers[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash per word (letters and digits, lower-cased) of the whole text."""
    text, parts, at = text or "", [], 0
    while at < len(text):
        end = min(len(text), at + STRIDE)
        while end < min(len(text), at + 2 * STRIDE) and (text[end].isalnum() or not text[end].isascii()):
            end += 1
        letters = np.frombuffer((" " + GAP.sub(" ", text[at:end].lower()) + " ").encode(), np.uint8)
        at = end
        power, inverse = _tables(max(len(letters), 4096))
        # Sums of bytes times inverse powers: the difference over a word, moved back to its start, is its hash.
        sums = np.cumsum(letters * inverse[: len(letters)])
        gaps = np.flatnonzero(letters == 32)
        before, after = gaps[:-1], gaps[1:]
        filled = after - before > 1
        before, after = before[filled], after[filled]
        hashes = (sums[after - 1] - sums[before]) * power[before]
        parts.append((hashes ^ (hashes >> np.uint64(32))) * np.uint64(MIX))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def masked_hashes(words: np.ndarray, mask: int) -> np.ndarray:
    """The masked hash at every position that has room for the mask, a number in ``ALL_MASKS``."""
    chosen = ALL_MASKS[mask]
    picked = [i for i, c in enumerate(chosen) if c == "1"]
    n = len(words) - len(chosen) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    factors = np.random.default_rng(mask).integers(1 << 62, 1 << 63, len(picked), dtype=np.uint64) | np.uint64(1)
    out = np.zeros(n, np.uint64)
    for i, f in zip(picked, factors):
        out += words[i : i + n] * f
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15)


def _slots(hashes: np.ndarray, probe: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - BLOOM_BITS - 20 * probe)) & np.uint64((1 << BLOOM_BITS) - 1)


def needed(words: int) -> int:
    """The equal words that an overlap with an item of so many words has at least."""
    return MIN_MATCHES if words >= MIN_MATCHES else max(LEAST_MATCHES, math.ceil(MIN_SHARE * words))


def _through(hashes: np.ndarray, at: np.ndarray, bloom: np.ndarray | None) -> np.ndarray:
    """The places of ``at`` whose hash passes the filter."""
    for probe in range(PROBES if bloom is not None else 0):
        at = at[bloom[_slots(hashes[at], probe)]]
    return at


def item_masks(words: int) -> range | tuple:
    """The masks of an item of so many words."""
    return EVERY if words >= MIN_MATCHES else FEW if words >= LEAST_MATCHES else ()


def _places(words: np.ndarray, masks, bloom: np.ndarray | None, hot: np.ndarray | None):
    """(mask, masked hashes, places) of the seeds that pass the filter; of the wide masks only those near hashes in ``hot``."""
    close = np.zeros(len(words) + 1, np.int64)
    for mask in masks:
        hashes = masked_hashes(words, mask)
        every = np.arange(len(hashes))
        yield mask, hashes, _through(hashes, every, bloom)
        if hot is not None and mask in EVERY:
            at = _through(hashes, every, hot)
            np.add.at(close, np.maximum(at - NEAR, 0), 1)
            np.add.at(close, np.minimum(at + NEAR + 1, len(words)), -1)
    if close.any():
        near = np.flatnonzero(np.cumsum(close) > 0)
        for mask in WIDE:
            hashes = masked_hashes(words, mask)
            yield mask, hashes, _through(hashes, near[near < len(hashes)], bloom)


def _seeds(df: DataFrame, key: list[str], masks=None, bloom: np.ndarray | None = None, hot: np.ndarray | None = None) -> DataFrame:
    """Rows (key, mask, hash, at, before, around): a masked hash, its place, and the words around it.

    ``masks`` are those of a text's length (``item_masks``) if not given.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text"):
                out = []
                for row, text in enumerate(part.column("text").to_pylist()):
                    words = word_hashes(text)
                    for mask, hashes, at in _places(words, item_masks(len(words)) if masks is None else masks, bloom, hot):
                        for i in at.tolist():
                            low = max(0, i - REACH)
                            out.append((row, mask, hashes[i], i, i - low, words[low : i + REACH].view(np.int64)))
                for i in range(0, len(out), 4096):
                    yield _batch(part, key, out[i : i + 4096])

    ddl = ", ".join(f"{k} {fields[k]}" for k in key)
    return df.mapInArrow(run, f"{ddl}, mask int, hash long, at int, before int, around array<long>")


def _batch(part: pa.RecordBatch, key: list[str], out: list[tuple]) -> pa.RecordBatch:
    rows, masks, hashes, at, before, around = zip(*out)
    ends = np.cumsum([0, *map(len, around)]).astype(np.int32)
    columns = [part.column(k).take(pa.array(rows)) for k in key] + [
        pa.array(masks, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(at, pa.int32()),
        pa.array(before, pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(around))),
    ]
    return pa.RecordBatch.from_arrays(columns, [*key, "mask", "hash", "at", "before", "around"])


def _bloom(hashes: DataFrame) -> np.ndarray:
    """The filter as one boolean per slot; its slots, not the hashes, come to the driver."""
    bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
    mask = F.lit((1 << BLOOM_BITS) - 1)
    slots = F.array(*[F.shiftrightunsigned("hash", 64 - BLOOM_BITS - 20 * p).bitwiseAND(mask) for p in range(PROBES)])
    found = hashes.select(F.explode(slots).alias("slot")).distinct()
    packed = found.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("slot").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    ).toArrow()
    words = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    words[packed.column("word").to_numpy()] = packed.column("bits").to_numpy()
    bits[:] = np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)
    return bits


def overlap(mine: np.ndarray, other: np.ndarray, hit: int) -> tuple[int, int, int]:
    """(start, end, equal words) of the stretch around ``hit`` of two aligned arrays with the most equal words, ``MIN_SHARE`` of
    its length at least; of several the shortest, then the first. The word at ``hit`` is equal."""
    same = mine == other
    equal = np.concatenate([[0], np.cumsum(same)])
    # A share is met where this has not fallen from start to end.
    rest = equal - MIN_SHARE * np.arange(len(equal))
    count = np.where(rest[hit + 1 :] >= rest[: hit + 1, None], equal[hit + 1 :] - equal[: hit + 1, None], 0)
    starts, ends = np.nonzero(count == count.max())
    best = np.argmin(ends - starts)
    start, end = int(starts[best]), hit + 1 + int(ends[best])
    return start, end, int(equal[end] - equal[start])


def longest(same: np.ndarray) -> tuple[int, int, int]:
    """As ``overlap``, over all aligned words and around no hit: the last end that meets the share is found for every start."""
    equal = np.concatenate([[0], np.cumsum(same)])
    rest = equal - MIN_SHARE * np.arange(len(equal))
    after = np.maximum.accumulate(rest[::-1])[::-1]
    most = equal[np.searchsorted(-after, -rest, "right") - 1]
    # Unequal words at the end are left out, which raises the share.
    ends = np.searchsorted(equal, most)
    starts = np.flatnonzero(most - equal == (most - equal).max())
    start = int(starts[np.argmin(ends[starts] - starts)])
    return start, int(ends[start]), int(most[start] - equal[start])


FOUND = "doc_id long, id long, hash long, item_id long, doc_at int, item_at int, words int, matches int"


def _found(out: list[tuple], *more: str) -> pa.RecordBatch:
    names = [f.split()[0] for f in FOUND.split(", ")] + list(more)
    kinds = [pa.int64()] * 4 + [pa.int32()] * 4 + [pa.bool_()] * len(more)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names)


def _verify(batches):
    for batch in batches:
        out = []
        cols = [batch.column(c) for c in ("doc_id", "id", "doc_hash", "item_id", "at", "item_at", "before", "item_before")]
        docs, items = batch.column("around"), batch.column("item_around")
        for i, (doc_id, key, doc_hash, item, at, item_at, before, item_before) in enumerate(zip(*[c.to_pylist() for c in cols])):
            doc = docs[i].values.to_numpy(zero_copy_only=False)
            other = items[i].values.to_numpy(zero_copy_only=False)
            back = min(before, item_before)
            n = min(len(doc) - before, len(other) - item_before)
            start, end, same = overlap(doc[before - back : before + n], other[item_before - back : item_before + n], back)
            # The words around a hit are all of a short item, and MIN_MATCHES at least of any other.
            if same >= needed(len(other)) and same >= MIN_SHARE * (end - start):
                cut = max(item_before, len(other) - item_before) >= REACH
                out.append((doc_id, key, doc_hash, item, at - back + start, item_at - back + start, end - start, same, cut))
        yield _found(out, "cut")


def _compare(batches):
    """The longest overlap on a diagonal over two whole texts."""
    for batch in batches:
        for part in pieces_of(batch, "text", 1 << 22):
            out = []
            for r in part.to_pylist():
                doc, item, ahead = word_hashes(r["text"]), word_hashes(r["item_text"]), r["ahead"]
                i, j = max(ahead, 0), max(-ahead, 0)
                n = max(0, min(len(doc) - i, len(item) - j))
                start, end, same = longest(doc[i : i + n] == item[j : j + n])
                if same >= needed(len(item)):
                    out.append((r["doc_id"], r["id"], r["doc_hash"], r["item_id"], i + start, j + start, end - start, same))
            yield _found(out)


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per seed that a document and an item share."""
    seeds = materialise(_seeds(items, ["item_id"]), "seeds")
    masks = [*EVERY, *FEW] if not seeds.where(F.col("mask").isin(*FEW)).isEmpty() else EVERY
    hot = seeds.where(F.col("mask").isin(*EVERY)).groupBy("mask", "hash").agg(F.count_distinct("item_id").alias("n"))
    hot = materialise(hot.where(F.col("n") > HOT).drop("n"), "hot")
    held = None
    if not hot.isEmpty():
        held = _bloom(hot.select("hash"))
        shared = seeds.join(hot, ["mask", "hash"], "left_semi").select("item_id")
        wide = _seeds(items.join(shared, "item_id", "left_semi"), ["item_id"], WIDE)
        seeds = materialise(seeds.join(hot, ["mask", "hash"], "left_anti").unionByName(wide), "wide")
    found = _seeds(docs, ["doc_id", "id", "doc_hash"], masks, _bloom(seeds.select("hash")), held)
    seeds = seeds.select(
        "item_id", "mask", "hash", F.col("at").alias("item_at"), F.col("before").alias("item_before"),
        F.col("around").alias("item_around"),
    )
    return found.join(seeds, ["mask", "hash"]).drop("mask", "hash")


def find_leaks(
    df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """One row per document and item that overlap: ``doc_id``, ``item_id``, where the longest overlap starts in both, its words and equal words.

    Places are word numbers from 0. Of overlaps with one item the one with the most equal words counts, then
    the shorter, then the first. A phrase of ten or eleven words that many items and
    documents share still meets in pairs. Items below
    ``LEAST_MATCHES`` words are too common to tell a leak and are never reported. Null and empty texts
    overlap with nothing. Rows equal in id and text are one document; items with
    equal ids are one item. ``id`` and ``hash`` name the document where ids are null or repeat.
    An empty table on either side gives an empty result; other columns are not read.
    """
    key = {"id": F.coalesce(col(doc_id), F.lit(0)), "doc_hash": F.xxhash64(col(doc_id), col(text))}
    docs = df.select(
        col(doc_id).cast("long").alias("doc_id"), *[c.cast("long").alias(n) for n, c in key.items()],
        col(text).cast("string").alias("text"),
    )
    items = benchmark.select(col(item_id).cast("long").alias("item_id"), col(item_text).cast("string").alias("text"))
    checked = _hits(docs, items).mapInArrow(_verify, FOUND + ", cut boolean")
    checked = materialise(checked.groupBy(*[f.split()[0] for f in FOUND.split(", ")]).agg(F.max("cut").alias("cut")), "checked")
    cut = checked.where("cut").select("id", F.col("hash").alias("doc_hash"), "item_id", (F.col("doc_at") - F.col("item_at")).alias("ahead"))
    if not cut.isEmpty():
        whole = docs.join(cut.distinct(), ["id", "doc_hash"]).join(items.withColumnRenamed("text", "item_text"), "item_id")
        checked = checked.drop("cut").unionByName(whole.mapInArrow(_compare, FOUND))
    best = F.max(F.struct("matches", (-F.col("words")).alias("w"), (-F.col("doc_at")).alias("d"), (-F.col("item_at")).alias("i")))
    return checked.groupBy("doc_id", "id", "hash", "item_id").agg(best.alias("b")).select(
        "doc_id", "id", "hash", "item_id", (-F.col("b.d")).alias("doc_start"), (-F.col("b.i")).alias("item_start"),
        (-F.col("b.w")).alias("words"), F.col("b.matches").alias("matches"),
    )


def drop_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that overlap with no item, with all their columns."""
    fields = df.columns
    leaks = find_leaks(df, benchmark, text, doc_id).select("id", "hash").distinct()
    rows = rows_of(df, id=F.coalesce(col(doc_id), F.lit(0)).cast("long"), hash=F.xxhash64(col(doc_id), col(text)))
    return kept_rows(rows.join(leaks, ["id", "hash"], "left_anti"), fields)
