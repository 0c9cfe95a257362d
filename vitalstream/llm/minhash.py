"""Near duplicates by MinHash with tensored banding.

A document's set is the 64-bit hashes of its distinct word shingles. Instead of
one group of minhashes per table, two small collections ``A`` and ``B`` of ``parts`` hashes
each are computed, every one over ``rows`` minhashes, and each pair (A_i, B_j) is the
key of a table: ``parts ** 2`` tables of ``2 * rows`` minhashes from ``2 * parts * rows``
minhashes (256 tables from 128 at the defaults). A pair of similarity s meets in none of them
with probability 1 - (1 - (1 - s^rows)^parts)^2, 1.5e-5 at 0.85.

Copies come first: equal sets are one. An A_i or B_j that a set has for itself makes no
key at all, so most documents never leave the first count. Candidates are
confirmed on their full sets. A bucket is not unfolded into its pairs:

1. every member meets the bucket's least member, and the links found name components;
2. buckets that still hold several components are compared further, joined by what they share of
   ``A``, which covers every pair of theirs. Members are dealt to blocks of bounded size,
   each pair of blocks is one group, intersections are matrix products over the shingles, and
   only links that join two components leave it.

So every pair that shares a key and lies in different components is compared, however large the bucket.

Spark sizes a table by its compressed file and by default widths of its columns, and an exploded row like the row it
comes from. Such sizes can be far too low, so joins with these tables are sort-merge joins by hint (``_merged``), and
none of them is sent to the driver for a broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from vitalstream.llm.common import col, materialise, pieces_of
from vitalstream.llm.components import components
from vitalstream.llm.simhash import _word_runs

SHINGLE, PERCENT, ROWS, PARTS, SEED = 3, 85, 4, 16, 42
#: Shingles of one block of members, for how many more each member counts, and columns of one matrix product.
BLOCK_SHINGLES, MEMBER, COLUMNS = 1 << 18, 128, 1 << 13
#: Shingles that are hashed by all minhashes at once.
STRIDE = 1 << 13
#: Slots of the filter through which texts are read again: 2 MB, whatever the number of texts.
FILTER_BITS = 24


def shingles(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending. Memory follows the set and the longest word, not the text."""
    found, carry, some = np.empty(0, np.uint64), [], False
    hashed = xxhash.xxh64_intdigest
    for words in _word_runs(text or ""):
        words = carry + words
        new = [hashed(s, seed) for s in map(b" ".join, zip(*[words[i:] for i in range(size)]))]
        if new:
            some = True
            found = np.unique(np.concatenate([found, np.array(new, np.uint64)]))
            carry = words[len(words) - size + 1 :]
        else:
            carry = words
    if not some and carry:
        found = np.array([hashed(b" ".join(carry), seed)], np.uint64)
    return found


class Signer:
    """The two collections of hashes of a set."""

    def __init__(self, rows: int, parts: int, seed: int):
        rng = np.random.default_rng(seed)
        odd = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors, self.weights = odd(2 * parts * rows)[:, None], odd(rows)
        self.rows, self.parts = rows, parts

    def keys(self, found: np.ndarray) -> np.ndarray:
        """``2 * parts`` 64-bit hashes: the ``A`` ones, then the ``B`` ones."""
        least = np.full(len(self.factors), np.iinfo(np.uint64).max)
        for at in range(0, len(found), STRIDE):
            least = np.minimum(least, (self.factors * found[at : at + STRIDE]).min(axis=1))
        return (least.reshape(-1, self.rows) * self.weights).sum(axis=1, dtype=np.uint64).view(np.int64)


def _signed(docs: DataFrame, size: int, rows: int, parts: int, seed: int) -> DataFrame:
    """``at``, ``doc_id``, ``md5`` of the text, ``digest`` of the set, its size ``n`` and its ``keys``."""

    def run(batches):
        signer = Signer(rows, parts, seed)
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 22):
                sets = [shingles(t, size, seed) for t in part.column("text").to_pylist()]
                keys = np.concatenate([signer.keys(s) for s in sets])
                offsets = np.arange(len(sets) + 1, dtype=np.int32) * (2 * parts)
                yield pa.RecordBatch.from_arrays([
                    part.column("at"), part.column("doc_id"), part.column("md5"),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                ], ["at", "doc_id", "md5", "digest", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"at long, doc_id {kind}, md5 binary, digest binary, n long, keys array<long>"
    return docs.withColumns({"at": F.monotonically_increasing_id(), "md5": _md5()}).mapInArrow(run, schema)


def _merged(df: DataFrame) -> DataFrame:
    """``df`` for a sort-merge join, neither side of which is broadcast."""
    return df.hint("merge")


def _md5():
    return F.unhex(F.md5("text"))


def _held(wanted: DataFrame, docs: DataFrame, size: int, seed: int) -> DataFrame:
    """The full sets ``shingles`` of the sets ``wanted`` (``at``, ``md5`` of a text with it, others kept), made anew from their texts.

    A filter of fixed size lets these texts pass and few others, so that not all texts are shuffled; the join
    is exact. Copies are combined before.
    """
    bits = _slots_of(wanted)

    def passing(batches):
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            yield batch.drop_columns(["h"]).filter(pa.array(np.logical_and(*(_bit(bits, s) for s in _slots(h)))))

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, "text", 1 << 22):
                packed = [shingles(t, size, seed).tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("at"), part.column("n"), pa.array(packed, pa.binary())], ["at", "n", "shingles"])

    read = docs.select("text", _md5().alias("md5")).withColumn("h", F.xxhash64("md5")).mapInArrow(
        passing, "text string, md5 binary"
    )
    texts = read.join(wanted, "md5").groupBy("at").agg(F.first("n").alias("n"), F.first("text").alias("text"))
    return texts.mapInArrow(run, "at long, n long, shingles binary")


def _slots(h):
    """Two slots of a 64-bit hash; of a column or of numbers."""
    mask = (1 << FILTER_BITS) - 1
    if isinstance(h, np.ndarray):
        return h & np.uint64(mask), h >> np.uint64(64 - FILTER_BITS)
    return h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 64 - FILTER_BITS)


def _bit(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1


def _slots_of(wanted: DataFrame) -> np.ndarray:
    """The filter as packed bits. Its bytes come to the driver, not the texts' hashes."""
    slots = wanted.select(F.explode(F.array(*_slots(F.xxhash64("md5")))).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1), F.col("slot").bitwiseAND(F.lit(7)).cast("int"))
    found = slots.groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.bit_or(one).alias("bits")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    bits[found.column("byte").to_numpy()] = found.column("bits").to_numpy()
    return bits


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT,
    rows: int = ROWS, parts: int = PARTS, seed: int = SEED,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Words are runs of characters other than ASCII white space, after lowering
    A-Z; a text with fewer words than a shingle is one shingle. Documents link where
    100 * intersection >= ``percent`` * union of their sets. ``component_id`` is the smallest id
    reachable, the document's own included; null ids count as documents but never name a
    component with another id in it. A text without words (null, empty, blank) has size 0 and links with
    nothing. ``kept`` is true where the id names its component, for each of several rows that
    repeat it, and false for null ids. An empty table gives an empty result; other columns of ``df`` are not read.
    """
    docs = df.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    texts, docs = docs, materialise(_signed(docs, shingle, rows, parts, seed), "signatures")
    sets = materialise(
        docs.where("n > 0").groupBy("digest").agg(
            F.min("at").alias("at"), F.min("md5").alias("md5"), F.min("doc_id").alias("least"), F.first("n").alias("n"),
            F.first("keys").alias("keys"),
        ), "distinct-sets",
    )
    sides = materialise(_live_sides(sets, parts), "live-hashes")
    members = materialise(_members(sides), "table-members")
    ends = members.select("at").unionByName(members.select(F.col("pivot").alias("at"))).distinct()
    wanted = materialise(sets.select("at", "md5", "n").join(_merged(ends), "at", "left_semi"), "candidates")
    held = materialise(_held(wanted, texts, shingle, seed), "candidate-sets")
    found = components(_links(sides, members, held, percent))
    named = sets.select("digest", "least", "at").join(_merged(found.withColumnRenamed("vertex", "at")), "at", "left").select(
        "digest", "least", F.coalesce("root", "at").alias("root")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("digest", "root").join(least, "root").select("digest", "component_id")
    alone = docs.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    linked = docs.where("n > 0").select("doc_id", "n", "digest").join(named, "digest").select("doc_id", "n", "component_id")
    return linked.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _live_sides(sets: DataFrame, parts: int) -> DataFrame:
    """``at`` and those of its hashes ``a`` and ``b`` that another set has too, place and hash mixed into one number."""
    hashes = sets.select("at", F.posexplode("keys").alias("i", "k")).select(
        "at", (F.col("i") < parts).alias("is_a"), F.xxhash64("i", "k").alias("h")
    )
    live = hashes.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    side = lambda flag: F.collect_list(F.when(flag, F.col("h")))
    return hashes.join(_merged(live), "h").groupBy("at").agg(
        side(F.col("is_a")).alias("a"), side(~F.col("is_a")).alias("b")
    ).where("size(a) > 0 and size(b) > 0")


def _members(sides: DataFrame) -> DataFrame:
    """``at``, its hash ``a`` and the table's least member ``pivot``, for each table in which it meets another set."""
    keyed = sides.select("at", F.explode("a").alias("a"), "b").select("at", "a", F.explode("b").alias("b")).select(
        "at", "a", F.xxhash64("a", "b").alias("key")
    )
    tables = keyed.groupBy("key").agg(F.min("at").alias("pivot"), F.count("*").alias("c")).where("c > 1").drop("c")
    return keyed.join(_merged(tables), "key").where("at <> pivot").select("at", "a", "pivot")


def _links(sides: DataFrame, members: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between distinct sets with the components of all links among candidates."""
    sizes = held.select("at", "n")
    met = members.select(F.col("pivot").alias("a"), F.col("at").alias("b")).distinct()
    met = met.join(_merged(sizes.toDF("a", "na")), "a").join(_merged(sizes.toDF("b", "nb")), "b").where(
        F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    ).select("a", "b")
    first = materialise(_confirmed(met, held, percent), "first-links")
    return first.unionByName(_open_links(sides, members, held, components(first), percent))


def _confirmed(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = held.select(F.col("at").alias("a"), F.col("shingles").alias("x"))
    right = held.select(F.col("at").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            ok = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                p, q = (np.frombuffer(c[k].as_buffer(), np.uint64) for c in (x, y))
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok[k] = 100 * both >= percent * (len(p) + len(q) - both)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(_merged(left), "a").join(_merged(right), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _open_links(sides: DataFrame, members: DataFrame, held: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """Links between members of different components that share a table, enough to join what is linked."""
    labels = materialise(held.select("at", "n").join(_merged(named.withColumnRenamed("vertex", "at")), "at", "left").select(
        "at", "n", F.coalesce("root", "at").alias("label")
    ), "labels")
    # A table is open if a member is not in its pivot's component; all who share the table's hash of A may be in it.
    known = _merged(labels.select("at", "label"))
    other = _merged(labels.select(F.col("at").alias("pivot"), F.col("label").alias("other")))
    opened = members.join(known, "at").join(other, "pivot").where("label <> other").select("a").distinct()
    rows = sides.select("at", F.explode("a").alias("a")).join(_merged(opened), "a").join(_merged(labels), "at")
    rows = materialise(rows.select("a", "at", "label", (F.col("n") + MEMBER).alias("n")), "open-members")
    # Groups with the same members are one. Two members have met already.
    mixed = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)"))
    groups = rows.groupBy("a").agg(
        F.count("*").alias("c"), mixed("at").alias("sum"), mixed("at", "n").alias("sum2"), F.sum("n").alias("n"),
        F.min_by("label", "at").alias("first"), F.min("at").alias("low"), F.max("at").alias("high"),
    ).where("c > 2")
    groups = groups.groupBy("c", "sum", "sum2", "low", "high").agg(F.min(F.struct("a", "n", "first")).alias("g")).select(
        "g.a", "g.first", F.expr(f"g.n div {BLOCK_SHINGLES}").alias("asked")
    )
    rows = rows.join(_merged(groups), "a")
    asking = rows.where("label <> first").groupBy("a").agg(F.expr(f"sum(n) div {BLOCK_SHINGLES}").alias("asking"))
    # A large group is dealt anew before its members are copied for the blocks.
    rows = rows.join(_merged(asking), "a").repartition("at")
    block = lambda n: F.pmod(F.xxhash64("at"), F.col(n) + 1)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n)))
    # A member stays in its block of the asked and meets every block of those that ask.
    asked = rows.select(
        "a", "at", "label", F.lit(False).alias("asks"), block("asked").alias("there"), every("asking").alias("here")
    )
    asking = rows.where("label <> first").select(
        "a", "at", "label", F.lit(True).alias("asks"), every("asked").alias("there"), block("asking").alias("here")
    )
    dealt = asked.unionByName(asking).join(_merged(held.select("at", "shingles")), "at")

    def run(group: pa.Table) -> pa.Table:
        a, b = _forest(group, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("a", "there", "here").applyInArrow(run, "a long, b long")


def _forest(group: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links between those that ask and the others of a group, as many as join two labels."""
    asks = group.column("asks").to_numpy(zero_copy_only=False)
    if not asks.any() or asks.all():
        return [], []
    at, label = (group.column(c).to_numpy().copy() for c in ("at", "label"))
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for c in group.column("shingles").chunks for s in c]
    sizes = np.array([len(s) for s in sets])
    ours, theirs = np.flatnonzero(asks), np.flatnonzero(~asks)
    both = _intersections([sets[k] for k in ours], [sets[k] for k in theirs])
    close = 100 * both >= percent * (sizes[ours][:, None] + sizes[theirs] - both)
    a, b = [], []
    for k, row in zip(ours, close):
        for other in theirs[row & (label[theirs] != label[k])]:
            if label[other] != label[k]:
                a.append(int(at[k]))
                b.append(int(at[other]))
                label[label == label[other]] = label[k]
    return a, b


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of 0-1 matrices over the shingles both sides have."""
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.int64)

    def places(values, sets):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.searchsorted(shared, values)
        fine = shared[np.minimum(place, len(shared) - 1)] == values
        order = np.argsort(place[fine], kind="stable")
        return owner[fine][order], place[fine][order]

    if not len(shared):
        return out
    (ox, px), (oy, py) = places(x, left), places(y, right)
    for start in range(0, len(shared), COLUMNS):
        sides = []
        for owner, place, n in ((ox, px, len(left)), (oy, py, len(right))):
            lo, hi = np.searchsorted(place, [start, start + COLUMNS])
            side = np.zeros((n, min(COLUMNS, len(shared) - start)), np.float32)
            side[owner[lo:hi], place[lo:hi] - start] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out
