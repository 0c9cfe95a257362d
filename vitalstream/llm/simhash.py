"""Near duplicates by SimHash: pigeonhole blocks of the fingerprint, joined and verified by Hamming distance.

Words are runs of characters other than ASCII white space, after lowering A-Z.
A fingerprint bit is set if it is set in over half of the XXH64 hashes (seed
42) of the text's shingles, repeats included. A text with fewer words than a
shingle is one shingle; a text without words, empty or null, has fingerprint
zero and links like any other.

Two fingerprints within ``max_bits`` differ in at most that many of ``blocks``
blocks, so they agree on some choice of ``blocks - max_bits`` whole blocks.
Every choice is a key (35 keys of 27 bits at the defaults), and fingerprints
that share a key are candidates. Copies meet first: each distinct fingerprint
takes part once. Keys with two members are verified straight from their least
and greatest member. Larger buckets never become all their pairs: a breadth-first
search over the bucket links each member once to a tree. Buckets above
``MAX_BUCKET`` members are not gathered at all; their members meet at
the fingerprints between them (two fingerprints within 2k bits have one within k
of both), which is exact and linear in the bucket.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalstream.llm.common import col, materialise, pieces_of, rows_of, with_columns
from vitalstream.llm.components import components

MAX_BUCKET = 4096
#: Characters of a text looked at together.
STRIDE = 1 << 22


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit fingerprint of one text. Memory follows the stride and the longest word, not the text."""
    counts, total, carry = np.zeros(64, np.int64), 0, []
    hashed = xxhash.xxh64_intdigest
    for words in _word_runs(text or ""):
        words = carry + words
        starts = [words[i:] for i in range(shingle)]
        hashes = np.array([hashed(s, seed) for s in map(b" ".join, zip(*starts))], dtype="<u8")
        if len(hashes):
            for part in np.array_split(hashes, len(hashes) // 65536 + 1):
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(hashes)
            carry = words[len(words) - shingle + 1 :]
        else:
            carry = words
    if not total:
        return hashed(b" ".join(carry), seed) if carry else 0
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def _word_runs(text: str):
    at = 0
    while at < len(text):
        end = min(len(text), at + STRIDE)
        while end < len(text) and text[end] not in " \t\n\v\f\r":
            end += 1
        yield text[at:end].encode().lower().split()
        at = end


def with_fingerprints(df: DataFrame, text: str, name: str = "fp", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``df`` with its fingerprints as signed 64-bit integers in a further column; ``text`` itself is left out."""
    rest = [f for f in df.columns if f != text]

    def run(batches):
        for batch in batches:
            for part in pieces_of(batch, text):
                found = [fingerprint(t, shingle, seed) for t in part.column(text).to_pylist()]
                found = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in rest] + [found], [*rest, name])

    fields = [f for f in df.schema if f.name != text]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return df.mapInArrow(run, f"{ddl}, {name} long" if ddl else f"{name} long")


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """One struct (choice of blocks, their bits) per choice of ``blocks - max_bits`` blocks, as an array."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    keys = []
    for i, chosen in enumerate(combinations(masks, blocks - max_bits)):
        mask = int(np.array([sum(chosen)], dtype=np.uint64).view(np.int64)[0])
        keys.append(F.struct(F.lit(i).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask)).alias("bits")))
    return F.array(*keys)


def links_between(fps: DataFrame, max_bits: int = 4, blocks: int = 7, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints that join all pairs within ``max_bits``, directly or by steps.

    ``fps`` has one distinct ``fp`` per row. Every link returned is verified;
    links of one bucket form trees, so there are fewer than rows of the bucket.
    """
    if not 0 < max_bits < blocks <= 64:
        raise ValueError("blocks must exceed max_bits")
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("k")).select("fp", "k.*")
    buckets = keyed.groupBy("choice", "bits").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    ).where("n > 1")
    buckets = materialise(buckets, "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    pairs = buckets.where("n = 2").where(near).select("a", "b")
    members = keyed.join(buckets.where("n > 2").select("choice", "bits", "n"), ["choice", "bits"])
    gathered = (
        members.where(F.col("n") <= max_bucket).groupBy("choice", "bits").agg(F.collect_list("fp").alias("fps"))
        .select("fps").mapInArrow(_trees(max_bits), "a long, b long")
    )
    return pairs.unionByName(gathered).unionByName(
        _meetings(members.where(F.col("n") > max_bucket).select("fp").distinct(), max_bits)
    ).distinct()


def _trees(max_bits: int):
    def run(batches):
        for batch in batches:
            out = [tree(np.sort(np.array(fps.as_py(), dtype=np.int64)), max_bits) for fps in batch.column("fps")]
            a, b = (np.concatenate([t[i] for t in out]) if out else np.empty(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def tree(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning trees of the graph of distances up to ``max_bits``: each member is reached once."""
    left, a, b = fps.copy(), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count((left ^ at).view(np.uint64)) <= max_bits
            found = left[near]
            if len(found):
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _meetings(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of fingerprints that meet at a third one: one within half of ``max_bits`` of it, rounded down, one rounded up."""
    near, reach = max_bits // 2, (max_bits + 1) // 2
    flips = [sum(1 << i for i in c) for k in range(reach + 1) for c in combinations(range(64), k)]
    flips = np.array(flips, dtype=np.uint64).view(np.int64)
    close = pa.array(np.bitwise_count(flips.view(np.uint64)) <= near)

    def run(batches):
        for batch in batches:
            for fp in batch.column("fp").to_numpy(zero_copy_only=False):
                same = pa.array(np.full(len(flips), fp))
                yield pa.RecordBatch.from_arrays([pa.array(flips ^ fp), same, close], ["middle", "fp", "close"])

    met = fps.mapInArrow(run, "middle long, fp long, close boolean")
    least = met.groupBy("middle").agg(F.min(F.when(F.col("close"), F.col("fp"))).alias("a"), F.count("*").alias("n"))
    return met.join(least.where("n > 1 and a is not null"), "middle").where("fp <> a").select("a", F.col("fp").alias("b"))


def near_duplicates(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, max_bits: int = 4,
    blocks: int = 7, seed: int = 42, max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id of the documents reachable over links,
    the document's own included; null ids count as documents but never name a
    component, so it is null only where all ids of a component are. Repeated
    rows are kept. An empty table gives an empty result; other columns of
    ``df`` are not read.
    """
    docs = df.select(col(doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    docs = materialise(with_fingerprints(docs, "text", shingle=shingle, seed=seed), "fingerprints")
    named = _with_components(docs, max_bits, blocks, max_bucket)
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_components(docs: DataFrame, max_bits: int, blocks: int, max_bucket: int) -> DataFrame:
    fps = materialise(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    found = components(links_between(fps.select("fp"), max_bits, blocks, max_bucket))
    named = fps.join(found.withColumnRenamed("vertex", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return docs.join(named, "fp")


def keep_one_each(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, max_bits: int = 4,
    blocks: int = 7, seed: int = 42,
) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the document with the smallest id stays.

    Null ids come last; among documents with one id the one with the least text
    hash stays, and of rows equal in id and text one. All columns are returned.
    """
    fields = df.columns
    name = {"id": F.coalesce(col(doc_id), F.lit(0)), "hash": F.xxhash64(col(doc_id), col(text))}
    small = df.select(
        col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in name.items()], col(text).cast("string").alias("text")
    )
    small = materialise(with_fingerprints(small, "text", shingle=shingle, seed=seed), "fingerprints")
    named = _with_components(small, max_bits, blocks, MAX_BUCKET)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "id", "hash")).alias("first")
    stay = named.groupBy("root").agg(first).select("first.id", "first.hash")
    rows = rows_of(df, **name).join(stay, ["id", "hash"], "left_semi")
    copy = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    return with_columns(rows.withColumn("copy", copy).where("copy = 1"), fields)
