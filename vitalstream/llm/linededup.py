"""Removal of repeated passages by content-defined chunks of lines, in DataFrame functions only.

A document's lines are hashed, and a rolling hash over the last ``WINDOW``
line hashes ends a chunk wherever its remainder by ``PRIME`` is divisible by ``DIVISOR``. A run of equal lines is a
chunk of its own, whatever its hashes. Boundaries so depend on
nearby lines only: a passage moved, or with lines before it inserted, is cut
in the same places. A chunk of at least ``MIN_LINES`` lines that stands in more
than one place of the corpus stays where it comes first (lowest document id, then place)
and is removed elsewhere.

Chunks meet by a 64-bit digest, combined before the shuffle: a passage in a
third of all documents is one row per task. The least and the greatest text of
a digest are compared byte by byte; if they are equal, so is all between. Texts that share a
digest without being equal are counted apart, by their bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vitalstream.llm.common import col, materialise, rows_of, settled, with_columns

#: Lines per rolling hash, its factor, the prime that mixes it, one boundary in so many lines, lines of a removable chunk.
WINDOW, FACTOR, PRIME, DIVISOR, MIN_LINES = 2, 31, 1_000_003, 2, 2


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def chunk_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``chunks``, an array of structs (``lines`` count, ``chunk`` text) that joined by newlines give ``text``.

    A null or empty text is one chunk of one empty line.
    """
    fields = df.columns
    df = settled(df, lines=F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    df = settled(df, hashes=F.transform("lines", line_hash))
    last = F.size("lines")

    def rolling(i: Column) -> Column:
        terms = [F.coalesce(F.get("hashes", i - 1 - k), F.lit(0)) * FACTOR**k for k in range(WINDOW)]
        return sum(terms[1:], terms[0])

    def cut(i: Column) -> Column:
        """Whether a chunk ends at line ``i`` (from 1): by the rolling hash, or before or after a run of equal lines."""
        before, own, after, then = (F.get("hashes", i - 2 + k) for k in range(4))
        by_hash = F.pmod(F.pmod(rolling(i), F.lit(PRIME)), F.lit(DIVISOR)) == 0
        beside_run = before.eqNullSafe(own) | after.eqNullSafe(then)
        return (own != after) & (by_hash | beside_run)

    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | cut(i))
    df = settled(df, ends=ends)
    start = lambda k: F.coalesce(F.get("ends", k - 1), F.lit(0))
    chunks = F.transform("ends", lambda end, k: F.struct(
        (end - start(k)).alias("lines"), F.array_join(F.slice("lines", start(k) + 1, end - start(k)), "\n").alias("chunk")
    ))
    return settled(df, chunks=chunks).select(*fields, "chunks")


def drop_repeated_chunks(
    df: DataFrame, text: str = "text", doc_id: str = "doc_id", min_lines: int = MIN_LINES
) -> DataFrame:
    """``df`` with repeated chunks taken out of ``text``; adds ``chunks_removed`` and ``lines_removed``.

    Documents stay, also those left without text. Null ids come last in the
    order of places; rows equal in id and text are one document and treated alike. A null text
    stays null. An empty table gives an empty result; other columns are passed on.
    """
    fields = df.columns
    where = {"id": F.coalesce(col(doc_id), F.lit(0)), "hash": F.xxhash64(col(doc_id), col(text))}
    docs = df.select(
        *[c.alias(n) for n, c in where.items()], col(doc_id).isNull().alias("last"), col(text).cast("string").alias("text")
    )
    chunked = chunk_lines(docs).select("last", "id", "hash", F.posexplode("chunks").alias("at", "c"))
    chunked = chunked.where(F.col("c.lines") >= min_lines).select(
        "last", "id", "hash", "at", F.col("c.lines").alias("lines"), F.col("c.chunk").alias("chunk"),
        F.xxhash64("c.chunk").alias("digest"),
    )
    place = F.struct("last", "id", "hash", "at")
    seen = materialise(chunked.groupBy("digest").agg(
        F.min("chunk").alias("least"), F.max("chunk").alias("most"), F.min(place).alias("first"), F.max(place).alias("final")
    ).where("first <> final").select("digest", "first", (F.col("least") == F.col("most")).alias("equal")), "digests")
    repeats = chunked.drop("chunk").join(seen.where("equal").select("digest", "first"), "digest").where(place != F.col("first"))
    repeats = repeats.select("id", "hash", "at", "lines")
    if not seen.where("not equal").isEmpty():
        # Different texts under one digest: hardly ever any, but they are told apart by their bytes.
        mixed = chunked.join(seen.where("not equal").select("digest"), "digest", "left_semi")
        texts = mixed.groupBy("chunk").agg(F.min(place).alias("first"))
        told = mixed.join(texts, "chunk").where(place != F.col("first"))
        repeats = repeats.unionByName(told.select("id", "hash", "at", "lines"))
    # Rows equal in id and text name the same places again.
    gone = repeats.groupBy("id", "hash").agg(F.collect_set(F.struct("at", "lines")).alias("gone"))
    rows = rows_of(df, **where, text=col(text).cast("string")).join(gone, ["id", "hash"], "left")
    rows = settled(chunk_lines(rows), places=F.coalesce(F.transform("gone", lambda g: g["at"]), F.array().cast("array<int>")))
    left = F.filter("chunks", lambda c, i: ~F.array_contains("places", i))
    left = F.array_join(F.transform(left, lambda c: c["chunk"]), "\n")
    text_left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    lines = F.aggregate(F.coalesce("gone", F.array().cast("array<struct<at:int,lines:int>>")), F.lit(0), lambda n, g: n + g["lines"])
    return with_columns(
        rows, fields, **{text: text_left}, chunks_removed=F.size("places"), lines_removed=lines
    )
