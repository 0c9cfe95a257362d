"""Shards that each carry the mixture of the whole, by proportional stratified interleaving.

Rows of a source are put in a seeded random order; row i of n gets the
fractional rank (i - 1/2) / n. In the order of fractional ranks every stretch
holds the sources in proportion, so cutting it into equal runs gives shards whose
row counts differ by one at most, and whose counts of a source differ from
its share by about one.

Neither order is made in one place. Random hashes are uniform, so a row falls into one of
``cells`` ranges of the hash; a rank is the rows of the source in earlier cells plus the rank within the
cell. A cell holds a fixed number of rows on average whatever the size of a source, so a source with a third of all rows is
spread like any other, and only the counts by source and cell are summed up. The second order is a
sort by (fractional rank, hash) over ranges of both: many small sources, whose rows tie in their
fractional ranks, are spread too. Places are the rows of earlier ranges plus the place in the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vitalstream.llm.common import col, materialise, rows_of, with_columns
from vitalstream.plans.report import numbered_in_order

SHARDS, SEED, CELL_ROWS = 16, 42, 4096


def assign_shards(
    df: DataFrame, key: list[str], source: str = "source", shards: int = SHARDS, seed: int = SEED,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to ``shards - 1``) and ``slot`` (gapless from 0 in a shard).

    ``key`` names the columns that seed a row's place; rows equal in them are
    ordered by the hash of the whole row, and fully equal rows are
    interchangeable. A null source is a source of its own. Columns named
    ``shard`` or ``slot`` are replaced. Fewer rows than shards leave shards
    empty; an empty table gives an empty result. Carry narrow rows and join
    long texts back by key if they are long: the rows are shuffled twice.
    """
    fields = df.columns
    rows = rows_of(
        df, source=col(source).cast("string"),
        hash=F.xxhash64(F.lit(seed), *[col(k) for k in key]).bitwiseAND(F.lit((1 << 63) - 1)),
        whole=F.xxhash64(*[col(c) for c in fields]),
    )
    rows = materialise(rows, "rows")
    total = rows.count()
    cells = total // cell_rows + 1
    # The upper bits as a fraction: equal ranges of the hash.
    share = F.shiftright("hash", 32) / F.lit(float(1 << 31))
    rows = rows.withColumn("cell", F.floor(share * cells)).withColumn("known", F.coalesce("source", F.lit("")))
    rows = rows.withColumn("none", F.col("source").isNull())
    rows = _numbered(rows, ["none", "known"], "rank", "n", order=["hash", "whole"])
    rows = rows.withColumn("part", (F.col("rank") + 0.5) / F.col("n"))
    # Stored, as the ranges of a sort are found by a pass of their own.
    rows = materialise(rows.drop("cell", "rank", "n"), "ranked")
    rows = numbered_in_order(rows.orderBy("part", "hash", "whole", "none", "known"), "place")
    place, n = F.col("place"), F.lit(total).cast("long")
    small, extra = F.lit(total // shards), total % shards
    # The first ``extra`` shards hold one row more.
    edge = F.lit(extra * (total // shards + 1))
    shard = F.when(place < edge, F.floor(place / (small + 1))).otherwise(extra + F.floor((place - edge) / F.greatest(small, F.lit(1))))
    slot = F.when(place < edge, place % (small + 1)).otherwise((place - edge) % F.greatest(small, F.lit(1)))
    return with_columns(rows, fields, shard=shard.cast("int"), slot=slot.cast("long"))


def _numbered(rows: DataFrame, groups: list[str], rank: str, count: str, order: list[str | Column]) -> DataFrame:
    """``rank`` from 0 within ``groups`` in order of (``cell``, ``order``), and the group's row ``count``."""
    cells = rows.groupBy(*groups, "cell").agg(F.count("*").alias("in_cell"))
    up_to = Window.partitionBy(*groups).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        *groups, "cell", F.coalesce(F.sum("in_cell").over(up_to), F.lit(0)).alias("before"),
        F.sum("in_cell").over(Window.partitionBy(*groups)).alias(count),
    )
    within = F.row_number().over(Window.partitionBy(*groups, "cell").orderBy(*order)) - 1
    return rows.withColumn("within", within).join(cells, [*groups, "cell"]).withColumn(
        rank, F.col("before") + F.col("within")
    ).drop("before", "within")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in the order of their slots; readers of shard k need that folder alone."""
    ranges = sharded.repartition("shard", F.floor(F.col("slot") / 100_000))
    ranges.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
