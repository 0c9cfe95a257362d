"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vitalstream.sources.tables import materialise, shared_dir

__all__ = ["col", "documents", "fresh_path", "kept_rows", "materialise", "pieces_of", "rows_of", "settled", "with_columns"]


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df: DataFrame, **named: Column) -> DataFrame:
    """Every row of ``df`` as one struct ``row`` beside the named columns.

    The operators work on the named columns alone, so no column of the input
    can clash with one of theirs.
    """
    return df.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in named.items()])


def with_columns(df: DataFrame, fields: list[str], **added: Column) -> DataFrame:
    """``row`` unfolded again; an added column replaces a field of its name in place."""
    lower = {n.lower(): n for n in added}
    kept = [
        added[lower[f.lower()]].alias(f) if f.lower() in lower else F.col("row").getField(f).alias(f)
        for f in fields
    ]
    have = {f.lower() for f in fields}
    return df.select(*kept, *[c.alias(n) for n, c in added.items() if n.lower() not in have])


def settled(df: DataFrame, **named: Column) -> DataFrame:
    """``df`` with further columns that are computed once per row.

    A plain column may be copied by the optimizer into every lambda that reads
    it, and so be computed anew for each element; a generator's output is not.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))).alias("settled")
    return df.select("*", made).select(*df.columns, "settled.*")


def kept_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[F.col("row").getField(f).alias(f) for f in fields])


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared folder."""
    return f"{shared_dir(spark)}/vitalstream/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def pieces_of(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``max_bytes`` of ``column`` each, one row at least."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > max_bytes and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
