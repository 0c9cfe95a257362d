"""Reading, writing and keeping tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


# Folder of intermediate tables inside stage_scope.
_SCOPE: ContextVar[str | None] = ContextVar("stage_scope", default=None)


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    timestamp_cols: Sequence[str] = (),
    fmt: str | None = None,
) -> DataFrame:
    """Read parquet or CSV (with header); listed columns come back as ``timestamp_ntz``."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv" and schema is None:
        raise ValueError("CSV needs an explicit schema: inferring one reads the file twice")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in timestamp_cols if c in df.columns})


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # CSV keeps microseconds only when told to.
        writer = writer.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def require_table(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def load_results(
    spark: SparkSession,
    paths: Mapping[str, str],
    flag_column: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Load the result tables that exist, with common column names.

    ``ds`` becomes ``timestamp``. ``flag_column`` names, per model, the column
    to use as ``anomaly``; a flag it replaces is kept as ``anomaly_interval``.
    """
    out = {}
    for name, path in paths.items():
        if not path_exists(spark, path):
            continue
        df = spark.read.parquet(path)
        if "ds" in df.columns:
            df = df.withColumnRenamed("ds", "timestamp")
        chosen = (flag_column or {}).get(name, "anomaly")
        if chosen != "anomaly":
            df = df.withColumnRenamed("anomaly", "anomaly_interval").withColumnRenamed(chosen, "anomaly")
        out[name] = df
    return out


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_scratch()


@cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="vitalstream-")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Cuts the lineage so that a result used twice is computed once, and stays
    available when executors are lost.
    """
    spark = df.sparkSession
    path = f"{_stage_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def stage_scope(spark: SparkSession, folder: str) -> Iterator[str]:
    """Intermediate tables made inside go to ``folder``, which is deleted at the end, whether or not all went well."""
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def _stage_dir(spark: SparkSession) -> str:
    return _SCOPE.get() or f"{shared_dir(spark)}/vitalstream/{spark.sparkContext.applicationId}"


def drop_stage_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once its results are stored."""
    delete_path(spark, f"{shared_dir(spark)}/vitalstream/{spark.sparkContext.applicationId}")
