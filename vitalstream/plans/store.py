"""The tables of one run: each is written once, found again after a failure, and nothing else is left behind."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vitalstream.sources.tables import delete_path, path_exists, require_table, shared_dir, stage_scope, write_table

MANIFEST = "manifest"
SCHEMA = "run string, made_from string, steps string"


def fingerprint(df: DataFrame, settings: object) -> str:
    """What a run is made from: settings, schema, and the files read (the plan, where there are none)."""
    files = sorted(df.inputFiles())
    source = "\n".join(files) if files else str(df.semanticHash())
    return hashlib.sha256(f"{settings!r}\n{df.schema.json()}\n{source}".encode()).hexdigest()


class RunStore:
    """Write-once tables below a folder, with a manifest that says whose they are.

    A table is complete when the committer has marked it, so a table cut off by a failure is
    written anew. With ``resume`` complete tables of an earlier run with the same
    fingerprint are read; those of another run are refused. Intermediate tables written
    inside ``steps()`` go to a folder of the run, which is deleted at its end, and by the next
    ``resume`` if the run was killed.
    """

    def __init__(self, spark: SparkSession, folder: str | None, made_from: str, resume: bool = False):
        name = f"run-{uuid.uuid4().hex[:12]}"
        base = f"{shared_dir(spark)}/vitalstream/{spark.sparkContext.applicationId}"
        self.spark, self.folder = spark, (folder or f"{base}/{name}").rstrip("/")
        self.resume, self.done = False, set()
        steps = f"{base}/{name}-steps"
        if path_exists(spark, f"{self.folder}/{MANIFEST}/_SUCCESS"):
            owner = require_table(spark, f"{self.folder}/{MANIFEST}").first()
            if resume and owner["made_from"] != made_from:
                raise ValueError(f"{self.folder} holds a run of other data or settings")
            self.resume = resume
            delete_path(spark, owner["steps"])
        self.scope = steps
        self.put(MANIFEST, spark.createDataFrame([(name, made_from, steps)], SCHEMA).coalesce(1))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def complete(self, name: str) -> bool:
        """Whether the table is there, from this run or one that is resumed."""
        return name in self.done or self.resume and path_exists(self.spark, f"{self.path(name)}/_SUCCESS")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        write_table(df, self.path(name))
        self.done.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stored table; ``make`` is called only if it is not there."""
        return self.spark.read.parquet(self.path(name)) if self.complete(name) else self.put(name, make())

    def steps(self):
        return stage_scope(self.spark, self.scope)

