"""Stage tables in a folder of their own; runs in a child process so that other tests keep theirs."""

import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)


def test_stage_tables_live_in_the_shared_folder_and_can_be_dropped(tmp_path):
    script = textwrap.dedent(f"""
        import os, sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from vitalstream.sources.tables import drop_stage_tables, materialise, write_table
        spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
        kept = materialise(spark.range(5), "five")
        assert kept.count() == 5
        folder = os.path.join({str(tmp_path / "shared")!r}, "vitalstream", spark.sparkContext.applicationId)
        assert len(os.listdir(folder)) == 1
        write_table(kept, {str(tmp_path / "out")!r})
        drop_stage_tables(spark)
        assert not os.path.exists(folder)
        assert spark.read.parquet({str(tmp_path / "out")!r}).count() == 5
        print("done")
    """)
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=120)
    assert run.stdout.strip().endswith("done"), run.stderr[-2000:]
