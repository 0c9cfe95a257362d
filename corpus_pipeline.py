"""Raw documents to packed training windows: five stages, each read from the table the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitalstream.llm import decontam, langid, linededup, packing, simhash
from vitalstream.llm.common import documents, fresh_path
from vitalstream.llm.queries import piece_digests

#: The least score of a language that is believed; at zero only texts without letters are rejected.
LEAST_SCORE = 0.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null, empty and letterless texts go; without any label to learn from, all others stay."""
    return langid.drop_undetermined(docs, least=LEAST_SCORE)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from the texts; ``n_chars`` follows the text, and every document stays."""
    found = linededup.drop_repeated_chunks(docs).drop("chunks_removed", "lines_removed")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_one_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces, with the checksums of their ids."""
    return piece_digests(packing.pack_documents(docs))


STAGES = [
    ("language ID", identify_language), ("line dedup", remove_repeated_lines), ("near duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark), ("packing", pack_windows),
]
#: Fingerprints, tokenizer ids and the packing itself have no SQL form; tests compare a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        found = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return found
        path = fresh_path(spark, f"stage-{i}")
        found.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
