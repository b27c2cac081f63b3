"""The corpus pipeline: documents through quality rules, near-duplicate removal, decontamination, secret scans and mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes every stage's rows as Parquet in the
folder that all executors share and reads them again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from sitecount.llm import decontamination, minhash_dedup, mixing, quality_rules, secret_scan
from sitecount.llm.common import release, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and every threshold."""
    return quality_rules.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by a similarity of 0.8 or more of five-word shingles: the one with the least id."""
    return minhash_dedup.keep(docs, size=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without live secrets; widely copied examples stay."""
    return secret_scan.without_live(docs, *secret_scan.places(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents taken, with how many times each is."""
    return mixing.mix(docs, mixing.domain_of(docs))


STAGES = [
    ("quality_rules", quality),
    ("minhash_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
]

#: Near-duplicate groups by sketch, edit distances and the seeded order over what is left aren't put in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{home}/{k}-{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        release(spark)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
