"""A corpus pipeline: documents go through five stages, each written and read again.

Toxic documents go, one of each group of near-duplicates stays, contaminated
documents go, the rest is mixed to target weights (a document may enter twice)
and dealt to shards. All stages but the last return the columns of documents;
the last adds ``shard`` and ``slot``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import common, decontamination, mixing, sharding, simhash, toxicity


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, lets pass."""
    model = toxicity.model_for(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = common.fresh(docs, "score"), common.fresh(docs, "passages")
    return toxicity.scored(docs, model, names).where(F.col(names[0]) < toxicity.THRESHOLD).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", keep_clean),
    ("simhash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: The fitted model of the first stage cannot be said in SQL; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
