"""A training corpus from raw documents: rules, near-duplicates, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread
as the next stage's docs. All but the last return the columns of documents: a stage keeps or drops
whole rows, and mixing repeats rows as often as the mix takes them. The last deals the rows it gets
into shards, so its result has a row for each row of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternq.llm import decontaminate, mixing, quality_rules, sharding, simhash
from lanternq.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the rules. Null, empty and blank texts have no words and go; very long texts are judged whole; repeated
    rows pass or go alike; other columns, whatever their names, stay as they are; an empty table stays empty."""
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id (rows without one come last), of rows equal in doc_id and
    text the least in all columns. Null and empty texts are duplicates of one another; very long texts are compared whole."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item. Null, empty and blank texts leak nothing; very long texts are searched whole; rows are told apart
    by doc_id and text, so repeated rows go or stay alike; without items every row stays."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, whole. Null sources are one source; texts without words (null ones too) have no size and are not
    taken; ties go by a seeded hash of doc_id, of the text where there is none."""
    return mixing.mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of the mix with its shard and slot, without the text. Null texts count eight bytes; rows equal in doc_id and text get
    places of their own; rows without doc_id are placed by their texts."""
    return sharding.sharded(docs)


STAGES = [("quality", quality), ("dedup", dedup), ("decontamination", decontamination), ("mix", mix), ("shard", shard)]

#: Mixing fits a budget by dynamic programming and near-duplicates need a transitive closure over pairs
#: of similar texts; SQL expresses neither. Tests compare the operators, and the near-duplicate stage, with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
