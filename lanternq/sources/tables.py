"""Tables that a query writes and reads again: index tables and results that several branches read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a session in one process (tests) gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tables-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialized(df: DataFrame, name: str, *cluster_by: str) -> DataFrame:
    """``df`` as a Parquet table, clustered by the given columns if any. Later reads have a plan of one scan,
    and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows = df.repartition(*cluster_by).sortWithinPartitions(*cluster_by) if cluster_by else df
    rows.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer partitions than there are cores; else as it is. Splits
    of a scan are at most ``spark.sql.files.maxPartitionBytes``, so only inputs of less than that for each
    core are ever moved, and large inputs never."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
