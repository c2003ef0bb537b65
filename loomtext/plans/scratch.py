"""Tables that a plan writes and reads again: in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The planner's sizes from here on are guesses.
UNKNOWN = 1 << 55


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, else the context's own.

    Only a local master may fall back to a temporary folder; a cluster without a shared folder is
    an error, because files in one machine's folder are lost to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomtext-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, each: int = 256 << 20) -> int:
    """Partitions for a shuffle of df's rows: the session's number, or more where the planner's size of df needs them.

    The planner gives rows that aren't in files a size of 2^63 - 1 bytes: unknown, and not 2^35 partitions.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each) if size < UNKNOWN else 0)
