"""Session settings: checkpoint folder, block size, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_CONF = "caseloom.block.events"
BLOCK_DEFAULT = 50_000
BROADCAST_CONF = "caseloom.broadcast.rows"
BROADCAST_DEFAULT = 200_000


def block_size(spark: SparkSession) -> int:
    """Most events of one case that a single task may have to order."""
    return int(spark.conf.get(BLOCK_CONF, str(BLOCK_DEFAULT)))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without that setting gets a temporary folder, one for the whole session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="caseloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager)


def settled(df: DataFrame) -> DataFrame:
    """A table read many times: computed once, broadcast when its counted size allows."""
    return small(cut(df))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` only when its counted size is under the limit.

    Beyond the limit the plain table is returned and the join shuffles.
    """
    limit = int(df.sparkSession.conf.get(BROADCAST_CONF, str(BROADCAST_DEFAULT)))
    over = df.limit(limit + 1).count() > limit
    return df if over else F.broadcast(df)
