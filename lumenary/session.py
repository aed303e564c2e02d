"""Sessions with the settings that the operators expect, and access to the given tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of keys up to which it is broadcast; larger ones are joined by sorted shuffles.
MOST_BROADCAST = 1 << 18


def session(app: str = "lumenary", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow batches of 1,000 rows (texts fill larger ones), checkpoints removed once nothing refers to them, and whatever else is given; on a cluster the master comes from the submission."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false",
                "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"} | conf
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where it names none, a local master gets one of its own; a cluster must name one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A written table of short keys for the small side of a join: broadcast if its counted rows are within the bound, else sorted."""
    kept = checkpointed(df)
    return F.broadcast(kept) if kept.count() <= most else kept.hint("merge")
