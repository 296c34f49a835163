"""Session settings and reliable lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Largest number of rows a side may have to be broadcast or taken to the driver.
SMALL_ROWS = 200_000


def build_session(name: str = "tesselith", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator expects; cluster settings given outside win over none of them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder all executors share: the one the session names, else a temporary one, in local mode only."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir isn't set; name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tesselith-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_or_none(df: DataFrame, bound: int = SMALL_ROWS) -> list | None:
    """The rows of df if there are at most ``bound`` of them, else None; never takes more than bound + 1 rows."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None
