"""A session with the settings that the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "loomwright", master: str | None = None, **conf: str) -> SparkSession:
    """AQE on, UTC; any setting can be given with underscores for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | {k.replace("_", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def local_folder(master: str) -> str:
    """A folder of this machine, for a master that is one machine only."""
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
    return tempfile.mkdtemp()


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints, by spark.checkpoint.dir or by the context's setting.
    Where neither is set, a local session gets a folder of its own; any other one is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        if own.isEmpty():
            spark.sparkContext.setCheckpointDir(local_folder(spark.sparkContext.master))
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = own.get()
    return at.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
