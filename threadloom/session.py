"""Session settings and the shared folder that intermediate data is written to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "threadloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return pin_utc(builder.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """All timestamps of this package are naive UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_folder(spark: SparkSession, path: str) -> None:
    """Name the shared folder of a session that was started without one."""
    spark.sparkContext.setCheckpointDir(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster or the caller names it."""
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    return named.rstrip("/")


def _scratch_root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/threadloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in the application's own part of it."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote under its scratch folder; results read from it are gone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    shared = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """The same by a compressed table: a checkpoint of texts takes twice their Parquet, or more.

    Rows come back in any order. Types that Parquet lacks are left to a checkpoint.
    """
    kinds = df.schema.simpleString()
    if "void" in kinds or "interval" in kinds:
        return materialise(df)
    path = scratch_path(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
