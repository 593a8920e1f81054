"""How this package reads tables, stores intermediate ones and keeps what a worker loads."""

from __future__ import annotations

import sys
import tempfile
import types
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from threadloom.session import CHECKPOINT_CONF, pin_utc, scratch_path, use_folder


def own_folder(spark: SparkSession) -> SparkSession:
    """A local session without a shared folder gets one; a cluster has to name it."""
    sc = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not named and sc.master.startswith("local"):
        use_folder(spark, tempfile.mkdtemp(prefix="threadloom-"))
    return spark


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return pin_utc(own_folder(spark)).read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share."""
    return scratch_path(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; a lost executor loses none of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """What a worker process makes once, for all tasks that it runs.

    Functions sent with their code bring new globals with each task, so the
    thing is kept in a module of the worker's own.
    """
    held = sys.modules.setdefault("threadloom_worker", types.ModuleType("threadloom_worker"))
    if name not in held.__dict__:
        held.__dict__[name] = make()
    return held.__dict__[name]
