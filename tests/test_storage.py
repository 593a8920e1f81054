"""What is stored on the way, and what is written, is compressed and comes back whole."""

import datetime as dt
import os
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from threadloom.operators.splitting import stratified_split
from threadloom.session import _scratch_root, store
from threadloom.sources.writers import build_if_absent, write_subsets


def codecs(files):
    """Compression of the files that have rows."""
    read = [pq.ParquetFile(f).metadata for f in files]
    return {m.row_group(0).column(0).compression for m in read if m.num_rows}


def below(path):
    return [f for f in Path(path).rglob("*.parquet") if f.is_file()]


def scratch_files(spark):
    root = _scratch_root(spark).removeprefix("file:")
    return set(below(root)) if os.path.exists(root) else set()


def test_store(spark):
    rows = [
        (1, dt.datetime(1500, 1, 2, 3, 4, 5, 6), None, {"a": None}, ([1, None],), float("nan")),
        (None, None, None, None, None, None),
        (1, dt.datetime(1500, 1, 2, 3, 4, 5, 6), None, {"a": None}, ([1, None],), float("nan")),
    ]
    df = spark.createDataFrame(rows, "id int, at timestamp, big decimal(20,2), m map<string,int>, s struct<a:array<int>>, x double")
    assert store(df).dtypes == df.dtypes
    assert sorted(map(str, store(df).collect())) == sorted(map(str, df.collect()))
    assert store(df.limit(0)).count() == 0
    # a type that Parquet lacks
    assert store(df.withColumn("none", F.lit(None))).count() == 3


def test_split_rows_are_stored_compressed(spark):
    words = [F.sha2(F.concat("id", F.lit(str(i))), 256) for i in range(8)]
    df = spark.range(4_000).select("id", (F.col("id") % 3).alias("g"), F.concat_ws(" ", *words, *words, *words).alias("text"))
    before = scratch_files(spark)
    split = stratified_split(df, "g", "id", fraction=0.25)
    assert split.count() == 4_000 and split.select("id").distinct().count() == 4_000
    stored = scratch_files(spark) - before
    assert codecs(stored) == {"ZSTD"}
    assert sum(f.stat().st_size for f in stored) < 0.8 * 4_000 * 3 * 8 * 65


def test_written_tables_are_compressed(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "split_id int, text string")
    write_subsets(df, str(tmp_path / "subsets"))
    build_if_absent(df, str(tmp_path / "kb"))
    assert codecs(below(tmp_path / "subsets")) == codecs(below(tmp_path / "kb")) == {"ZSTD"}
    assert sorted(spark.read.parquet(str(tmp_path / "kb")).collect()) == sorted(df.collect())
