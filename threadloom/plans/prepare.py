"""From raw files to sampled, split subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.sampling import stratified_sample
from threadloom.operators.splitting import split_dataframe
from threadloom.session import materialise
from threadloom.sources.readers import read_new_csv
from threadloom.sources.writers import replace_table, write_subsets


def sample_and_split(
    posts: DataFrame,
    key: str | list[str],
    sample_size: int = 1000,
    filter_date: str | None = None,
    time_col: str = "posted_date_time",
    strata_col: str | None = None,
    fraction: float = 0.1,
    stratify_col: str | None = "posted_date_time",
    seed: int = 42,
) -> DataFrame:
    """Date filter, hourly sample and stratified split, as one table with ``split_id``.

    The sample is stored before it is split, since the split reads it three times.
    """
    sample = stratified_sample(
        posts, sample_size, key, time_col, strata_col, filter_date, seed=seed
    )
    stored = materialise(sample)
    if stored.isEmpty():
        return stored.selectExpr("*", "cast(0 as bigint) as split_id")
    return split_dataframe(stored, key, fraction=fraction, stratify_col=stratify_col, seed=seed)


def prepare_data(
    spark: SparkSession,
    source: str,
    all_data: str,
    subsets: str,
    key: str | list[str],
    filter_date: str | None = None,
    sample_size: int = 1000,
    name_contains: str | None = None,
    file_format: str = "parquet",
    seed: int = 42,
) -> DataFrame:
    """Ingest files newer than a date, keep a copy, sample, split and write subsets."""
    new = read_new_csv(spark, source, filter_date, name_contains)
    replace_table(new, all_data)
    posts = spark.read.parquet(all_data)
    split = sample_and_split(posts, key, sample_size, filter_date, seed=seed)
    write_subsets(split, subsets, file_format)
    return split
