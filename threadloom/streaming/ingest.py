"""Incremental ingest: each new CSV file exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from threadloom import schemas
from threadloom.sources.readers import read_csv_files


def stream_files(
    spark: SparkSession,
    path: str,
    modified_after: str | None = None,
    name_contains: str | None = None,
) -> DataFrame:
    """New CSV files below a path as a stream of paths; contents are not read.

    The filters are the batch reader's: ``modified_after`` is exclusive, in UTC.
    """
    files = (
        spark.readStream.format("binaryFile")
        .option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", "true")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(path)
        .select("path", "modificationTime")
    )
    if modified_after:
        files = files.filter(F.col("modificationTime") > F.lit(modified_after).cast("timestamp"))
    if name_contains:
        files = files.filter(F.col("path").contains(name_contains))
    return files.select("path")


def ingest_available(
    files: DataFrame, target: str, checkpoint: str, schema: T.StructType = schemas.RAW_POSTS
) -> StreamingQuery:
    """Add the rows of new files to a Parquet table, then stop.

    Files of any column order are aligned by name, unreadable ones logged and
    skipped, as in a batch. The checkpoint remembers which files were taken, so
    running it again picks up later files only; each batch writes a folder of
    its own, so one that is run again replaces itself.
    """
    names = schema.fieldNames()

    def take(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.toLocalIterator()]
        rows = read_csv_files(batch.sparkSession, paths, schema)
        missing = {n: F.lit(None).cast("string") for n in names if n not in rows.columns}
        rows = rows.withColumns(missing).select(*names) if missing else rows.select(*names)
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return (
        files.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
