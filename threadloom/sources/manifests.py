"""Keeping one folder of files like another, by a manifest of what was copied.

A manifest lists a folder's files: relative path, length and content digest, with
the times at which either side was last seen to change. Two folders differ in
files that are missing, changed, or surplus in the target. A file whose length
and time are as in the manifest keeps its digest; only others are read.

Files are copied by tasks, each under a name of its own first and moved into
place when it is whole and its digest is right, so that a copy that broke off
leaves the old file or none. The manifest is committed after the copies, as a
new version beside the last one: without it the next run looks at what is there.

Sources are read by Spark; the target must be a file system that pyarrow opens.
A file is one row of its task, so it has to fit an executor's memory. Spark does
not list empty files: they are neither copied nor counted.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from threadloom.session import materialise
from threadloom.sources.readers import _path_exists, list_files

MANIFEST = "path string, length bigint, digest string, source_modified timestamp, target_modified timestamp"
#: folders whose names begin so are not listed by Spark
VERSIONS, PARTIAL = "_manifest", "_partial"
#: files whose paths one reader takes
READ_PATHS = 20_000

SAME, MISSING, CHANGED, SURPLUS = "same", "missing", "changed", "surplus"


def _bare(path: Column) -> Column:
    """A path without scheme and host's slashes: file:/x and file:///x are the same."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+|^/+", "/")


def files_below(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, full) of the files below a folder, by relative path."""
    if not _path_exists(spark, root):
        return spark.createDataFrame([], "path string, length bigint, modified timestamp, full string")
    start = F.length(_bare(F.lit(root.rstrip("/")))) + 2
    files = list_files(spark, root)
    path = F.substring(_bare(F.col("path")), start, F.length("path"))
    return files.select(path.alias("path"), "length", "modified", F.col("path").alias("full"))


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the manifests that were written to their end."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{VERSIONS}/v*/_SUCCESS")
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getParent().getName()[1:]) for s in fs.globStatus(pattern) or [])


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The last manifest of a folder; empty if it has none."""
    done = _versions(spark, root)
    if not done:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root.rstrip('/')}/{VERSIONS}/v{done[-1]}")


def _contents(spark: SparkSession, paths: list[str]) -> Iterable[DataFrame]:
    """(full, content) of named files, some at a time."""
    for at in range(0, len(paths), READ_PATHS):
        reader = spark.read.format("binaryFile").option("ignoreCorruptFiles", "false")
        yield reader.load(paths[at : at + READ_PATHS]).select(F.col("path").alias("full"), "content")


def digested(spark: SparkSession, root: str, known: DataFrame) -> DataFrame:
    """``files_below`` with ``digest``; files as in ``known`` (path, length, modified, digest) are not read."""
    listed = materialise(files_below(spark, root).join(known, ["path", "length", "modified"], "left"))
    unknown = [r.full for r in listed.where("digest IS NULL").select("full").toLocalIterator()]
    read = spark.createDataFrame([], "full string, found string")
    for some in _contents(spark, unknown):
        read = read.unionByName(some.select("full", F.sha2("content", 256).alias("found")))
    joined = listed.join(read, "full", "left")
    digest = F.coalesce("digest", "found")
    return materialise(joined.select("path", "length", "modified", "full", digest.alias("digest")))


def differences(source: DataFrame, target: DataFrame) -> DataFrame:
    """(path, state) over the files of both: ``same``, ``missing``, ``changed`` or ``surplus`` in the target."""
    a = source.select("path", F.col("digest").alias("_source"))
    b = target.select("path", F.col("digest").alias("_target"))
    state = (
        F.when(F.col("_target").isNull(), MISSING)
        .when(F.col("_source").isNull(), SURPLUS)
        .when(F.col("_source") == F.col("_target"), SAME)
        .otherwise(CHANGED)
    )
    return a.join(b, "path", "full").select("path", state.alias("state"))


def _file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _put(root: str) -> Callable[[Iterable[Row]], None]:
    """Task function: files to their places, whole or not at all."""

    def run(rows: Iterable[Row]) -> None:
        system, base = _file_system(root)
        for row in rows:
            if hashlib.sha256(row.content).hexdigest() != row.digest:
                raise RuntimeError(f"{row.path} changed while it was copied")
            part, place = f"{base}/{PARTIAL}/{uuid.uuid4().hex}", f"{base}/{row.path}"
            system.create_dir(f"{base}/{PARTIAL}", recursive=True)
            with system.open_output_stream(part) as out:
                out.write(row.content)
            system.create_dir(place.rsplit("/", 1)[0], recursive=True)
            system.move(part, place)

    return run


def _drop(root: str) -> Callable[[Iterable[Row]], None]:
    """Task function: files deleted; one that is gone already is none."""

    def run(rows: Iterable[Row]) -> None:
        system, base = _file_system(root)
        for row in rows:
            try:
                system.delete_file(f"{base}/{row.path}")
            except FileNotFoundError:
                pass

    return run


def sync(spark: SparkSession, source: str, target: str, drop_surplus: bool = False) -> DataFrame:
    """Copy what the target lacks or has otherwise; (path, state) as it was before.

    Surplus files are left alone unless asked for. Two runs at a time on one
    target may copy a file twice, never half.
    """
    last = read_manifest(spark, target)
    own = last.select("path", "length", F.col("source_modified").alias("modified"), "digest")
    theirs = last.select("path", "length", F.col("target_modified").alias("modified"), "digest")
    wanted, held = digested(spark, source, own), digested(spark, target, theirs)
    found = materialise(differences(wanted, held))
    todo = found.where(F.col("state").isin(MISSING, CHANGED)).join(wanted, "path").select("path", "full", "digest")
    todo = materialise(todo)
    paths = [r.full for r in todo.select("full").toLocalIterator()]
    for some in _contents(spark, paths):
        some.join(todo, "full").select("path", "digest", "content").foreachPartition(_put(target))
    if drop_surplus:
        found.where(F.col("state") == SURPLUS).select("path").foreachPartition(_drop(target))
    placed = files_below(spark, target).select("path", "length", F.col("modified").alias("target_modified"))
    entries = wanted.select("path", "length", "digest", F.col("modified").alias("source_modified"))
    number = (_versions(spark, target) or [0])[-1] + 1
    manifest = entries.join(placed, ["path", "length"]).select("path", "length", "digest", "source_modified", "target_modified")
    manifest.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{VERSIONS}/v{number}")
    return found
