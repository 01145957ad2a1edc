"""Tables written between the steps of a job.

Long plans are cut by writing a table and reading it back, never by a
local checkpoint: the table outlives any executor.  Tables go to the folder
that the cluster names in ``spark.checkpoint.dir``; a private folder is made
only where that setting is absent and all of Spark runs in one process (tests, one
machine).  Inside ``steps()``, tables are deleted when their results are written; blocks
belong to the thread that opened them.  Tables written outside any block hold
results, and are deleted when the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_PRIVATE: dict[str, str] = {}
#: The steps() blocks that are open in this thread, innermost last; each lists the paths of its tables.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("steps", default=())
#: Path of a bucketed table -> its name in the session's catalog.
_NAMES: dict[str, str] = {}
#: A bucketed table as cut() returned it -> its path.
_AT: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Tables that no block deletes.
_RESULTS: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = "file://" + tempfile.mkdtemp(prefix="seqharvest-")
    return _PRIVATE[app]


def table_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/seqharvest/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table's folder, and its name if it has one."""
    if name := _NAMES.pop(path, None):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_results() -> None:
    for spark, path in _RESULTS:
        with contextlib.suppress(Exception):  # Spark may be gone
            delete(spark, path)


@contextmanager
def steps(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end; what is returned must be written with ``outlives``."""
    own: list[str] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in own:
            delete(spark, path)


def _owned(spark: SparkSession, path: str, outlives: bool) -> None:
    blocks = _OPEN.get()
    if len(blocks) > outlives:
        blocks[-1 - outlives].append(path)
    else:
        _RESULTS.append((spark, path))


def held_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a caller's own files; they are deleted like a table."""
    path = table_path(spark, name)
    _owned(spark, path, False)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd", *, outlives: bool = False) -> DataFrame:
    """Write df to the shared folder and return it as read back.  outlives: the table belongs to the block of steps around the innermost one."""
    spark = df.sparkSession
    path = table_path(spark, name)
    _owned(spark, path, outlives)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, *keys: str, codec: str = "lz4", outlives: bool = False, buckets: int | None = None) -> DataFrame:
    """df computed once and held in the shared folder, without its plan.

    keys: bucketed by them, in as many buckets as shuffles have partitions if not given, so that a join, window or
    sum by these keys needs no shuffle; df should be partitioned so already, else each task writes a file a bucket.
    """
    spark = df.sparkSession
    if not keys:
        return written(df, "cut", codec, outlives=outlives)
    path = table_path(spark, "cut")
    _owned(spark, path, outlives)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"seqharvest_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, *keys).option("compression", codec).option("path", path).saveAsTable(name)
    _NAMES[path] = name
    held = spark.table(name)
    _AT[held] = path
    return held


def release(held: DataFrame) -> None:
    """Delete a bucketed table before its block ends."""
    if path := _AT.pop(held, None):
        delete(held.sparkSession, path)
