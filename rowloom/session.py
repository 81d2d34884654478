"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

RUNTIME_CONF = {
    # Parquet timestamps without zone and epoch arithmetic must agree everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Foreign keys are skewed by nature: split hot join partitions even when
    # that costs one more exchange above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sampling steps compute much per byte: keep small shuffles spread out.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # Shuffled joins sort: a hash table cannot spill, and what is small in the shuffle files, ids packed tightly, may not fit a task's memory.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def stage_root(spark: SparkSession) -> str:
    """The shared folder for staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_STAGED: dict[str, list[str]] = {}

#: Set while a table is staged: the shuffle files of the job go once its table is written, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITING: dict[str, int] = {}
_LOCK = Lock()


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside drop their shuffle files at their end; staged writes may run side by side."""
    app = spark.sparkContext.applicationId
    with _LOCK:
        _WRITING[app] = _WRITING.get(app, 0) + 1
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[app] -= 1
            if not _WRITING[app]:
                spark.conf.unset(CLEANUP)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    hadoop, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    return len(paths)


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; ``drop_stages`` deletes what lies there."""
    path = f"{stage_root(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_stages(spark: SparkSession) -> int:
    """Delete the tables that this application has staged so far; what still reads them must be done. Returns their number."""
    return _delete(spark, _STAGED.pop(spark.sparkContext.applicationId, []))


def drop_staged(*tables: DataFrame) -> int:
    """Delete the staged tables that these tables are read from; nothing may read them any more. Returns their number."""
    gone = 0
    for df in tables:
        known = _STAGED.get(df.sparkSession.sparkContext.applicationId, [])
        files = df.inputFiles()
        mine = [path for path in known if any(f"/{path.rsplit('/', 1)[1]}/" in f for f in files)]
        gone += _delete(df.sparkSession, mine)
        for path in mine:
            known.remove(path)
    return gone


def _written(df: DataFrame, codec: str | None) -> DataFrameWriter:
    return df.write if codec is None else df.write.option("compression", codec)


def stage_buckets(df: DataFrame, label: str, keys: list[str], buckets: int, codec: str | None = None) -> DataFrame:
    """``stage``, in so many buckets of ``keys``: whatever groups or joins the written table by them needs no shuffle of it."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    with _clean_shuffles(spark):
        # The folder lies with the other staged tables; the catalog only knows how it is cut.
        _written(df.repartition(buckets, *keys), codec).format("parquet").bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def stage(df: DataFrame, label: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage, survives the loss of executors and gives the next plan
    true sizes, so that small sides are broadcast and large ones are not.
    ``drop_stages`` deletes what a run has written, ``drop_staged`` single tables.
    """
    spark = df.sparkSession
    path = stage_path(spark, label)
    with _clean_shuffles(spark):
        writer = _written(df, codec)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(jobs: dict[Any, Callable[[], Any]], at_once: int = 6) -> dict[Any, Any]:
    """Run independent Spark jobs side by side, so that one fills the cores another leaves idle."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(jobs)))) as pool:
        running = {name: pool.submit(inherit(job)) for name, job in jobs.items()}
        return {name: future.result() for name, future in running.items()}
