"""Cutting a plan's lineage: checkpoints, and tables written to the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A temporary one only on a local master, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), f'lodestone-{context.applicationId}')}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written under the context's checkpoint folder, the shared one where none was named to the context."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone-tables/{spark.sparkContext.applicationId}"


def run_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor costs no recomputation."""
    path = run_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["saved_path"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of saved() that nothing reads any more."""
    for t in tables:
        path = t.__dict__.get("saved_path")
        if path:
            _delete(t.sparkSession, path)


def drop_saved(spark: SparkSession) -> None:
    """Delete every table that this application's saved() wrote; other applications' stay."""
    _delete(spark, _run_dir(spark))


def unused(df: DataFrame, name: str, *others: DataFrame) -> str:
    """A column name that neither df nor any of the others has."""
    taken = {c.lower() for d in (df, *others) for c in d.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df in a fixed number of tasks by a hash of columns. For small rows of which each makes much work (a text to build and parse):
    a file of few row groups would be read by few tasks, and adaptive execution would put a small shuffle's rows together again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *by)


def held_to(spark: SparkSession, size: int) -> None:
    """Hold Arrow batches between the JVM and workers to about `size` bytes, where the session has no bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, size)
