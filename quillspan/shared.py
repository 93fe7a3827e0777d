"""Where intermediate results go: the folder all executors share.

A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the
master is local (tests, notebooks on one machine) a folder of our own is made, so nothing here ever
depends on a machine-local path on a cluster.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session (a Hadoop path).

    Raises RuntimeError where none is named and the executors may run on other machines than the driver.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    ours = spark.conf.get("quillspan.shared.dir", None)
    if not ours:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("name the folder that all executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        ours = "file://" + folder
        spark.conf.set("quillspan.shared.dir", ours)
    return ours


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call uses; ``release`` deletes those of an application."""
    return f"{shared_dir(spark)}/quillspan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def kept_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that stays from run to run."""
    return f"{shared_dir(spark)}/quillspan/kept/{name}"


def release(spark: SparkSession) -> None:
    """Delete what this application has written between steps; its DataFrames can't be read any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillspan/{context.applicationId}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **figures: Column) -> tuple[DataFrame, Observation]:
    """``df`` and an observation that has ``figures`` (aggregates) of its rows once an action has run over it, without a pass of its own."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in figures.items()]), seen


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as the cluster runs at once, for work that is heavy on each row.

    Input in many splits stays as it is, without a shuffle; only input in fewer splits than cores, such as a single file
    that can't be split, is dealt out.  This changes the layout only, never the rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a context, so that they needn't have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_quillspan_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        context.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "quillspan"), "zip", root, "quillspan"))
        context._quillspan_shipped = True
