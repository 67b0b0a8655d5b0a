"""What the operators share: the shared folder, row identity, ASCII case folding."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write.

    It is the session's ``spark.checkpoint.dir``, else the context's checkpoint
    folder.  Only a local master gets a temporary one.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="cadenza-"))
    return sc.getCheckpointDir().rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cadenza/{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete all stashed tables; call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/cadenza")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """A broadcast whose classes travel with it; call it in a worker.  The value's size must be bounded."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_case(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
