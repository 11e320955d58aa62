"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HOME = str(Path(__file__).resolve().parent.parent)


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package; a cluster gets it by ``--py-files``."""
    env = spark.sparkContext.environment
    path = env.get("PYTHONPATH", "")
    if HOME not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (path, HOME) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given Parquet tables."""
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share; in local mode without the setting, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="wicker-shared-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a new table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_saved: dict[str, list[str]] = {}


def saved(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once, keep its rows as a table in the shared folder and return that table. Tables go with the application (``drop_saved``)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    app = spark.sparkContext.applicationId
    if app not in _saved:
        _saved[app] = []
        atexit.register(drop_saved, spark)
    _saved[app].append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark: SparkSession) -> None:
    """Remove the tables that ``saved`` wrote; for a caller who has written out what was made of them, and at the end."""
    if spark.sparkContext._jsc is None:
        return
    for path in _saved.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
