"""Tables written half-way through a job.

Lineage is cut by writing a Parquet table into the folder that the cluster shares in
``spark.checkpoint.dir``: whatever executor is lost later, the rows are still there.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


class Tables:
    """The tables that operators write while it is open (``with tables: ...``). Their owner removes them, and no others, once what was made of them is written."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Tables:
        _open.append(self)
        return self

    def __exit__(self, *_: object) -> None:
        _open.remove(self)

    def clear(self, spark: SparkSession) -> None:
        while self.paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_open: list[Tables] = []
#: Tables that nobody owns, by application; they go when it ends.
_rest: dict[str, Tables] = {}


def _ended(spark: SparkSession, app: str) -> None:
    if spark.sparkContext._jsc is not None:
        _rest.pop(app).clear(spark)


def _owner(spark: SparkSession) -> Tables:
    if _open:
        return _open[-1]
    app = spark.sparkContext.applicationId
    if app not in _rest:
        _rest[app] = Tables()
        atexit.register(_ended, spark, app)
    return _rest[app]


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder from ``spark.checkpoint.dir``; in local mode without the setting, a folder of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own[app] = tempfile.mkdtemp(prefix="wicker-", dir="/tmp/checkpoints")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once, keep its rows as a table in the shared folder and return that table. It goes with the ``Tables`` that are open, or else with the application."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _owner(spark).paths.append(path)
    return spark.read.schema(df.schema).parquet(path)
