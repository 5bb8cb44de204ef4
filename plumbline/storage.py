"""Intermediate tables in the folder that driver and executors share.

Folders stay while results that read them may still be taken; ``clean`` removes all that this process
has made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []
_local: list[str] = []


def _local_root() -> str:
    """One folder of this machine for the process, removed at its end."""
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir.

    Where the setting is absent, a master in this process (``local``) gets a local one, as in tests;
    any other raises: executors of other machines would not see what is written there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors share (master {master})")
        root = _local_root()
    folder = f"{root.rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    _made.append(folder)
    return folder


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: its lineage ends there."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clean(spark: SparkSession) -> None:
    """Removes all intermediate tables that this process has made; results not yet taken can't be read after it."""
    while _made:
        remove(spark, _made.pop())
