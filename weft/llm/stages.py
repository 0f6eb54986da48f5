"""Tables between the passes of an operator.

A written table in the folder that all executors share cuts lineage: a lost
executor costs the tasks that it ran, never a whole earlier pass.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = 100_000  # rows of numbers that may be broadcast

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where it is unset in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them see")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="llm-stages-"))
    return _OWN[0]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    except Exception:  # the session has ended: whoever owns the shared folder cleans it
        pass


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``stage`` that no later pass reads."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path is not None:
            _drop(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner remove the shuffle files of plans that nothing refers to any more."""
    for _ in range(2):  # the first run finds the plans, the second what only they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def stage(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    ``release``: what was shuffled for it is large, so let its files go now.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    del df
    if release:
        release_shuffles(spark)
    out = spark.read.schema(schema).parquet(path)
    out._staged = path
    return out


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, a few columns of a written table, marked for broadcast if it is counted to have ``rows`` rows at most."""
    return F.broadcast(df) if df.count() <= rows else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
