"""Tables of the library's own in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir(application: str) -> str:
    made = tempfile.mkdtemp(prefix="lexiforge-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a temporary one only where that is unset and all is one process."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return f"{given.rstrip('/')}/lexiforge-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_dir(spark.sparkContext.applicationId)


def stored(df: DataFrame, path: str) -> DataFrame:
    """df, written to path and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
