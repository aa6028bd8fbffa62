"""Plan helpers: cutting lineage in a folder all executors share, and broadcasts behind a check of their size."""

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses spark.checkpoint.dir of the session; only where that is unset and all runs on this machine, as in tests, a folder of its own that
    is removed at the end."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="corpusloom-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)


def settle(df: DataFrame) -> DataFrame:
    """Writes `df` to the checkpoint folder and returns it without lineage, so that it is computed once and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def maybe_broadcast(settled: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A broadcast hint if the settled table has at most `most_rows` rows; beyond that Spark joins by shuffle, with the same result."""
    return F.broadcast(settled) if settled.limit(most_rows + 1).count() <= most_rows else settled
