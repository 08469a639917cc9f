"""Cutting the plan of iterative operators, and sending this package to executors."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's checkpoint folder; a temporary one is made only in local mode, where none is configured."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spanwise-"))
    return df.checkpoint()


@functools.cache
def _archive() -> str:
    package = Path(__file__).resolve().parents[1]
    return shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spanwise-"), package.name), "zip", package.parent, package.name)


#: Bytes of a batch that Spark hands to Python, unless the session sets them: rows may be long texts.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(df: DataFrame) -> DataFrame:
    """Sees to it that executors can import this package; Spark sends the archive to each of them, once a session.

    Also bounds the batches that Python gets by bytes, where the session does not, as 10,000 rows may be long texts.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getConf().contains(BATCH_BYTES):
        df.sparkSession.conf.set(BATCH_BYTES, "4m")
    if not getattr(sc, "_spanwise_shipped", False):
        sc.addPyFile(_archive())
        sc._spanwise_shipped = True
    return df
