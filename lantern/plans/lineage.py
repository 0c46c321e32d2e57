"""Cutting the lineage of iterative plans by the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Where a session of one machine writes if it names no folder, as in tests.
LOCAL = "/tmp/checkpoints/lantern"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Without one, only a session that runs in a single process goes on; elsewhere a folder of one
    machine would lose the rows with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or LOCAL


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for a table of this session, which goes when the driver ends."""
    if not _scratch:
        atexit.register(_clear)
    _scratch.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def _clear() -> None:
    jvm = SparkContext._jvm
    for path in _scratch if jvm else []:
        with contextlib.suppress(Py4JError, OSError):
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)
