"""Tables in the folder that all executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Tables that nothing has deleted yet: those outside of any ``scratch`` first, then those of each open one.
_made: list[list[str]] = [[]]


@cache
def _of_this_machine() -> str:
    return f"file://{tempfile.mkdtemp(prefix='batchloom-')}"


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a folder of this machine where it is unset, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
    return _of_this_machine()


def place(spark: SparkSession) -> str:
    """A name in it that nothing has yet; what is written there goes with the ``scratch`` around it, or at the end."""
    at = f"{folder(spark)}/{uuid.uuid4().hex}"
    _made[-1].append(at)
    return at


def cut(df: DataFrame, *, keep: bool = False) -> DataFrame:
    """The same rows, read from a table written now: a lost executor costs no earlier step, and no step runs twice.

    ``keep`` lets the table outlive the ``scratch`` around it, as a result does.
    """
    at = place(df.sparkSession)
    if keep and len(_made) > 1:
        _made[-2].append(_made[-1].pop())
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that were written in it; what is read from them must be written or collected by then."""
    _made.append([])
    try:
        yield
    finally:
        for at in _made.pop():
            delete(spark, at)


def clear(spark: SparkSession) -> None:
    """Deletes every table of this application that is left; no result that reads them may be wanted any more."""
    while _made[0]:
        delete(spark, _made[0].pop())


def _at_the_end() -> None:
    spark = SparkSession.getActiveSession() if SparkSession._instantiatedSession is not None else None
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            clear(spark)
        except Exception:  # the JVM may be gone already
            return


atexit.register(_at_the_end)
