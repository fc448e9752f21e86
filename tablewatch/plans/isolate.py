"""Jobs that may fail while they run: keep the rows of those that end, and say why the others did not.

A DataFrame is one job, and an error in one of its branches ends all of them. Here parts are run one by one and their
(small) results written to the shared folder, so a failure belongs to one part.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

FAILURES = (PySparkException, Py4JJavaError)
Item = TypeVar("Item")


def problem_of(error: Exception) -> str:
    """A short name of what went wrong: the error condition, else the class of the error."""
    if isinstance(error, Py4JJavaError):
        return error.java_exception.getClass().getSimpleName()
    return error.getCondition() or type(error).__name__


def kept(df: DataFrame, purpose: str = "results") -> DataFrame:
    """Run ``df`` now; the rows are read back from files that every executor sees."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SMALL_ROWS = 500_000  # rows that are broadcast


def small(df: DataFrame) -> DataFrame:
    """Short rows to join with, run now: broadcast if they are few, else left to a shuffle."""
    rows = kept(df, "small")
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def settled(
    items: Sequence[Item], build: Callable[[Sequence[Item]], DataFrame], purpose: str = "results"
) -> tuple[list[tuple[DataFrame, Sequence[Item]]], list[tuple[Item, str]]]:
    """Run ``build(items)`` as one job. If it fails, its halves run, down to the items that fail alone.

    Returns the frames with the items they answer, and the failed items with their problems. One scan answers all
    items when nothing fails; each failing item costs two more jobs for every halving.
    """
    if not items:
        return [], []
    try:
        return [(kept(build(items), purpose), items)], []
    except FAILURES as error:
        if len(items) == 1:
            return [], [(items[0], problem_of(error))]
    half = len(items) // 2
    low, high = settled(items[:half], build, purpose), settled(items[half:], build, purpose)
    return low[0] + high[0], low[1] + high[1]
