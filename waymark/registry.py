"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators.graph import stored

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
SQL: dict[str, str] = {}
_STORED: dict[tuple, DataFrame] = {}


def query(sql: str | None = None) -> Callable[[Run], Run]:
    """Registers a query by its name, with the same in SQL if it can be said there."""

    def add(f: Run) -> Run:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder, by the file system that Spark reads it with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that several queries start from (walks, segments): made and stored by the first of them in an application, and
    anew if the tables in the folder are others than then."""
    key = (spark.sparkContext.applicationId, sf_dir, state(spark, sf_dir), name)
    if key not in _STORED:
        _STORED[key] = stored(make())
    return _STORED[key]


def forget() -> None:
    """Lets the next query make its tables anew."""
    _STORED.clear()
