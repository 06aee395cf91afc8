"""Intermediate tables in the shared folder: they cut lineage and survive a lost executor."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corpuslens.session import shared_dir


_made: list[Scratch] = []


class Scratch:
    """Writes Parquet tables under one folder of the shared directory and reads them back.

    Results of operators read these tables when they are computed, so they stay until whoever has stored a result says so:
    ``released`` around the work, or ``clear``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _made.append(self)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{name}-{self._n}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def drop(self, *frames: DataFrame) -> None:
        """Remove saved tables that nothing reads any more."""
        for frame in frames:
            self._delete(frame._scratch_path)

    def remove(self) -> None:
        """Remove all tables."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released() -> Iterator[None]:
    """Remove the tables that operators made inside; for work whose result is stored before the end."""
    before = len(_made)
    try:
        yield
    finally:
        clear(before)


def clear(keep: int = 0) -> None:
    """Remove all tables made in this process but for the first ``keep`` folders."""
    while len(_made) > keep:
        _made.pop().remove()
