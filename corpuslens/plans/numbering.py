"""Gapless numbering inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 20_000


def hash_order(id_column: str) -> Column:
    """Hex md5 of the id: a fixed pseudo-random order that any SQL engine can repeat."""
    return F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary"))


def number_within(df: DataFrame, group: str, id_column: str, out: str, rows: int) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... inside each value of ``group``, in the order of md5(id), id.

    Rows are cut into ranges by leading md5 digits (about ROWS_PER_RANGE rows each, from the row
    count given), ranges are counted by a partially aggregated group-by, and a row's number is
    the running total of the ranges before its own plus its position inside the range. A group that
    holds most rows is therefore spread over many tasks. Rows with equal ids are numbered in
    no particular order among themselves. ``df`` must be cheap or materialised: it is read twice.
    """
    digits = 1
    while 16**digits * ROWS_PER_RANGE < rows and digits < 8:
        digits += 1
    keyed = df.withColumn("__h", hash_order(id_column)).withColumn("__r", F.substring("__h", 1, digits))
    counts = keyed.groupBy(group, "__r").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col(group).alias("__g"), F.col("__r").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy(group, "__r").orderBy("__h", id_column))
    return (
        keyed.withColumn("__p", inside.cast("long"))
        .join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__r") == F.col("__s")))
        .withColumn(out, F.col("__before") + F.col("__p") - 1)
        .drop("__h", "__r", "__p", "__g", "__s", "__before")
    )
