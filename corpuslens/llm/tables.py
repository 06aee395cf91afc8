"""Reading the corpus tables, and names for helper columns that clash with no input column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Word separators: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def words(text: Column) -> Column:
    """Array of the words of a whole text; empty for a null text or one without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def uniform(id_column: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone: 52 bits of an md5."""
    digest = F.md5(F.concat(F.coalesce(id_column.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def n_words(text: Column) -> Column:
    return F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)) == "", F.lit(0)).otherwise(
        F.regexp_count(F.btrim(text, F.lit(SPACE_CHARS)), F.lit(SPACES)) + 1
    ).cast("long")
