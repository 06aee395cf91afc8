"""Normalised tables of recognised and classified documents, each row once.

documents (document_id), ocr_results (document_id), sentences (document_id, ordinal), confidence_regions (document_id, ordinal) and
classifications (document_id, ordinal). A repeated delivery of a document replaces nothing: of equal keys, the row with the
latest ``delivered_at`` stays, so loading a batch twice gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = {"documents": ["document_id"], "ocr_results": ["document_id"], "sentences": ["document_id", "ordinal"], "confidence_regions": ["document_id", "ordinal"], "classifications": ["document_id", "ordinal"]}


def latest(rows: DataFrame, keys: list[str], order: str = "delivered_at") -> DataFrame:
    """One row per key, the latest delivered."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("__first", first).filter("__first = 1").drop("__first")


def normalised(pages: DataFrame) -> dict[str, DataFrame]:
    """Tables from page results: doc_id, delivered_at, raw_text, body_text, sentences, low_confidence_regions, engine_name, engine_version."""
    once = latest(pages.withColumnRenamed("doc_id", "document_id"), ["document_id"])
    each = lambda c, out: once.select("document_id", F.posexplode(c).alias("ordinal", out))
    return {
        "documents": once.select("document_id", "delivered_at"),
        "ocr_results": once.select("document_id", "raw_text", "body_text", "engine_name", "engine_version"),
        "sentences": each("sentences", "sentence"),
        "confidence_regions": each("low_confidence_regions", "region"),
    }


def classifications(final: DataFrame, delivered_at: str = "delivered_at") -> DataFrame:
    """Final records (batch_id, input_index, ...) keyed by document and sentence."""
    keyed = final.withColumnRenamed("batch_id", "document_id").withColumnRenamed("input_index", "ordinal")
    return latest(keyed, KEYS["classifications"], delivered_at)


def write(tables: dict[str, DataFrame], path: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
