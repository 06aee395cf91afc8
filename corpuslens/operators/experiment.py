"""Profile experiment: pages x profiles x segmentation modes, statistics, truth metrics and rankings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.operators.lines import LOW_CONFIDENCE, confidence_statistics
from corpuslens.operators.metrics import evaluate, source_fidelity_arrow

#: Fixed values of the experiment grid.
PROFILES = ["grayscale", "clahe_median_adaptive", "median_adaptive_no_clahe", "otsu", "adaptive_line_removal"]
MODES = [4, 6, 11, 12]
CONFIGURATION = ("page", "profile", "psm")
RECORD = [
    "page", "source_image", "profile", "psm", "processed_image", "raw_text", "mean_confidence", "median_confidence", "low_confidence_token_ratio",
    "non_empty_token_count", "ground_truth_available", "cer", "wer", "sentence_f1", "composite_score", "sfs", "page_rank", "overall_rank",
]


def grid(pages: DataFrame, profiles: list[str] | None = None, modes: list[int] | None = None) -> DataFrame:
    """Every page with every profile and mode (an explode of a fixed list, not a join)."""
    cells = [F.struct(F.lit(p).alias("profile"), F.lit(m).alias("psm")) for p in profiles or PROFILES for m in modes or MODES]
    return pages.withColumn("__c", F.explode(F.array(*cells))).select("*", "__c.profile", "__c.psm").drop("__c")


def quality_order(prefix: str = "") -> list[Column]:
    c = lambda name: F.col(prefix + name)
    return [c("composite_score").desc(), c("sfs").desc(), c("sentence_f1").desc(), c("wer").asc(), c("cer").asc(), F.col("profile").asc(), F.col("psm").asc()]


def with_truth(records: DataFrame, truth: DataFrame, fidelity: bool = True) -> DataFrame:
    """records with ground_truth_available and, where a truth exists, the metrics."""
    joined = records.join(truth.select("page", "ground_truth"), "page", "left").withColumn("ground_truth_available", F.col("ground_truth").isNotNull())
    scored = evaluate(joined, "ground_truth", "raw_text")
    scored = source_fidelity_arrow(scored, "ground_truth", "raw_text") if fidelity else scored.withColumn("sfs", T.source_fidelity(F.coalesce("ground_truth", F.lit("")), F.coalesce("raw_text", F.lit(""))))
    known = lambda c: F.when(F.col("ground_truth_available"), F.col(c)).alias(c)
    metrics = ["cer", "wer", "sentence_f1", "composite_score", "sfs"]
    return scored.select(*records.columns, "ground_truth_available", *[known(m) for m in metrics])


def page_ranks(records: DataFrame) -> DataFrame:
    """records with page_rank: 1.. within the page over records with truth, null for others."""
    order = Window.partitionBy("page", "ground_truth_available").orderBy(*quality_order())
    return records.withColumn("page_rank", F.when(F.col("ground_truth_available"), F.row_number().over(order)))


def configuration_means(records: DataFrame) -> DataFrame:
    """Per (profile, psm): evaluated pages and mean metrics over records with truth."""
    means = [F.avg(m).alias(m) for m in ("cer", "wer", "sentence_f1", "composite_score", "sfs")]
    return records.filter("ground_truth_available").groupBy("profile", "psm").agg(F.count(F.lit(1)).alias("evaluated_pages"), *means)


def overall_ranking(means: DataFrame) -> DataFrame:
    """Configurations ranked by their means; at most profiles x modes rows."""
    return means.withColumn("overall_rank", F.row_number().over(Window.orderBy(*quality_order())))


def rank_records(records: DataFrame, prepared: Callable[[DataFrame], DataFrame] = lambda means: means) -> DataFrame:
    """Page ranks, and each configuration's overall rank on all of its records, with truth or without.

    prepared: applied to the means before they are ranked, to round them for example.
    """
    ranking = overall_ranking(prepared(configuration_means(records))).select("profile", "psm", "overall_rank")
    return page_ranks(records).join(F.broadcast(ranking), ["profile", "psm"], "left")


def run_experiment(pages: DataFrame, tokens: DataFrame, truth: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Experiment records from pages (page, source_image) and engine tokens keyed by page, profile and psm."""
    stats = confidence_statistics(tokens, CONFIGURATION, threshold)
    cells = grid(pages).withColumn("processed_image", F.concat_ws("_", "page", "profile"))
    records = cells.join(stats, list(CONFIGURATION), "left").na.fill({"raw_text": "", "low_confidence_token_ratio": 0.0, "non_empty_token_count": 0})
    return rank_records(with_truth(records, truth)).select(*RECORD)
