"""Fallback triggers, region merging, scorecards, segmented monitoring and capacity, as DataFrame expressions.

These follow designs that were specified but never built elsewhere; no parity with running code is claimed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.text import bind, is_blank
from corpuslens.operators.lines import LOW_CONFIDENCE
from corpuslens.operators.tokens import as_pages


@dataclass(frozen=True)
class TriggerLimits:
    """A page falls back when one of these is passed."""

    mean_confidence: float = 50.0
    low_share: float = 0.4
    low_run: int = 5
    symbol_share: float = 0.3
    tokens_per_line: float = 1.5


def low_confidence_runs(tokens: DataFrame, key: str = "doc_id", threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """key, run (from 1), first_ord, last_ord, length of every run of neighbouring tokens below the threshold.

    A run begins at a low token after none or a high one, and ends before the next high one; both are found in the page's array.
    """
    pages = as_pages(tokens, (key,), ("confidence",))
    seen = F.transform("tokens", lambda x: F.struct(x.ord.alias("ord"), F.coalesce(x.confidence < threshold, F.lit(False)).alias("low")))

    def runs(t: Column) -> Column:
        edges = lambda step: F.filter(F.transform(t, lambda x, i: F.when(x.low & ~F.coalesce(F.get(t, i + step).low, F.lit(False)), i)), lambda i: i.isNotNull())
        run = lambda a, b: F.struct(F.get(t, a).ord.alias("first_ord"), F.get(t, b).ord.alias("last_ord"), (b - a + 1).cast("long").alias("length"))
        return F.zip_with(edges(-1), edges(1), run)

    found = pages.select(key, F.posexplode(bind(seen, runs)).alias("run", "__r"))
    return found.select(key, (F.col("run") + 1).alias("run"), "__r.first_ord", "__r.last_ord", "__r.length")


def fallback_triggers(tokens: DataFrame, key: str = "doc_id", limits: TriggerLimits | None = None, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """key, the figures of each page and ``triggers``: the names of the limits that it passes, in a fixed order.

    A page without a non-blank token has the one trigger "blank".
    """
    limits = limits or TriggerLimits()
    rows = tokens.select(key, F.inline("tokens")) if "tokens" in tokens.columns else tokens
    rows = rows.filter(~is_blank(F.col("text")))
    odd = F.length("text") - F.length(F.regexp_replace("text", r"[^\p{L}\p{N}\s.,;:!?'\"()-]", ""))
    figures = rows.groupBy(key).agg(
        F.avg("confidence").alias("mean_confidence"),
        F.avg((F.col("confidence") < threshold).cast("double")).alias("low_share"),
        (F.sum(odd) / F.sum(F.length("text"))).alias("symbol_share"),
        (F.count(F.lit(1)) / F.count_distinct("top")).alias("tokens_per_line"),
    )
    runs = low_confidence_runs(tokens, key, threshold).groupBy(key).agg(F.max("length").alias("low_run"))
    out = tokens.select(key).distinct().join(figures, key, "left").join(runs, key, "left").withColumn("low_run", F.coalesce("low_run", F.lit(0).cast("long")))
    passed = {
        "low_mean_confidence": F.col("mean_confidence") < limits.mean_confidence,
        "low_share": F.col("low_share") > limits.low_share,
        "low_run": F.col("low_run") >= limits.low_run,
        "symbols": F.col("symbol_share") > limits.symbol_share,
        "sparse": F.col("tokens_per_line") < limits.tokens_per_line,
    }
    named = F.array_compact(F.array(*[F.when(test, name) for name, test in passed.items()]))
    return out.withColumn("triggers", F.when(F.col("mean_confidence").isNull(), F.array(F.lit("blank"))).otherwise(named))


def merged_regions(tokens: DataFrame, width: Column, height: Column, padding: int = 4, key: str = "doc_id", threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """key, line, region (from 1), left, top, right, bottom, tokens: low-confidence boxes of a line, padded, merged where they touch.

    width, height: the page's size; regions are cut at its edges. Lines are told apart by their top.
    """
    low = tokens.filter(~is_blank(F.col("text")) & (F.col("confidence") < threshold))
    boxes = low.select(
        key, F.col("top").alias("line"), F.greatest(F.col("left") - padding, F.lit(0)).alias("l"), F.greatest(F.col("top") - padding, F.lit(0)).alias("t"),
        F.least(F.col("left") + F.col("width") + padding, width).alias("r"), F.least(F.col("top") + F.col("height") + padding, height).alias("b"),
    )
    line = Window.partitionBy(key, "line").orderBy("l", "r")
    reach = F.max("r").over(line.rowsBetween(Window.unboundedPreceding, -1))
    starts = boxes.withColumn("__new", F.when(F.coalesce(F.col("l") > reach, F.lit(True)), 1).otherwise(0))
    numbered = starts.withColumn("region", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "line", "region").agg(F.min("l").alias("left"), F.min("t").alias("top"), F.max("r").alias("right"), F.max("b").alias("bottom"), F.count(F.lit(1)).alias("tokens"))


def merge_readings(baseline: DataFrame, readings: DataFrame, key: str = "doc_id") -> DataFrame:
    """baseline tokens (key, ord, text) with the text of an accepted second reading, the first text kept, and where the text is from.

    readings: key, ord, text, accepted. Only accepted, non-blank readings replace a text.
    """
    other = readings.filter(F.col("accepted") & ~is_blank(F.col("text"))).select(F.col(key).alias("__k"), F.col("ord").alias("__o"), F.col("text").alias("__t"))
    joined = baseline.join(other, (F.col(key) == F.col("__k")) & (F.col("ord") == F.col("__o")), "left")
    return joined.select(key, "ord", F.coalesce("__t", "text").alias("text"), F.col("text").alias("baseline_text"), F.when(F.col("__t").isNotNull(), "second").otherwise("baseline").alias("source"))


def scorecard(candidates: DataFrame, weights: dict[str, float], gates: dict[str, float]) -> DataFrame:
    """candidates with score (weighted mean of their figures), passed (every gate's figure at least its bound) and rank among the passed.

    A null figure counts 0 in the score and fails its gate. Ranks are for tables of a few candidates.
    """
    total = sum(weights.values())
    score = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * (w / total) for c, w in weights.items()), F.lit(0.0))
    passed = F.lit(True)
    for c, least in gates.items():
        passed = passed & F.coalesce(F.col(c) >= least, F.lit(False))
    names = [c for c in candidates.columns if c not in weights and c not in gates]
    out = candidates.withColumns({"score": score, "passed": passed})
    order = Window.partitionBy("passed").orderBy(F.desc("score"), *names)
    return out.withColumn("rank", F.when(F.col("passed"), F.row_number().over(order)))


def segmented(rows: DataFrame, segments: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures for every combination of segment values and every subset of the segments; ``all`` stands for a summed-up segment."""
    grouped = rows.cube(*segments).agg(F.grouping_id().alias("__id"), *[m.alias(n) for n, m in measures.items()])
    bit = lambda i: F.col("__id").bitwiseAND(1 << (len(segments) - 1 - i)) != 0
    return grouped.select(*[F.when(bit(i), "all").otherwise(F.coalesce(F.col(s).cast("string"), F.lit("none"))).alias(s) for i, s in enumerate(segments)], *measures)


def windowed(events: DataFrame, window: str, measures: dict[str, Column], time: str = "ts") -> DataFrame:
    """Dashboard figures by tumbling window: window_start and the measures; for batches, or streams with a watermark."""
    rows = events.groupBy(F.window(time, window)).agg(*[m.alias(n) for n, m in measures.items()])
    return rows.select(F.col("window.start").alias("window_start"), *measures)


def concurrency(per_hour: Column, seconds: Column) -> Column:
    """Workers that a rate of items needs when each item takes so many seconds (Little's law)."""
    return F.ceil(per_hour / F.lit(60.0) * (seconds / F.lit(60.0)))


def reply_error(reply: Column, keys: list[str], choices: dict[str, list[str]]) -> Column:
    """First broken rule of a model's JSON reply: an object, exactly these keys, and values from the lists of choices."""
    value = F.try_parse_json(reply)
    names = F.array_sort(F.coalesce(F.json_object_keys(reply), F.array().cast("array<string>")))
    error = F.when(~F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), "not_an_object").when(names != F.array(*[F.lit(k) for k in sorted(keys)]), "wrong_keys")
    for key, allowed in choices.items():
        error = error.when(~F.coalesce(F.try_variant_get(value, f"$.{key}", "string").isin(allowed), F.lit(False)), f"unknown_{key}")
    return error
