"""Validated JSON sources, read as whole files and checked as VARIANT values so that no type is coerced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from corpuslens.errors import EvaluationInputError, ProfileInputError

SAMPLE_FIELDS = ["sample_id", "ground_truth", "predicted"]


def _parsed(spark: SparkSession, path: str, error: type[Exception]) -> DataFrame:
    try:
        texts = spark.read.text(path, wholetext=True)
        parsed = texts.select("value", F.try_parse_json("value").alias("v"))
        bad = parsed.filter("v IS NULL AND (value IS NULL OR trim(value) <> 'null')").limit(1).collect()
    except AnalysisException as x:
        raise error(f"could not read {path}") from x
    if bad:
        import json

        try:
            json.loads(bad[0]["value"] or "")
        except json.JSONDecodeError as x:
            raise error(f"Malformed JSON at line {x.lineno}, column {x.colno}") from x
        raise error("Malformed JSON")
    return parsed


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _is_string(v: Column) -> Column:
    return F.coalesce(_kind(v) == "STRING", F.lit(False))


def _raise_first(rows: DataFrame, error: type[Exception]) -> None:
    bad = rows.filter("problem IS NOT NULL").orderBy("pos").select("pos", "problem").limit(1).collect()
    if bad:
        raise error(f"entry {bad[0]['pos']}: {bad[0]['problem']}")


def _elements(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "item"))


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    """sample_id, ground_truth, predicted of a JSON list; other keys are ignored, every rule is checked."""
    parsed = _parsed(spark, path, EvaluationInputError)
    shape = parsed.select(_kind(F.col("v")).alias("k"), F.size(F.try_variant_get("v", "$", "array<variant>")).alias("n")).first()
    if not shape or not shape["k"].startswith("ARRAY"):
        raise EvaluationInputError("evaluation JSON must be a list")
    if shape["n"] == 0:
        raise EvaluationInputError("evaluation JSON is empty")
    items = _elements(parsed)
    field = lambda f: F.try_variant_get("item", f"$.{f}", "variant")
    names = F.json_object_keys(F.to_json("item"))
    problem = F.when(~_kind(F.col("item")).startswith("OBJECT"), "not an object")
    for f in SAMPLE_FIELDS:
        problem = problem.when(~F.coalesce(F.array_contains(names, f), F.lit(False)), f"missing required field {f}")
    for f in SAMPLE_FIELDS:
        problem = problem.when(~_is_string(field(f)), f"{f} must be a string")
    rows = items.withColumn("problem", problem)
    _raise_first(rows, EvaluationInputError)
    out = items.select("pos", *[F.variant_get("item", f"$.{f}", "string").alias(f) for f in SAMPLE_FIELDS])
    _raise_first(out.withColumn("problem", F.when(F.col("sample_id") == "", "empty sample_id")), EvaluationInputError)
    if not duplicates(out, "sample_id").isEmpty():
        raise EvaluationInputError("duplicate sample_id")
    return out.drop("pos")


def stem(identifier: Column) -> Column:
    """Last path part without its last suffix; a leading dot is no suffix."""
    name = F.regexp_extract(F.regexp_replace(identifier, "/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def duplicates(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def load_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """page, ground_truth of a map {page: text or {ground_truth}} or a list of {sample_id or page, ground_truth}."""
    parsed = _parsed(spark, path, ProfileInputError)
    kind = parsed.select(_kind(F.col("v")).alias("k")).first()["k"]
    if kind.startswith("OBJECT"):
        entries = parsed.select(F.posexplode(F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))).alias("pos", "e"))
        nested = F.try_variant_get("e.value", "$.ground_truth", "variant")
        entries = entries.select("pos", F.col("e.key").alias("id"), F.col("e.key").isNotNull().alias("id_ok"), F.when(_kind(F.col("e.value")).startswith("OBJECT"), nested).otherwise(F.col("e.value")).alias("text"))
    elif kind.startswith("ARRAY"):
        items = _elements(parsed)
        names = F.json_object_keys(F.to_json("item"))
        key = F.when(F.array_contains(names, "sample_id"), F.try_variant_get("item", "$.sample_id", "variant")).otherwise(F.try_variant_get("item", "$.page", "variant"))
        _raise_first(items.withColumn("problem", F.when(~_kind(F.col("item")).startswith("OBJECT"), "not an object")), ProfileInputError)
        entries = items.select("pos", F.try_variant_get(key, "$", "string").alias("id"), _is_string(key).alias("id_ok"), F.try_variant_get("item", "$.ground_truth", "variant").alias("text"))
    else:
        raise ProfileInputError("ground-truth JSON must be an object or a list of objects")
    problem = F.when(~F.col("id_ok") | F.coalesce(F.col("id") == "", F.lit(True)), "requires sample_id or page").when(~_is_string(F.col("text")), "requires string ground_truth")
    _raise_first(entries.withColumn("problem", problem), ProfileInputError)
    out = entries.select(stem(F.col("id")).alias("page"), F.variant_get("text", "$", "string").alias("ground_truth"))
    if not duplicates(out, "page").isEmpty():
        raise ProfileInputError("duplicate ground truth for a page")
    return out
