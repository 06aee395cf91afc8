from pyspark.sql import functions as F

from corpuslens.operators import monitoring as O
from corpuslens.plans import store

TOKENS = "doc_id int, ord int, text string, confidence double, left int, top int, width int, height int"


def tokens(spark, pages):
    return spark.createDataFrame([(d, i, t, float(c), x, y, 10, 10) for d, words in pages.items() for i, (t, c, x, y) in enumerate(words)], TOKENS)


def test_triggers_and_runs(spark):
    low, high = [("ab", 10, 0, 0)], [("ab", 90, 20, 0)]
    frame = tokens(spark, {1: low * 5 + high * 20, 2: low * 4 + high + low * 4, 3: [(" ", 1, 0, 0)], 4: [("##@", 90, 0, 0), ("%%", 90, 0, 50)]})
    found = {r["doc_id"]: (r["triggers"], r["low_run"]) for r in O.fallback_triggers(frame).collect()}
    assert found == {1: (["low_run"], 5), 2: (["low_mean_confidence", "low_share"], 4), 3: (["blank"], 0), 4: (["symbols", "sparse"], 0)}
    runs = sorted(tuple(r) for r in O.low_confidence_runs(frame).filter("doc_id = 2").collect())
    assert runs == [(2, 1, 0, 3, 4), (2, 2, 5, 8, 4)]
    assert O.fallback_triggers(frame.limit(0)).count() == 0


def test_regions(spark):
    frame = tokens(spark, {1: [("a", 1, 0, 0), ("b", 1, 17, 0), ("c", 1, 90, 0), ("d", 99, 50, 0), ("e", 1, 0, 40)]})
    found = sorted(tuple(r) for r in O.merged_regions(frame, F.lit(95), F.lit(45)).collect())
    assert found == [(1, 0, 1, 0, 0, 31, 14, 2), (1, 0, 2, 86, 0, 95, 14, 1), (1, 40, 1, 0, 36, 14, 45, 1)]
    second = spark.createDataFrame([(1, 0, "A", True), (1, 1, "B", False), (1, 2, " ", True)], "doc_id int, ord int, text string, accepted boolean")
    read = {r["ord"]: (r["text"], r["baseline_text"], r["source"]) for r in O.merge_readings(frame, second).collect()}
    assert read[0] == ("A", "a", "second") and read[1] == ("b", "b", "baseline") and read[2] == ("c", "c", "baseline")


def test_scorecard(spark):
    rows = spark.createDataFrame([("x", 1.0, 0.9), ("y", 1.0, 0.9), ("z", 5.0, 0.1), ("n", None, None)], "name string, quality double, safety double")
    found = {r["name"]: (r["score"], r["passed"], r["rank"]) for r in O.scorecard(rows, {"quality": 3.0, "safety": 1.0}, {"safety": 0.5}).collect()}
    assert found["x"][1:] == (True, 1) and found["y"][1:] == (True, 2) and found["z"][1:] == (False, None) and found["n"] == (0.0, False, None)


def test_replies(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "x", "[1]", "{}", '{"a": "u", "b": 2}', '{"a": "w", "b": 1}', '{"a": "u", "b": 1, "c": 1}', '{"a": null, "b": 1}')], "t string")
    found = [r[0] for r in rows.select(O.reply_error(F.col("t"), ["a", "b"], {"a": ["u", "v"]})).collect()]
    assert found == ["not_an_object", "not_an_object", "not_an_object", "wrong_keys", None, "unknown_a", "wrong_keys", "unknown_a"]


def test_store(spark, tmp_path):
    schema = "doc_id int, delivered_at int, raw_text string, body_text string, sentences array<string>, low_confidence_regions array<string>, engine_name string, engine_version string"
    pages = spark.createDataFrame([(1, 1, "old", "old", ["old"], ["r"], "e", None), (1, 2, "new", "new", ["n", "m"], [], "e", "2"), (2, 1, "", "", [], ["r"], "e", None)], schema)
    store.write(store.normalised(pages.unionByName(pages)), str(tmp_path))
    read = lambda t: sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{t}").collect())
    assert read("documents") == [(1, 2), (2, 1)] and read("sentences") == [(1, 0, "n"), (1, 1, "m")] and read("confidence_regions") == [(2, 0, "r")]
    final = spark.createDataFrame([("d", 0, "Simple", 1), ("d", 0, "Complex", 2)], "batch_id string, input_index int, final_category string, delivered_at int")
    assert [r["final_category"] for r in store.classifications(final).collect()] == ["Complex"]
