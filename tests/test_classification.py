import sys

import pytest
from pyspark import cloudpickle

from corpuslens.errors import InvalidSentenceError, ModelValidationError, RateLimitError, ResponseContractError
from corpuslens.operators import classification as C

cloudpickle.register_pickle_by_value(sys.modules[__name__])

INPUTS = "batch_id string, input_index int, sentence string"


def inputs(spark, sentences):
    return spark.createDataFrame([("b", i, s) for i, s in enumerate(sentences)], INPUTS)


class Scripted(C.RuleClient):
    def __init__(self, batch=None, embedded=None):
        self.batch, self.embedded = batch, embedded or {}

    def classify_batch(self, sentences):
        if self.batch is None:
            return super().classify_batch(sentences)
        return [{"sentence": s, "category": c, "reason": "r"} for s, c in self.batch]

    def analyze(self, sentence):
        return {"input_sentence": sentence, "reason": "e", **self.embedded.get(sentence, {"status": "none", "embedded_spans": []})}


def run(spark, sentences, **script):
    rows = C.classify(inputs(spark, sentences), lambda: Scripted(**script)).collect()
    return [(r["original_sentence"], r["final_category"], r["embedded_sentence"], r["agent_path"]) for r in rows]


def test_responses_in_any_order_with_duplicates_and_missing(spark):
    found = run(spark, ["one two three", "x y z", "one two three", "a b c"], batch=[("a b c", "Complex"), ("one two three", "Simple"), ("x y z", "Compound")])
    assert [f[1] for f in found] == ["Simple", "Compound", "Simple", "Complex"]


@pytest.mark.parametrize("stray", ["unknown", "x y z ", "x y z"])
def test_stray_responses(spark, stray):
    with pytest.raises(ResponseContractError):
        run(spark, ["x y z"], batch=[("x y z", "Simple"), (stray, "Simple")])


def span(text, category):
    return {"text": text, "is_complete": category is not None, "category": category}


def test_routes(spark):
    s = "becaus I go Home and"
    found = run(spark, [s], batch=[(s, "Incomplete")], embedded={s: {"status": "single", "embedded_spans": [span("I go Home", "Simple")]}})
    assert found == [(s, "Simple", "I go Home", ["classifier", "embedded_sentence"])]
    m = {s: {"status": "multiple", "embedded_spans": [span("becaus", None), span("I go", "Complex"), span("Home", "Complex")]}}
    assert run(spark, [s], batch=[(s, "Incomplete")], embedded=m)[0][1:3] == ("Complex", "I go")
    o = {s: {"status": "incomplete_only", "embedded_spans": [span("becaus", None)]}}
    assert run(spark, [s], batch=[(s, "Incomplete")], embedded=o)[0][1:3] == ("Incomplete", None)


@pytest.mark.parametrize(
    "answer",
    [
        {"status": "invalid_category", "embedded_spans": []},
        {"status": "single", "embedded_spans": []},
        {"status": "none", "embedded_spans": [span("b", "Simple")]},
        {"status": "single", "embedded_spans": [span("zzz", "Simple")]},
        {"status": "multiple", "embedded_spans": [span("b c", "Simple"), span("a", "Simple")]},
        {"status": "single", "embedded_spans": [span("a", "Incomplete")]},
        {"status": "single", "embedded_spans": [span("a", "Simple")], "input_sentence": "other"},
        {"status": "odd", "embedded_spans": []},
    ],
)
def test_embedded_contract(spark, answer):
    with pytest.raises(ResponseContractError):
        run(spark, ["a b c"], batch=[("a b c", "Incomplete")], embedded={"a b c": answer})
    rows = C.classify(inputs(spark, ["a b c"]), lambda: Scripted([("a b c", "Incomplete")], {"a b c": answer}), strict=False).collect()
    assert rows[0]["error"]


def test_input_checks(spark):
    with pytest.raises(InvalidSentenceError):
        C.classify(inputs(spark, ["ok", ""]))
    assert C.require_sentences([" "]) == [" "]
    for bad in ("text", b"x", 5):
        with pytest.raises(ModelValidationError):
            C.require_sentences(bad)
    with pytest.raises(InvalidSentenceError):
        C.require_sentences(["a", 1])
    assert C.classify(inputs(spark, [])).count() == 0


def test_retry():
    waits, calls = [], []

    def fails(n, error=RateLimitError):
        def operation():
            calls.append(1)
            if len(calls) <= n:
                raise error("x")
            return "done"

        return operation

    assert C.RetryPolicy(max_attempts=4).call(fails(3), waits.append) == "done" and waits == [0.25, 0.5, 1.0]
    calls.clear(), waits.clear()
    assert C.RetryPolicy(4, 0.75, 2.0, 1.0).delays() == [0.75, 1.0, 1.0]
    with pytest.raises(RateLimitError):
        C.RetryPolicy().call(fails(9), waits.append)
    assert len(calls) == 3 and waits == [0.25, 0.5]
    calls.clear()
    with pytest.raises(KeyError):
        C.RetryPolicy().call(fails(9, KeyError), waits.append)
    assert len(calls) == 1
    for bad in (dict(max_attempts=0), dict(max_attempts=True), dict(initial_delay=float("nan")), dict(multiplier=0.5), dict(max_delay=True)):
        with pytest.raises(ModelValidationError):
            C.RetryPolicy(**bad)


def test_final_record_rules(spark):
    rows = spark.createDataFrame([("abc", "Simple", "Simple", "r", "b", ["classifier"]), ("abc", "Simple", "Simple", "r", "z", ["classifier"]), ("abc", "Odd", "Simple", "r", None, ["classifier"]), ("abc", "Simple", "Simple", " ", None, ["classifier"]), ("abc", "Simple", "Simple", "r", None, ["x"])],
        "original_sentence string, final_category string, original_classifier_category string, reason string, embedded_sentence string, agent_path array<string>")
    assert [r["record_error"] for r in C.final_error(rows).collect()] == [None, "span_not_in_sentence", "unknown_category", "blank_reason", "unknown_agent"]


def test_disagreements(spark):
    schema = "batch_id string, input_index int, final_category string"
    old, new = spark.createDataFrame([("b", 0, "Simple"), ("b", 1, "Simple")], schema), spark.createDataFrame([("b", 0, "Simple"), ("b", 1, "Complex")], schema)
    assert [r["input_index"] for r in C.disagreements(old, new).collect()] == [1]


def test_recovery_against_gold(spark):
    final = spark.createDataFrame([("b", i, c, e, ["classifier", "embedded_sentence"][:n]) for i, (c, e, n) in enumerate([("Simple", "x", 2), ("Simple", "x", 2), ("Simple", "x", 2), ("Incomplete", None, 2), ("Incomplete", None, 2), ("Simple", None, 1)])],
        "batch_id string, input_index int, final_category string, embedded_sentence string, agent_path array<string>")
    gold = spark.createDataFrame([("b", i, g) for i, g in enumerate(["Simple", "Complex", "Incomplete", "Incomplete", "Simple", "Simple"])], "batch_id string, input_index int, gold string")
    found = {r["input_index"]: r["outcome"] for r in C.recovery_evaluation(final, gold).collect()}
    assert found == {0: "promoted_right", 1: "promoted_wrong", 2: "promoted_wrong", 3: "stayed_right", 4: "missed"}
