"""Sentence classification around pluggable clients: batch calls, matching, recovery, routing, contracts.

Clients are picklable factories called once per task; their ``classify_batch``, ``classify_one`` and
``analyze`` return dicts (or lists of dicts). Everything else is joins and expressions. A stage that calls a
client is written to the shared folder before it is used twice, so that a client is not called again
when an executor is lost after the stage.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.errors import InvalidSentenceError, ModelValidationError, RateLimitError, ResponseContractError
from corpuslens.plans.scratch import Scratch

#: Fixed values of the classification contract.
COMPLEXITY = {"Simple": 1, "Compound": 2, "Complex": 3, "Compound-Complex": 4}
INCOMPLETE = "Incomplete"
CATEGORIES = [*COMPLEXITY, INCOMPLETE]
STATUSES = ["single", "multiple", "none", "incomplete_only", "invalid_category"]
AGENTS = ["classifier", "embedded_sentence"]
OUTCOMES = {"none": " Outcome: No complete embedded sentence was found.", "incomplete_only": " Outcome: Only incomplete nested content was found."}
SPANS = "array<struct<text: string, is_complete: boolean, category: string>>"
RESPONSES = "batch_id string, pos int, sentence string, category string, reason string"
EMBEDDED = f"batch_id string, input_index int, input_sentence string, status string, embedded_spans {SPANS}, embedded_reason string"


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts (the first included) and growing waits between them."""

    max_attempts: int = 3
    initial_delay: float = 0.25
    multiplier: float = 2.0
    max_delay: float = 2.0

    def __post_init__(self):
        whole = type(self.max_attempts) is int
        if not whole or self.max_attempts <= 0:
            raise ModelValidationError(f"a policy needs one attempt or more, as a whole number, not {self.max_attempts!r}")
        for field, low in {"initial_delay": 0, "max_delay": 0, "multiplier": 1}.items():
            seconds = getattr(self, field)
            real = type(seconds) in (int, float) and math.isfinite(seconds)
            if not real or seconds < low:
                raise ModelValidationError(f"{field}: expected a finite number from {low} up, got {seconds!r}")

    def delays(self) -> list[float]:
        """Waits after each failed attempt but the last."""
        return [min(self.initial_delay * self.multiplier**k, self.max_delay) for k in range(self.max_attempts - 1)]

    def call(self, operation: Callable, sleep: Callable[[float], None] = time.sleep):
        """Call and retry on RateLimitError alone; every call starts from the first delay."""
        for wait in [*self.delays(), None]:
            try:
                return operation()
            except RateLimitError:
                if wait is None:
                    raise
                sleep(wait)


def backoff_schedule(policies: DataFrame) -> DataFrame:
    """One row per wait of each policy: columns max_attempts, initial_delay, multiplier, max_delay -> attempt, delay."""
    waits = F.when(F.col("max_attempts") > 1, F.sequence(F.lit(1), F.col("max_attempts") - 1)).otherwise(F.array().cast("array<int>"))
    rows = policies.withColumn("attempt", F.explode(waits))
    return rows.withColumn("delay", F.least(F.col("initial_delay") * F.pow("multiplier", F.col("attempt") - 1), F.col("max_delay")))


def require_sentences(sentences) -> list[str]:
    """A list of non-empty strings (blank ones are allowed), or an error before any client is called."""
    if isinstance(sentences, (str, bytes)) or not isinstance(sentences, (list, tuple)):
        raise ModelValidationError("sentences must be a list or tuple of strings")
    for s in sentences:
        if not isinstance(s, str) or not s:
            raise InvalidSentenceError("every sentence must be a non-empty string")
    return list(sentences)


# -- matching responses to inputs ------------------------------------------------------------


def occurrences(rows: DataFrame, order: str) -> DataFrame:
    """rows with ``occ``: 1, 2, ... over equal sentences of a batch."""
    return rows.withColumn("occ", F.row_number().over(Window.partitionBy("batch_id", "sentence").orderBy(order)))


def match_responses(inputs: DataFrame, responses: DataFrame) -> DataFrame:
    """The k-th response of a sentence goes to its k-th input; batch_id, input_index, sentence, category, reason."""
    left = occurrences(inputs.select("batch_id", "input_index", "sentence"), "input_index")
    right = occurrences(responses.select("batch_id", "pos", "sentence", "category", "reason"), "pos")
    return left.join(right, ["batch_id", "sentence", "occ"]).select("batch_id", "input_index", "sentence", "category", "reason")


def surplus_responses(inputs: DataFrame, responses: DataFrame) -> DataFrame:
    """Responses without an input: unknown, altered or one too many."""
    return occurrences(responses, "pos").join(occurrences(inputs, "input_index"), ["batch_id", "sentence", "occ"], "left_anti")


def missing_inputs(inputs: DataFrame, responses: DataFrame) -> DataFrame:
    """Inputs without a response."""
    return occurrences(inputs, "input_index").join(occurrences(responses, "pos"), ["batch_id", "sentence", "occ"], "left_anti").drop("occ")


# -- contracts -------------------------------------------------------------------------------


def _blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(True))


def response_error(category: Column, reason: Column) -> Column:
    return F.when(category.isNull() | ~category.isin(CATEGORIES), "unknown_category").when(_blank(reason), "blank_reason")


def span_error(spans: Column) -> Column:
    """First broken span rule: text, category of a complete span, no category of an incomplete one."""
    complete_ok = lambda s: F.coalesce(s.category.isin(list(COMPLEXITY)), F.lit(False))
    return (
        F.when(F.exists(spans, lambda s: _blank(s.text)), "blank_span")
        .when(F.exists(spans, lambda s: s.is_complete & ~complete_ok(s)), "complete_without_category")
        .when(F.exists(spans, lambda s: ~s.is_complete & s.category.isNotNull()), "incomplete_with_category")
    )


def status_error(status: Column, spans: Column) -> Column:
    n, complete = F.size(spans), F.size(F.filter(spans, lambda s: s.is_complete))
    right = (
        F.when(status.isin("none", "invalid_category"), n == 0)
        .when(status == "single", (n == 1) & (complete == 1))
        .when(status == "multiple", (n >= 2) & (complete >= 1))
        .when(status == "incomplete_only", (n >= 1) & (complete == 0))
    )
    return F.when(status.isNull() | ~status.isin(STATUSES), "unknown_status").when(~right, "status_contradicts_spans")


def spans_in_order(sentence: Column, spans: Column) -> Column:
    """Every span occurs in the sentence at or after the end of the one before."""

    def step(at: Column, s: Column) -> Column:
        found = F.call_function("locate", s.text, sentence, F.greatest(at, F.lit(1)))
        return F.when((at == 0) | (found == 0), 0).otherwise(found + F.length(s.text))

    return F.aggregate(spans, F.lit(1), step) > 0


def select_span(spans: Column) -> Column:
    """Complete span of the greatest complexity, the first of equals; null without one."""
    order = F.create_map(*[F.lit(x) for kv in COMPLEXITY.items() for x in kv])
    ranked = F.transform(spans, lambda s, i: F.when(s.is_complete, F.struct(F.element_at(order, s.category).alias("c"), (-i).alias("i"), s.alias("s"))))
    best = F.array_max(F.transform(F.array_compact(ranked), lambda r: F.struct(r.c.alias("c"), r.i.alias("i"), r.s.text.alias("text"), r.s.category.alias("category"))))
    return F.when(best.isNotNull(), F.struct(best.text.alias("text"), best.category.alias("category")))


def embedded_error(sentence: Column) -> Column:
    """First broken rule of an embedded response, with the columns of EMBEDDED at hand."""
    spans = F.col("embedded_spans")
    return (
        F.when(F.col("status").isNull(), "no_response")
        .when(~F.coalesce(F.col("input_sentence") == sentence, F.lit(False)), "altered_input")
        .when(F.col("status") == "invalid_category", "invalid_category")
        .otherwise(F.coalesce(status_error(F.col("status"), spans), span_error(spans), F.when(~spans_in_order(sentence, spans), "spans_out_of_order"), F.when(_blank(F.col("embedded_reason")), "blank_reason")))
    )


def finalise(primary: DataFrame, embedded: DataFrame) -> DataFrame:
    """Final records with an ``error`` column; Incomplete sentences take the embedded agent's outcome."""
    e = embedded.select("batch_id", "input_index", "input_sentence", "status", "embedded_spans", "embedded_reason")
    rows = primary.join(e, ["batch_id", "input_index"], "left")
    routed = F.col("category") == INCOMPLETE
    span = select_span(F.col("embedded_spans"))
    promoted = routed & F.col("status").isin("single", "multiple")
    note = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv]), F.col("status")), F.lit(""))
    reason = F.when(routed, F.concat(F.lit("Classifier: "), "reason", F.lit(" Embedded agent: "), F.coalesce("embedded_reason", F.lit("")), note)).otherwise(F.col("reason"))
    error = F.coalesce(response_error(F.col("category"), F.col("reason")), F.when(routed, embedded_error(F.col("sentence"))))
    return rows.select(
        "batch_id",
        "input_index",
        F.col("sentence").alias("original_sentence"),
        F.when(promoted, span.category).otherwise(F.col("category")).alias("final_category"),
        F.col("category").alias("original_classifier_category"),
        reason.alias("reason"),
        F.when(promoted, span.text).alias("embedded_sentence"),
        F.when(routed, F.array(*[F.lit(a) for a in AGENTS])).otherwise(F.array(F.lit(AGENTS[0]))).alias("agent_path"),
        error.alias("error"),
    )


def final_error(rows: DataFrame) -> DataFrame:
    """rows with ``record_error``: domain, reason, substring and agent rules of a final record."""
    bad = (
        F.when(~F.col("final_category").isin(CATEGORIES) | ~F.col("original_classifier_category").isin(CATEGORIES), "unknown_category")
        .when(_blank(F.col("reason")), "blank_reason")
        .when(F.col("embedded_sentence").isNotNull() & ~F.col("original_sentence").contains(F.col("embedded_sentence")), "span_not_in_sentence")
        .when((F.size("agent_path") == 0) | (F.size(F.array_except("agent_path", F.array(*[F.lit(a) for a in AGENTS]))) > 0), "unknown_agent")
    )
    return rows.withColumn("record_error", bad)


# -- pipeline --------------------------------------------------------------------------------


class RuleClient:
    """Deterministic stand-in for a model: categories from conjunctions and end marks. Rows are dicts."""

    def classify_one(self, sentence: str) -> dict:
        words = [w.strip(".,;!?").lower() for w in sentence.split()]
        joined, dependent = any(w in ("and", "but", "or", "so") for w in words), any(w in ("because", "when", "which", "that", "if") for w in words)
        if len(words) < 3:
            category = INCOMPLETE
        else:
            category = "Compound-Complex" if joined and dependent else "Complex" if dependent else "Compound" if joined else "Simple"
        return {"sentence": sentence, "category": category, "reason": f"{len(words)} words"}

    def classify_batch(self, sentences: list[str]) -> list[dict]:
        return [self.classify_one(s) for s in sentences]

    def analyze(self, sentence: str) -> dict:
        return {"input_sentence": sentence, "status": "none", "embedded_spans": [], "reason": "too short"}


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.strip().split(" ")[0].rstrip(":") for c in _fields(schema)])


def _fields(schema: str) -> list[str]:
    depth, start, out = 0, 0, []
    for i, ch in enumerate(schema):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def classify(
    inputs: DataFrame, client: Callable[[], object] = RuleClient, policy: RetryPolicy | None = None, sleep: Callable[[float], None] = time.sleep, strict: bool = True
) -> DataFrame:
    """Final classifications of inputs (batch_id string, input_index int, sentence string).

    One batch call per batch, one call per missing input and per Incomplete sentence. strict: contract
    violations raise; otherwise they are codes in ``error``, and surplus responses are left out.
    """
    policy = policy or RetryPolicy()
    scratch = Scratch(inputs.sparkSession, "classify")
    inputs = scratch.save(inputs.select(F.col("batch_id").cast("string").alias("batch_id"), F.col("input_index").cast("int").alias("input_index"), "sentence"), "inputs")
    if not inputs.filter("sentence IS NULL OR sentence = ''").isEmpty():
        raise InvalidSentenceError("every sentence must be a non-empty string")

    def batch(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("input_index", kind="stable")
        agent = client()
        found = policy.call(lambda: agent.classify_batch(group["sentence"].tolist()), sleep)
        if not isinstance(found, (list, tuple)) or not all(isinstance(r, dict) for r in found):
            raise ModelValidationError("classify_batch must return a list of records")
        return _frame([(group["batch_id"].iloc[0], i, r["sentence"], r["category"], r["reason"]) for i, r in enumerate(found)], RESPONSES)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent = client()
        for rows in batches:
            found = []
            for b, i, s in rows[["batch_id", "input_index", "sentence"]].itertuples(index=False):
                r = policy.call(lambda s=s: agent.classify_one(s), sleep)
                if r["sentence"] != s:
                    raise ResponseContractError("classify_one altered its sentence")
                found.append((b, i, r["sentence"], r["category"], r["reason"]))
            yield pd.DataFrame(found, columns=["batch_id", "input_index", "sentence", "category", "reason"])

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        agent = client()
        for rows in batches:
            found = []
            for b, i, s in rows[["batch_id", "input_index", "sentence"]].itertuples(index=False):
                r = policy.call(lambda s=s: agent.analyze(s), sleep)
                found.append((b, i, r["input_sentence"], r["status"], r["embedded_spans"], r["reason"]))
            yield _frame(found, EMBEDDED)

    responses = scratch.save(inputs.groupBy("batch_id").applyInPandas(batch, RESPONSES), "responses")
    if strict and not surplus_responses(inputs, responses).isEmpty():
        raise ResponseContractError("a response has no matching input")
    recovered = missing_inputs(inputs, responses).mapInPandas(one, "batch_id string, input_index int, sentence string, category string, reason string")
    primary = scratch.save(match_responses(inputs, responses).unionByName(recovered), "primary")
    analysed = scratch.save(primary.filter(F.col("category") == INCOMPLETE).mapInPandas(embedded, EMBEDDED), "embedded")
    out = final_error(finalise(primary, analysed))
    out = scratch.save(out.withColumn("error", F.coalesce("error", "record_error")).drop("record_error"), "final")
    if strict:
        bad = out.filter("error IS NOT NULL").select("error").limit(1).collect()
        if bad:
            raise ResponseContractError(bad[0]["error"])
        out = out.drop("error")
    return out.orderBy("batch_id", "input_index")


def recovery_outcome(final: DataFrame) -> DataFrame:
    """final with ``recovery``: not_routed, recovered, or unresolved."""
    routed = F.size("agent_path") > 1
    return final.withColumn("recovery", F.when(~routed, "not_routed").when(F.col("embedded_sentence").isNotNull(), "recovered").otherwise("unresolved"))


def recovery_evaluation(final: DataFrame, gold: DataFrame) -> DataFrame:
    """batch_id, input_index and outcome of every routed sentence against its gold category (batch_id, input_index, gold).

    promoted_right: promoted to the gold category; promoted_wrong: to another, or though the gold one is Incomplete;
    stayed_right: not promoted, and Incomplete is right; missed: not promoted, though a complete sentence was there.
    """
    routed = final.filter(F.size("agent_path") > 1).join(gold.select("batch_id", "input_index", "gold"), ["batch_id", "input_index"])
    promoted = F.col("embedded_sentence").isNotNull()
    outcome = (
        F.when(promoted & (F.col("final_category") == F.col("gold")), "promoted_right")
        .when(promoted, "promoted_wrong")
        .when(F.col("gold") == INCOMPLETE, "stayed_right")
        .otherwise("missed")
    )
    return routed.select("batch_id", "input_index", outcome.alias("outcome"))


def disagreements(old: DataFrame, new: DataFrame) -> DataFrame:
    """Inputs that two classifier versions put into different categories."""
    right = new.select("batch_id", "input_index", F.col("final_category").alias("new_category"))
    both = old.select("batch_id", "input_index", F.col("final_category").alias("old_category")).join(right, ["batch_id", "input_index"])
    return both.filter(~F.col("old_category").eqNullSafe(F.col("new_category")))
