"""Mixing sources to target weights by iterative proportional fitting.

Every text is measured once (tokens and topic), and the measured rows are saved. Tokens are summed by (source, language,
topic) cell. Raking scales the cells in turn to the target marginals of source, language and topic, cycle after cycle,
until the largest relative error of a marginal is at most TOLERANCE or MAX_CYCLES have passed (targets that contradict each
other have no solution; the error left is returned by ``marginal_error``). A cell's weight is its raked tokens over its
own. Sampling probabilities are min(1, rate * weight), where the rate makes the expected tokens ``budget_share`` of all (all
cells that have a weight, if that is not enough). A document is kept if the hash of its id (52 bits of
an md5, as a number below 1) is below its cell's probability, so the sample is the same in every run.

A cell table of at most MAX_LOCAL_CELLS rows is raked as arrays on the driver and broadcast to the documents; beyond that,
raking and rate are grouped sums and the cells are joined with a shuffle, with the same result.

Targets are shares by value; a dimension without given targets takes its own marginal to the power
``temper`` (0 gives equal shares, 1 the shares as they are). Without a topic expression the topic is a rule-based
genre of the whole text.

Defined cases: nulls are values of their own; null and empty texts have no tokens and a cell without
tokens has weight 1; values that given targets don't name have share 0; a dimension whose named
values hold no tokens keeps its cells as they are; repeated rows share one fate; an empty table gives no
rows; input columns named like a result (n_tokens, topic, weight, probability, kept) are replaced by it, and other
extra columns are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.tables import documents, n_words, uniform
from corpuslens.plans.scratch import Scratch

DIMENSIONS = ("source", "lang", "topic")
MAX_CYCLES, TOLERANCE = 500, 1e-10
TEMPER = {"source": 0.5, "lang": 0.5, "topic": 0.7}
BUDGET_SHARE = 0.5
MAX_LOCAL_CELLS = 100_000
SEED = "mix-1"
#: Cycles between two looks at the error of a distributed cell table.
_CYCLES_PER_JOB = 4


def genre(text: Column, tokens: Column) -> Column:
    """Topic of a text by its form: empty, numeric, markup, lines or prose."""
    t = F.coalesce(text, F.lit(""))
    digits = F.length(F.regexp_replace(t, "[^0-9]+", ""))
    symbols = F.length(F.regexp_replace(t, "[^#*$%&|<>]+", ""))
    lines = F.regexp_count(t, F.lit("\n"))
    return (
        F.when(tokens == 0, "empty")
        .when(digits * 10 > F.length(t), "numeric")
        .when(symbols * 20 > F.length(t), "markup")
        .when(lines * 15 > tokens, "lines")
        .otherwise("prose")
    )


# -- cell tables of any size -----------------------------------------------------------------


def _with_targets(cells: DataFrame, dimension: str, given: dict[str, float] | None, temper: float) -> DataFrame:
    """cells with t_<dimension>: target tokens of the cell's value, null if the dimension has no tokens to scale."""
    by_value = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("__tokens"))
    if given is not None:
        share = F.lit(0.0)
        for value, s in given.items():
            share = F.when(F.col(dimension) == value, float(s)).otherwise(share)
    else:
        share = F.pow("__tokens", F.lit(temper))
    shares = by_value.select(F.col(dimension).alias("__value"), "__tokens", F.when(F.col("__tokens") > 0, share).otherwise(0.0).alias("__share"))
    norm, total = shares.agg(F.sum("__share"), F.sum("__tokens")).first()
    target = F.col("__share") * (total / norm) if norm else F.lit(None).cast("double")
    shares = shares.select("__value", target.alias(f"t_{dimension}"))
    return cells.join(shares, F.col(dimension).eqNullSafe(F.col("__value"))).drop("__value")


def marginal_error(cells: DataFrame) -> float:
    """Largest |raked - target| / target over the values of all dimensions; cells: DIMENSIONS, x and t_ columns."""
    worst = 0.0
    for d in DIMENSIONS:
        sums = cells.groupBy(d).agg(F.sum("x").alias("x"), F.first(f"t_{d}").alias("t"))
        worst = max(worst, sums.filter("t > 0 AND x > 0").agg(F.max(F.abs(F.col("x") - F.col("t")) / F.col("t"))).first()[0] or 0.0)
    return worst


def _rake_distributed(cells: DataFrame, scratch: Scratch) -> DataFrame:
    now = cells
    for done in range(1, MAX_CYCLES + 1):
        for d in DIMENSIONS:
            here = F.sum("x").over(Window.partitionBy(d))
            now = now.withColumn("x", F.when((here > 0) & F.col(f"t_{d}").isNotNull(), F.col("x") * F.col(f"t_{d}") / here).otherwise(F.col("x")))
        if done % _CYCLES_PER_JOB == 0:
            now = scratch.save(now, "cells")
            if marginal_error(now) <= TOLERANCE:
                break
    return now


def _rate_distributed(cells: DataFrame, budget_share: float) -> float:
    """Newton steps on a sum that is concave and piecewise linear in the rate: they end after finitely many."""
    weighted = cells.filter("tokens > 0 AND weight > 0")
    budget = budget_share * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    rate = 0.0
    while True:
        below = F.col("weight") * F.lit(rate) < 1.0
        flat, slope = weighted.agg(F.sum(F.when(~below, F.col("tokens")).otherwise(0)), F.sum(F.when(below, F.col("tokens") * F.col("weight")).otherwise(0.0))).first()
        if not slope:
            return rate
        nearer = (budget - float(flat)) / slope
        if nearer <= rate * (1 + 1e-15):
            return rate
        rate = nearer


# -- cell tables on the driver ---------------------------------------------------------------


def _rake_local(x: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """x: tokens of the cells; places: number of a cell's value in each dimension; targets: tokens by value, NaN for none."""
    for _ in range(MAX_CYCLES):
        for at, target in zip(places, targets, strict=True):
            sums = np.bincount(at, weights=x, minlength=len(target))
            scale = np.divide(target, sums, out=np.ones(len(target)), where=(sums > 0) & ~np.isnan(target))
            x = x * scale[at]
        if _error_local(x, places, targets) <= TOLERANCE:
            break
    return x


def _error_local(x: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray]) -> float:
    worst = 0.0
    for at, target in zip(places, targets, strict=True):
        sums = np.bincount(at, weights=x, minlength=len(target))
        real = (target > 0) & (sums > 0)
        worst = max(worst, float((np.abs(sums[real] - target[real]) / target[real]).max(initial=0.0)))
    return worst


def _rate_local(tokens: np.ndarray, weight: np.ndarray, budget_share: float) -> float:
    some = (tokens > 0) & (weight > 0)
    budget, t, w = budget_share * tokens.sum(), tokens[some], weight[some]
    rate = 0.0
    while True:
        below = w * rate < 1.0
        slope = (t * w)[below].sum()
        if not slope:
            return rate
        nearer = (budget - t[~below].sum()) / slope
        if nearer <= rate * (1 + 1e-15):
            return float(rate)
        rate = nearer


# -- mixing ----------------------------------------------------------------------------------


def cell_probabilities(cells: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE) -> tuple[DataFrame, bool, float]:
    """cells (source, lang, topic, tokens) with weight and probability; whether they are few; the marginal error left."""
    targets, temper = targets or {}, TEMPER | (temper or {})
    prepared = cells
    for d in DIMENSIONS:
        prepared = _with_targets(prepared, d, targets.get(d), temper[d])
    prepared = scratch.save(prepared.withColumn("x", F.col("tokens").cast("double")), "cells")
    few = prepared.count() <= MAX_LOCAL_CELLS
    weight = F.when(F.col("tokens") > 0, F.col("x") / F.col("tokens")).otherwise(1.0)
    if few:
        held = prepared.orderBy(*DIMENSIONS).toArrow()
        places, goals = [], []
        for d in DIMENSIONS:
            at = held.column(d).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            goal = np.full(int(at.max(initial=-1)) + 1, np.nan)
            goal[at] = held.column(f"t_{d}").to_numpy()
            places.append(at)
            goals.append(goal)
        tokens = held.column("tokens").to_numpy().astype(np.float64)
        x = _rake_local(tokens, places, goals) if len(tokens) else tokens
        weights = np.divide(x, tokens, out=np.ones(len(x)), where=tokens > 0)
        rate = _rate_local(tokens, weights, budget_share)
        table = held.select([*DIMENSIONS, "tokens"]).append_column("weight", pa.array(weights)).append_column("probability", pa.array(np.minimum(1.0, rate * weights)))
        return cells.sparkSession.createDataFrame(table), True, _error_local(x, places, goals)
    raked = scratch.save(_rake_distributed(prepared, scratch), "raked")
    weighed = scratch.save(raked.select(*DIMENSIONS, "tokens", weight.alias("weight")), "weights")
    rate = _rate_distributed(weighed, budget_share)
    return weighed.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(rate))), False, marginal_error(raked)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] | None = None, budget_share: float = BUDGET_SHARE, seed: str = SEED, topic: Column | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs with n_tokens, topic, weight, probability and kept.

    carry: the columns of docs to return beside doc_id, source and lang (None: all); leaving out the text saves its copy.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    made = ("n_tokens", "topic", "weight", "probability", "kept")
    kept = [c for c in docs.columns if c not in made and (carry is None or c in ("doc_id", "source", "lang", *carry))]
    measured = docs.select(*[F.col(c) for c in kept], n_words(F.col("text")).alias("n_tokens"), (F.lit(None) if topic is None else topic).alias("topic"), *([] if "text" in kept else ["text"]))
    if topic is None:
        measured = measured.withColumn("topic", genre(F.col("text"), F.col("n_tokens")))
    measured = scratch.save(measured.select(*kept, "n_tokens", "topic"), "measured")
    cells = scratch.save(measured.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "sums")
    side, few, _ = cell_probabilities(cells, scratch, targets, temper, budget_share)
    side = side.select(*[F.col(c).alias(f"__{c}") for c in DIMENSIONS], "weight", "probability")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in DIMENSIONS]
    out = measured.join(F.broadcast(side) if few else side, same[0] & same[1] & same[2]).drop(*[f"__{c}" for c in DIMENSIONS])
    return out.withColumn("kept", uniform(F.col("doc_id"), seed) < F.col("probability"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"), carry=[])
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


#: Steps of the SQL version, which has no test of convergence; more than enough for the given tables.
_SQL_CYCLES, _SQL_ROUNDS = 100, 200
OP6_SQL = rf"""
WITH RECURSIVE
d AS MATERIALIZED (
  SELECT doc_id, source, lang, coalesce(text, '') AS t,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
g AS MATERIALIZED (
  SELECT doc_id, source, lang, n_tokens,
    CASE WHEN n_tokens = 0 THEN 'empty'
      WHEN length(regexp_replace(t, '[^0-9]+', '', 'g')) * 10 > length(t) THEN 'numeric'
      WHEN length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) * 20 > length(t) THEN 'markup'
      WHEN (length(t) - length(replace(t, chr(10), ''))) * 15 > n_tokens THEN 'lines' ELSE 'prose' END AS topic FROM d),
c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM g GROUP BY ALL),
s AS MATERIALIZED (SELECT source, pow(sum(tokens), {TEMPER["source"]}) AS p, sum(tokens) AS n FROM c GROUP BY 1),
l AS MATERIALIZED (SELECT lang, pow(sum(tokens), {TEMPER["lang"]}) AS p, sum(tokens) AS n FROM c GROUP BY 1),
o AS MATERIALIZED (SELECT topic, pow(sum(tokens), {TEMPER["topic"]}) AS p, sum(tokens) AS n FROM c GROUP BY 1),
z AS MATERIALIZED (SELECT c.*, s.p * (SELECT sum(tokens) FROM c) / (SELECT sum(p) FROM s WHERE n > 0) AS ts,
    l.p * (SELECT sum(tokens) FROM c) / (SELECT sum(p) FROM l WHERE n > 0) AS tl, o.p * (SELECT sum(tokens) FROM c) / (SELECT sum(p) FROM o WHERE n > 0) AS tt
  FROM c JOIN s ON s.source IS NOT DISTINCT FROM c.source JOIN l ON l.lang IS NOT DISTINCT FROM c.lang JOIN o ON o.topic IS NOT DISTINCT FROM c.topic),
r AS (
  SELECT 0 AS k, source, lang, topic, tokens, ts, tl, tt, tokens AS x FROM z
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, ts, tl, tt, CASE WHEN n3 > 0 THEN x * tt / n3 ELSE x END FROM (
    SELECT *, sum(x) OVER (PARTITION BY topic) AS n3 FROM (
      SELECT * REPLACE (CASE WHEN n2 > 0 THEN x * tl / n2 ELSE x END AS x) FROM (
        SELECT *, sum(x) OVER (PARTITION BY lang) AS n2 FROM (
          SELECT * REPLACE (CASE WHEN n1 > 0 THEN x * ts / n1 ELSE x END AS x) FROM (
            SELECT *, sum(x) OVER (PARTITION BY source) AS n1 FROM r WHERE k < {_SQL_CYCLES})))))),
w AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN x / tokens ELSE 1 END AS weight FROM r WHERE k = {_SQL_CYCLES}),
q AS (
  SELECT 0 AS k, CAST({BUDGET_SHARE} AS DOUBLE) AS rate
  UNION ALL
  SELECT k + 1, rate * {BUDGET_SHARE} * (SELECT sum(tokens) FROM w) / (SELECT sum(tokens * least(1, weight * rate)) FROM w) FROM q WHERE k < {_SQL_ROUNDS})
SELECT doc_id, g.source, g.lang, g.topic, n_tokens, round(weight, 6) AS weight, round(least(1, weight * rate), 6) AS probability,
  CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{SEED}'), 1, 13) AS BIGINT) / pow(16, 13) < least(1, weight * rate) AS kept
FROM g JOIN w ON w.source IS NOT DISTINCT FROM g.source AND w.lang IS NOT DISTINCT FROM g.lang AND w.topic IS NOT DISTINCT FROM g.topic
CROSS JOIN (SELECT rate FROM q WHERE k = {_SQL_ROUNDS})
"""
