"""Transcription quality: error rates, sentence matching, composite and macro means."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from corpuslens.errors import EvaluationError
from corpuslens.functions import text as T

OVERLAP = 0.5
METRICS = ["cer", "wer", "sentence_precision", "sentence_recall", "sentence_f1", "composite_score"]


def maximum_matching(edges: list[list[int]]) -> int:
    """Size of a maximum matching; edges[i] are the partners of left node i (shortest augmenting paths, iterative)."""
    partner: dict[int, int] = {}
    size = 0
    for root in range(len(edges)):
        parent: dict[int, int] = {}
        queue = [root]
        free = None
        while queue and free is None:
            nearer = []
            for u in queue:
                for v in edges[u]:
                    if v in parent:
                        continue
                    parent[v] = u
                    if v not in partner:
                        free = v
                        break
                    nearer.append(partner[v])
                if free is not None:
                    break
            queue = nearer
        if free is not None:
            owned = {u: v for v, u in partner.items()}
            while free is not None:
                u = parent[free]
                previous = owned.get(u)
                partner[free] = u
                free = previous if u != root else None
            size += 1
    return size


def eligible_pairs(truth: list[str], predicted: list[str], least_overlap: float = OVERLAP) -> list[list[int]]:
    """For each predicted sentence, the truth sentences of which it has ``least_overlap`` of the distinct case-folded tokens.

    Shared tokens are counted through an index of the truth's tokens, not pair by pair; sentences without tokens match each other.
    """
    wanted = [set(s.casefold().split()) for s in truth]
    holders: dict[str, list[int]] = {}
    for i, words in enumerate(wanted):
        for w in words:
            holders.setdefault(w, []).append(i)
    empty = [i for i, words in enumerate(wanted) if not words]
    out = []
    for s in predicted:
        words = set(s.casefold().split())
        shared = Counter(i for w in words for i in holders.get(w, ()))
        found = [i for i, n in shared.items() if n / len(wanted[i]) >= least_overlap]
        out.append(sorted(found if words else found + empty))
    return out


@F.arrow_udf(IntegerType())
def _matched(truth: pa.Array, predicted: pa.Array) -> pa.Array:
    rows = zip(truth.to_pylist(), predicted.to_pylist(), strict=True)
    return pa.array([None if g is None or p is None else maximum_matching(eligible_pairs(g, p)) for g, p in rows], pa.int32())


def evaluate(samples: DataFrame, truth: str = "ground_truth", predicted: str = "predicted") -> DataFrame:
    """Per-sample metrics; samples keep their other columns. Null texts count as empty."""
    g, p = F.coalesce(F.col(truth), F.lit("")), F.coalesce(F.col(predicted), F.lit(""))
    out = samples.withColumns({"__g": T.sentences(g), "__p": T.sentences(p)})
    out = out.withColumns({"cer": T.character_error_rate(g, p), "wer": T.word_error_rate(g, p), "matched_sentences": _matched("__g", "__p")})
    out = out.withColumns({"__g": F.size("__g"), "__p": F.size("__p")})
    both_empty = (F.col("__g") == 0) & (F.col("__p") == 0)
    ratio = lambda n: F.when(both_empty, 1.0).otherwise(F.col("matched_sentences") / F.greatest(F.col(n), F.lit(1)))
    out = out.withColumns({"sentence_precision": ratio("__p"), "sentence_recall": ratio("__g")})
    pr = F.col("sentence_precision") + F.col("sentence_recall")
    out = out.withColumn("sentence_f1", F.when(pr == 0, 0.0).otherwise(2 * F.col("sentence_precision") * F.col("sentence_recall") / pr))
    return out.withColumn("composite_score", T.composite_score(F.col("cer"), F.col("wer"), F.col("sentence_f1"))).drop("__g", "__p")


def macro_average(results: DataFrame) -> DataFrame:
    """Unweighted means over the samples, with their number."""
    return results.agg(F.count(F.lit(1)).alias("sample_count"), *[F.avg(m).alias(m) for m in METRICS])


def require_samples(aggregate: DataFrame) -> DataFrame:
    """Raise if an aggregate covers no sample."""
    if not aggregate.first()["sample_count"]:
        raise EvaluationError("no samples to aggregate")
    return aggregate


def _kept_sensitive(g: list[str], p: list[str], flags: list[bool]) -> int:
    k = len(g) + 1
    code = {w: i for i, w in enumerate(dict.fromkeys(p))}
    pc = np.array([code[w] for w in p], np.int64)
    across = np.arange(len(p) + 1, dtype=np.int64) * k
    row = across.copy()
    for w, s in zip(g, flags, strict=True):
        equal = pc == code.get(w, -1)
        best = np.empty_like(row)
        best[0] = row[0] + k
        best[1:] = np.minimum(row[:-1] + np.where(equal, -int(s), k), row[1:] + k)
        # insertions along the row: best[j] = min over i <= j of best[i] + (j - i) k
        row = np.minimum.accumulate(best - across) + across
    score = int(row[-1])
    return -(-score // k) * k - score


@F.arrow_udf(IntegerType())
def _kept_udf(g: pa.Array, p: pa.Array, flags: pa.Array) -> pa.Array:
    rows = zip(g.to_pylist(), p.to_pylist(), flags.to_pylist(), strict=True)
    return pa.array([None if a is None or b is None else _kept_sensitive(a, b, s) for a, b, s in rows], pa.int32())


def source_fidelity_arrow(samples: DataFrame, truth: str = "ground_truth", predicted: str = "predicted", repeat: int = 2, explicit: list[str] | None = None) -> DataFrame:
    """samples with ``sfs``, its alignment vectorised by rows; for texts of any length."""
    g, p = T.tokens(F.coalesce(F.col(truth), F.lit(""))), T.tokens(F.coalesce(F.col(predicted), F.lit("")))
    flagged = samples.withColumns({"__g": g, "__p": p}).withColumn("__s", F.transform("__g", lambda t: T.is_sensitive(t, repeat, explicit)))
    sensitive = F.size(F.filter("__s", lambda s: s))
    return flagged.withColumn("sfs", F.when(sensitive == 0, 1.0).otherwise(_kept_udf("__g", "__p", "__s") / sensitive)).drop("__g", "__p", "__s")


def silent_normalization_rate(sfs: Column, has_sensitive: Column) -> Column:
    """Share of sensitive tokens that were changed; null where there are none."""
    return F.when(has_sensitive, F.lit(1.0) - sfs)


def confusion_matrix(rows: DataFrame, gold: str, predicted: str, labels: list[str]) -> DataFrame:
    """One row per gold label, one count column per predicted label."""
    return rows.groupBy(gold).pivot(predicted, labels).count().na.fill(0)


def precision_recall(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per label: support, predicted, correct, precision and recall."""
    labelled = rows.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))).alias("x"), (F.col(gold) == F.col(predicted)).alias("ok"))
    counts = labelled.groupBy(F.col("x.label").alias("label")).agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.when(F.col("ok") & (F.col("x.g") == 1), 1).otherwise(0)).alias("correct"))
    return counts.withColumns({"precision": F.try_divide("correct", "predicted"), "recall": F.try_divide("correct", "support")})


def format_report(results: list, aggregate) -> str:
    """Fixed-width table of collected results with a final macro row."""
    heads = ["sample_id", "CER", "WER", "Sent P", "Sent R", "Sent F1", "Composite"]
    body = [[str(r["sample_id"]), *(f"{r[m]:.4f}" for m in METRICS)] for r in results]
    body.append([f"MACRO ({aggregate['sample_count']})", *(f"{aggregate[m]:.4f}" for m in METRICS)])
    table = pd.DataFrame([heads, *body])
    widths = table.map(len).max().tolist()
    line = lambda cells: " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True))
    return "\n".join([line(heads), "-+-".join("-" * w for w in widths), *map(line, body)])
