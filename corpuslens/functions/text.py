r"""Text expressions: whitespace, tokens, sentences, edit distances and sensitive tokens.

Whitespace is Unicode white space plus U+001C to U+001F. All functions map columns to columns
and stay in the JVM, but for edit distances and case folding, which run in Arrow batches (functions.distance).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.distance import casefold, distance, subsequence

#: Fixed value: the whitespace class that Python's str.split and str.strip use.
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U){NOT_WS}")


def tokens(text: Column) -> Column:
    """Whitespace tokens, without empty ones."""
    return F.filter(F.split(text, rf"(?U){WS}+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? followed by whitespace, stripped, without empty ones."""
    parts = F.split(text, rf"(?U)(?<=[.!?]){WS}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def bind(value: Column, body) -> Column:
    """Evaluate an expression once and use it as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def sequence_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token arrays."""
    return distance(a, b)


def character_error_rate(truth: Column, predicted: Column) -> Column:
    """Edit distance over the length of the truth; the distance itself for an empty truth."""
    return distance(truth, predicted).cast("double") / F.greatest(F.length(truth), F.lit(1))


def word_error_rate(truth: Column, predicted: Column) -> Column:
    """Word edit distance over the words of the truth; the distance itself if it has none."""
    return distance(tokens(truth), tokens(predicted)).cast("double") / F.greatest(F.size(tokens(truth)), F.lit(1))


def subsequence_ratio(truth: Column, predicted: Column) -> Column:
    """Twice the longest common subsequence of code points over both lengths; 1 for two empty texts."""
    both = F.length(truth) + F.length(predicted)
    return F.when(both == 0, 1.0).otherwise(subsequence(truth, predicted) * 2.0 / both)


def sentence_overlap(truth: Column, predicted: Column) -> Column:
    """Share of the truth's distinct case-folded tokens that the prediction has too."""
    folded = lambda s: F.array_distinct(tokens(casefold(s)))
    return bind(
        F.struct(folded(truth).alias("t"), folded(predicted).alias("p")),
        lambda x: F.when(F.size(x.t) == 0, F.when(F.size(x.p) == 0, 1.0).otherwise(0.0)).otherwise(F.size(F.array_intersect(x.t, x.p)) / F.size(x.t)),
    )


def composite_score(cer: Column, wer: Column, f1: Column) -> Column:
    """0.35 character accuracy, 0.35 word accuracy and 0.30 sentence F1, clamped to 0..1."""
    accuracy = lambda rate: F.greatest(F.lit(0.0), F.lit(1.0) - rate)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), accuracy(cer) * 0.35 + accuracy(wer) * 0.35 + f1 * 0.30))


def is_sensitive(token: Column, repeat: int = 2, explicit: list[str] | None = None) -> Column:
    """Tokens whose exact form matters: anything but plain lower-case ASCII, long character runs, or listed tokens.

    ``repeat``: repetitions after the first character that make a run.
    """
    if isinstance(repeat, bool) or not isinstance(repeat, int) or repeat < 1:
        raise ValueError("repeat must be an integer of at least 1")
    found = ~token.rlike("^[a-z]+$") | token.rlike(rf"(?s)(.)\1{{{repeat}}}")
    return found | token.isin(explicit) if explicit else found


def source_fidelity(truth: Column, predicted: Column, repeat: int = 2, explicit: list[str] | None = None) -> Column:
    """Sensitive tokens of the truth kept exactly by the best alignment, as a share; 1 without any.

    The alignment has the least edit distance and, among those, the most sensitive tokens kept. One
    scalar per cell holds both: distance * K - kept, with K above any count. Rows of the table are
    folds over the predicted tokens, so time grows with the product of the token counts and a
    further factor for array copies: use operators.metrics.source_fidelity_arrow for long texts.
    """

    def aligned(x: Column) -> Column:
        k = F.size(x.g).cast("long") + 1
        first = F.transform(F.concat(F.array(F.lit("")), x.p), lambda _, j: j.cast("long") * k)

        def next_row(row: Column, cell: Column) -> Column:
            """row: scores before this token; cell: its index, text and flag."""
            start = F.array(F.element_at(row, 1) + k)

            def step(done: Column, j: Column) -> Column:
                equal = F.get(x.p, j) == cell.t
                diagonal = F.get(row, j) + F.when(equal, F.when(cell.s, F.lit(-1).cast("long")).otherwise(F.lit(0).cast("long"))).otherwise(k)
                return F.concat(done, F.array(F.least(diagonal, F.get(row, j + 1) + k, F.element_at(done, -1) + k)))

            columns = F.when(F.size(x.p) > 0, F.sequence(F.lit(0), F.size(x.p) - 1)).otherwise(F.array().cast("array<int>"))
            return F.aggregate(columns, start, step)

        cells = F.transform(x.g, lambda t: F.struct(t.alias("t"), is_sensitive(t, repeat, explicit).alias("s")))
        score = F.element_at(F.aggregate(cells, first, next_row), -1)
        distance = F.ceil(score / k)
        return distance * k - score

    def share(x: Column) -> Column:
        sensitive = F.size(F.filter(x.g, lambda t: is_sensitive(t, repeat, explicit)))
        return F.when(sensitive == 0, 1.0).otherwise(aligned(x) / sensitive)

    return bind(F.struct(tokens(truth).alias("g"), tokens(predicted).alias("p")), share)
