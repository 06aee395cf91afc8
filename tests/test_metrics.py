import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuslens.errors import EvaluationError
from corpuslens.functions import distance as D
from corpuslens.functions import text as T
from corpuslens.operators import metrics as M

PAIRS = [
    ("One sentence. Another one!", "One sentence. Another one!", dict(cer=0, wer=0, sentence_f1=1, composite_score=1)),
    ("cat", "cut", dict(cer=1 / 3)),
    ("one two", "one bright two", dict(wer=0.5)),
    ("one two three", "one three", dict(wer=1 / 3)),
    ("red blue green yellow", "RED blue", dict(matched_sentences=1, sentence_precision=1, sentence_recall=1)),
    ("alpha beta. alpha gamma.", "alpha beta gamma.", dict(matched_sentences=1, sentence_precision=1, sentence_recall=0.5, sentence_f1=2 / 3)),
    ("", "two words", dict(cer=9, wer=2, sentence_precision=0, composite_score=0)),
    ("two words", "", dict(cer=1, wer=1, sentence_f1=0, composite_score=0)),
    ("", "", dict(cer=0, wer=0, sentence_f1=1, composite_score=1)),
    (" ", "x", dict(cer=1, wer=1)),
    ("straße weg", "STRASSE WEG", dict(matched_sentences=1)),
]


def test_evaluate(spark):
    rows = spark.createDataFrame([(i, g, p) for i, (g, p, _) in enumerate(PAIRS)], "sample_id int, ground_truth string, predicted string")
    found = {r["sample_id"]: r for r in M.evaluate(rows).collect()}
    for i, (_, _, wanted) in enumerate(PAIRS):
        for k, v in wanted.items():
            assert found[i][k] == pytest.approx(v), (PAIRS[i], k)


def test_macro_average_and_report(spark):
    rows = spark.createDataFrame([("a", "hello.", "hello."), ("b", "hello.", "")], "sample_id string, ground_truth string, predicted string")
    result = M.evaluate(rows)
    macro = M.macro_average(result).first()
    assert macro["sample_count"] == 2 and all(macro[m] == pytest.approx(0.5) for m in M.METRICS)
    lines = M.format_report(result.orderBy("sample_id").collect(), macro).split("\n")
    assert lines[0].startswith("sample_id | CER") and lines[-1].startswith("MACRO (2) | 0.5000") and set(lines[1]) == {"-", "+"}
    with pytest.raises(EvaluationError):
        M.require_samples(M.macro_average(result.limit(0)))


SFS = [
    ("Error!!! iPhone", "Error!!! iPhone", 1), ("Wait!!!", "Wait!", 0), ("iPhone works", "iphone works", 0), ("WOW WOW", "WOW", 0.5),
    ("plain text", "plain text WOW", 1), ("hello??? world", "world", 0), ("plain lowercase words", "different words", 1), ("", "extra", 1),
    ("café", "café", 1), ("café", "cafe", 0), ("AB12", "AB13", 0), ("soooo", "so", 0), ("hello!!! world", "extra hello!!! world", 1),
    ("WOW plain", "plain WOW", 1), ("chlid", "child", 1), ("The cat", "A cat", 0), ("Please wait!!!", "Please wait!", 0.5),
]


def test_source_fidelity_both_forms(spark):
    rows = spark.createDataFrame([(g, p, float(e)) for g, p, e in SFS], "ground_truth string, predicted string, wanted double")
    both = M.source_fidelity_arrow(rows).withColumn("native", T.source_fidelity(F.col("ground_truth"), F.col("predicted")))
    for r in both.collect():
        assert r["sfs"] == r["native"] == r["wanted"], r


def test_sensitive_options(spark):
    row = spark.sql("SELECT 'soo' AS t")
    assert row.select(T.is_sensitive(F.col("t"))).first()[0] is False
    assert row.select(T.is_sensitive(F.col("t"), repeat=1)).first()[0] is True
    assert row.select(T.is_sensitive(F.col("t"), explicit=["soo"])).first()[0] is True
    for bad in (0, True, 1.0):
        with pytest.raises(ValueError):
            T.is_sensitive(F.col("t"), repeat=bad)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(row, i, x, b):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j - 1] + (x != y), row[j] + 1, out[-1] + 1))
    return out


def test_word_distance_against_brute_force(spark):
    rng = random.Random(3)
    pairs = [([rng.choice("ab cd ef gh".split()) for _ in range(rng.randrange(9))], [rng.choice("ab cd ef xy".split()) for _ in range(rng.randrange(9))]) for _ in range(60)]
    rows = spark.createDataFrame([(a, b, brute_distance(a, b)) for a, b in pairs], "a array<string>, b array<string>, d int")
    assert rows.filter(T.sequence_distance(F.col("a"), F.col("b")) != F.col("d")).count() == 0


def brute_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcé\U0001f600", max_size=70), st.text("abcé\U0001f600", max_size=70))
def test_distances_against_brute_force(a, b):
    assert D.edit_distance(a, b) == brute_distance(a, b) and D.edit_distance(list(a), list(b)) == brute_distance(a, b)
    assert D.common_subsequence(a, b) == brute_subsequence(a, b)


def test_distances_of_long_texts_and_many_tokens(spark):
    words = [f"w{i}" for i in range(60_000)]
    other = ["new", *words[1:40_000], *words[40_001:], "end"]
    assert D.edit_distance(words, other) == 3 and D.common_subsequence(words, other) == 59_998
    row = spark.createDataFrame([(" ".join(words), " ".join(other))], "g string, p string")
    assert row.select(T.word_error_rate(F.col("g"), F.col("p"))).first()[0] == 3 / 60_000
    nulls = spark.sql("SELECT CAST(NULL AS STRING) AS g, 'x' AS p UNION ALL SELECT '', 'x'")
    assert sorted((r[0] is None, r[1]) for r in nulls.select(D.distance(F.col("g"), F.col("p")), T.subsequence_ratio(F.coalesce("g", F.lit("")), F.col("p"))).collect()) == [(False, 0.0), (True, 0.0)]


def test_casefold_is_pythons(spark):
    texts = ["ß ẞ ﬃ ς Σ µ", "Ꭰꭰ ᾳ ᾼ ŉ ǰ և İ", None, ""]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.casefold(F.col("t"))).collect()] == [t and t.casefold() for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=5, unique=True), max_size=6))
def test_matching_size(edges):
    def best(i, used):
        return 0 if i == len(edges) else max([best(i + 1, used), *(1 + best(i + 1, used | {v}) for v in edges[i] if v not in used)])

    assert M.maximum_matching(edges) == best(0, frozenset())


def test_kept_sensitive_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        g, p = [rng.choice("AbC") for _ in range(rng.randrange(6))], [rng.choice("AbC") for _ in range(rng.randrange(6))]
        flags = [w.isupper() for w in g]
        table = {(0, j): (j, 0) for j in range(len(p) + 1)} | {(i, 0): (i, 0) for i in range(len(g) + 1)}
        for i in range(1, len(g) + 1):
            for j in range(1, len(p) + 1):
                same = g[i - 1] == p[j - 1]
                d, k = table[i - 1, j - 1]
                table[i, j] = min((d + (not same), k - (same and flags[i - 1])), (table[i - 1, j][0] + 1, table[i - 1, j][1]), (table[i, j - 1][0] + 1, table[i, j - 1][1]))
        assert M._kept_sensitive(g, p, flags) == -table[len(g), len(p)][1]


def test_confusion_and_rates(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "gold string, predicted string")
    found = {r["label"]: (r["support"], r["predicted"], r["correct"], r["precision"], r["recall"]) for r in M.precision_recall(rows, "gold", "predicted").collect()}
    assert found == {"a": (2, 1, 1, 1.0, 0.5), "b": (2, 3, 2, pytest.approx(2 / 3), 1.0)}
    assert {tuple(r) for r in M.confusion_matrix(rows, "gold", "predicted", ["a", "b"]).collect()} == {("a", 1, 1), ("b", 0, 2)}
