r"""Quality rules: hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Features are the words and word pairs of a whole text, hashed into BUCKETS buckets by the CRC-32 of
a word and PAIR_FACTOR * (first word's CRC-32) + (second word's). Two
multinomials over the buckets, one from trusted documents and one from all documents, give each
bucket a log ratio; a document's score is the mean log ratio of its features. The threshold is the
trusted documents' mean score minus SPREAD standard deviations, rounded to six decimals, and
every document is compared with it. Only DataFrame expressions are used and no text is shuffled (but by that join):
bucket counts are partially aggregated (BUCKETS rows), and the log ratios travel as one literal
array of BUCKETS integers in the plan.

The trusted target, its mean and its deviation cover all documents labelled quality 1 and toxic 0. Their ids (8 bytes each)
are broadcast if there are at most MAX_TRUSTED, and joined by a shuffle beyond. The raw multinomial covers all documents.

Defined cases: a null text or one without words has no features, scores 0 and fails the base rule
(fewer than MIN_WORDS words); repeated rows are judged alike, each on its own row; without trusted
documents every score is 0 and the threshold is 0, so the base rule alone decides; an empty table
gives no rows; columns other than doc_id and text are passed over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tables import SPACE_CHARS, documents, table, words
from corpuslens.plans.scratch import Scratch

BUCKETS = 1 << 16
#: Log ratios are whole multiples of 1/UNITS, so that sums are exact whatever their order.
UNITS = 1_000
PAIR_FACTOR = 1_000_003
SMOOTHING = 1.0
#: Trusted ids up to this many are broadcast.
MAX_TRUSTED = 100_000
#: At most 1 in SPREAD**2 trusted documents can lie that far below the mean, whatever the distribution.
SPREAD = 5.0
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """Bind an array or struct once, so that lambdas don't evaluate it for every element."""
    return F.transform(F.array(value), body)[0]


def features(ws: Column) -> Column:
    """Hashes of all words, then of all pairs of neighbouring words; a hash modulo BUCKETS is its bucket."""
    singles = F.transform(ws, lambda w: F.crc32(w.cast("binary")))

    def with_pairs(h: Column) -> Column:
        n = F.greatest(F.size(h) - 1, F.lit(0))
        return F.concat(h, F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda x, y: x * PAIR_FACTOR + y))

    return let(singles, with_pairs)


def window_hash(*three: Column) -> Column:
    return F.xxhash64(*three)


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, each word once.

    Each window becomes one long: its hash shifted up by the bits that a position needs, and its
    position. Sorted as primitive longs, windows with equal hashes are neighbours, and the
    repeats' positions in order cover min(3, gap) words each. Neighbours with equal hashes have their
    words compared; a text in which they differ is counted by its words instead of hashes.
    """
    n = F.size(ws) - 2
    bits = F.length(F.bin(n.cast("long")))
    bound = F.struct(ws.alias("ws"), F.slice(ws, F.lit(1), n).alias("firsts"), bits.alias("bits"), (F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1).alias("mask"))

    def covered(t: Column) -> Column:
        window = lambda w, i: F.call_function("shiftleft", window_hash(w, F.get(t.ws, i + 1), F.get(t.ws, i + 2)), t.bits).bitwiseOR(i.cast("long"))
        low = lambda x: x.bitwiseAND(t.mask).cast("int")

        def repeats(k: Column) -> Column:
            m = F.size(k) - 1
            same = lambda x, y: F.when(F.call_function("shiftright", x.bitwiseXOR(y), t.bits) == 0, F.struct(x.alias("x"), y.alias("y")))
            return F.array_compact(F.zip_with(F.slice(k, F.lit(1), m), F.slice(k, F.lit(2), m), same))

        def differ(p: Column) -> Column:
            i, j = low(p.x), low(p.y)
            return (F.get(t.ws, i) != F.get(t.ws, j)) | (F.get(t.ws, i + 1) != F.get(t.ws, j + 1)) | (F.get(t.ws, i + 2) != F.get(t.ws, j + 2))

        def by_words() -> Column:
            """The pairs of neighbours among windows sorted by their words and positions."""
            spelt = F.sort_array(F.transform(t.firsts, lambda w, i: F.struct(F.struct(w.alias("a"), F.get(t.ws, i + 1).alias("b"), F.get(t.ws, i + 2).alias("c")).alias("w"), i.cast("long").alias("i"))))

            def repeats(k: Column) -> Column:
                m = F.size(k) - 1
                return F.array_compact(F.zip_with(F.slice(k, F.lit(1), m), F.slice(k, F.lit(2), m), lambda x, y: F.when(x.w == y.w, F.struct(x.i.alias("x"), y.i.alias("y")))))

            return let(spelt, repeats)

        def count(pairs: Column) -> Column:
            places = F.array_sort(F.array_distinct(F.concat(F.transform(pairs, lambda p: low(p.x)), F.transform(pairs, lambda p: low(p.y)))))
            start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc.n + F.least(F.lit(3), p - acc.last)).alias("n")), lambda acc: acc.n)

        checked = lambda pairs: F.when(F.exists(pairs, differ), by_words()).otherwise(pairs)
        return let(let(let(F.sort_array(F.transform(t.firsts, window)), repeats), checked), count)

    return F.when(F.size(ws) > 3, let(bound, covered)).otherwise(F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()


def log_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log P(bucket | trusted) - log P(bucket | raw) in units of 1/UNITS, by bucket; trusted: __id, marked for a broadcast if it is small."""
    ids = trusted.withColumn("__t", F.lit(1).cast("long"))
    counted = (
        docs.select("doc_id", "text")
        .join(ids, F.col("doc_id") == F.col("__id"), "left")
        .select(F.coalesce("__t", F.lit(0).cast("long")).alias("t"), F.explode(features_of(F.col("text"))).alias("hash"))
        .groupBy((F.col("hash") % BUCKETS).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target"))
    )
    # at most BUCKETS rows, as one string of numbers
    packed = counted.agg(F.array_join(F.flatten(F.collect_list(F.array("bucket", "raw", "target"))), " ")).first()[0]
    rows = np.array((packed or "").split(), np.int64).reshape(-1, 3)
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[rows[:, 0]], target[rows[:, 0]] = rows[:, 1], rows[:, 2]
    if not target.sum():
        return np.zeros(BUCKETS, np.int64)
    log = lambda n: np.log(n + SMOOTHING) - np.log(n.sum() + SMOOTHING * BUCKETS)
    return np.rint((log(target) - log(raw)) * UNITS).astype(np.int64)


def features_of(text: Column) -> Column:
    return let(words(text), features)


def mean_log_ratio(ws: Column, ratios: np.ndarray) -> Column:
    literal = F.from_json(F.lit("[" + ",".join(map(str, ratios.tolist())) + "]"), "array<int>")
    total = lambda fs: F.aggregate(fs, F.lit(0).cast("long"), lambda a, f: a + F.get(literal, (f % BUCKETS).cast("int")))
    found = let(features(ws), lambda fs: total(fs) / F.size(fs) / float(UNITS))
    return F.when(F.size(ws) > 0, found).otherwise(F.lit(0.0))


def judge(docs: DataFrame, labels: DataFrame, most: int = MAX_TRUSTED, spread: float = SPREAD) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, threshold, kept."""
    ids = Scratch(docs.sparkSession, "quality").save(trusted_ids(labels), "trusted")
    if ids.count() <= most:
        ids = F.broadcast(ids)
    ratios = log_ratios(docs, ids)
    scored = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id")).select(let(words(F.col("text")), lambda ws: mean_log_ratio(ws, ratios)).alias("s"))
    fit = scored.agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    threshold = round(fit["m"] - spread * fit["d"], 6) if fit["m"] is not None else 0.0
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.struct(words(F.col("text")).alias("ws"))
    measured = let(
        ws,
        lambda x: F.struct(
            F.size(x.ws).cast("long").alias("n_words"),
            F.length(F.array_join(x.ws, "")).cast("long").alias("word_chars"),
            repeated_words(x.ws).alias("n_repeat_words"),
            mean_log_ratio(x.ws, ratios).alias("score"),
        ),
    )
    out = docs.withColumn("__m", measured).withColumns(
        {
            "n_words": F.col("__m.n_words"),
            "word_chars": F.col("__m.word_chars"),
            "n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": duplicate_lines(F.col("text")),
            "n_repeat_words": F.col("__m.n_repeat_words"),
            "score": F.col("__m.score"),
            "threshold": F.lit(threshold),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).drop("__m")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))


#: The CRC-32 table comes from its generating rule (polynomial 0xEDB88320).
OP2_SQL = rf"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
tok AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM d),
u AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM tok)),
b AS (SELECT w, list_transform(range(0, len(x) // 2), lambda k: CAST('0x' || substr(x, CAST(2 * k + 1 AS INTEGER), 2) AS BIGINT)) AS bytes FROM u),
h AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: xor(c >> 8, tab[CAST((xor(c, y) & 255) + 1 AS INTEGER)])), 4294967295) AS h FROM b, crc),
s AS MATERIALIZED (SELECT doc_id, i, w, h, lead(h) OVER o AS h2, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM tok JOIN h USING (w) WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
f AS MATERIALIZED (SELECT doc_id, h % {BUCKETS} AS k FROM s UNION ALL SELECT doc_id, (h * {PAIR_FACTOR} + h2) % {BUCKETS} FROM s WHERE h2 IS NOT NULL),
good AS MATERIALIZED (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0),
n AS (SELECT k, count(*) AS raw, count(good.doc_id) AS target FROM f LEFT JOIN good USING (doc_id) GROUP BY k),
r AS MATERIALIZED (SELECT k, CASE WHEN (SELECT sum(target) FROM n) = 0 THEN 0 ELSE round({UNITS} * (ln(target + {SMOOTHING}) - ln((SELECT sum(target) FROM n) + {SMOOTHING * BUCKETS})
  - ln(raw + {SMOOTHING}) + ln((SELECT sum(raw) FROM n) + {SMOOTHING * BUCKETS}))) END AS ratio FROM n),
z AS MATERIALIZED (SELECT d.doc_id, coalesce(any_value(x.score), 0) AS score FROM d LEFT JOIN (SELECT doc_id, sum(ratio) / count(*) / {UNITS} AS score FROM f JOIN r USING (k) GROUP BY doc_id) x USING (doc_id) GROUP BY d.doc_id),
cut AS (SELECT coalesce(round(avg(score) - {SPREAD} * stddev_pop(score), 6), 0) AS threshold FROM z JOIN good USING (doc_id)),
tri AS MATERIALIZED (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS c FROM s WHERE w3 IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM tri, (VALUES (0), (1), (2)) v(k) WHERE c > 1 GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d) d LEFT JOIN rep USING (doc_id))
SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND score >= threshold AS kept, round(score, 6) AS score FROM base JOIN z USING (doc_id), cut
"""
