"""Optimal length buckets and token-budget batches.

The global histogram of lengths is one partially aggregated group-by with a row for every length that occurs. Texts of D
different lengths have D (D - 1) / 2 tokens or more, so T tokens in all give at most sqrt(2 T) + 1 rows (about six million for
100 TB of text, 16 bytes each on the driver). Dynamic programming over all lengths finds the bucket boundaries with the least
total padding: the best cost up to a length is a minimum of lines in that length, kept as a convex hull, so the time
is proportional to buckets times lengths. Inside a bucket, rows are numbered
without gaps in the order of md5(id), id, and each run of ``budget // width`` rows is a batch.

Defined cases: null and empty texts have 0 tokens and go to the narrowest bucket; a text longer
than the budget is a batch of its own, never cut; equal ids are numbered in any order; an empty
table gives no rows; fewer distinct lengths than buckets give one bucket per length. Ties in the dynamic
program take the smallest boundary index. Input columns other than id and text aren't read.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tables import documents, n_words
from corpuslens.plans.numbering import number_within
from corpuslens.plans.scratch import Scratch

N_BUCKETS = 8
TOKEN_BUDGET = 65_536


def optimal_buckets(counts: list[int], lengths: list[int], n_buckets: int) -> list[int]:
    """Indices of the last length of each bucket, minimising sum(bucket width - length) over all rows; lengths ascend."""
    h = len(counts)
    rows, tokens = [0], [0]
    for n, length in zip(counts, lengths, strict=True):
        rows.append(rows[-1] + n)
        tokens.append(tokens[-1] + n * length)
    # a bucket of lengths i .. j-1 pads (rows[j] - rows[i]) * lengths[j-1] - (tokens[j] - tokens[i]):
    # for given i a line in the width, with slope -rows[i] and height best[i] + tokens[i]
    best: list[int | None] = [0] + [None] * h
    choices = []
    for _ in range(min(n_buckets, h)):
        hull: deque[tuple[int, int, int]] = deque()  # (slope, height, i) in the order in which they become least
        after: list[int | None] = [None] * (h + 1)
        choice = [0] * (h + 1)
        for j in range(1, h + 1):
            if best[j - 1] is not None:
                line = (-rows[j - 1], best[j - 1] + tokens[j - 1], j - 1)
                while len(hull) > 1 and _never_least(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            width = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * width + hull[1][1] < hull[0][0] * width + hull[0][1]:
                hull.popleft()
            if hull:
                slope, height, choice[j] = hull[0]
                after[j] = slope * width + height + rows[j] * width - tokens[j]
        best = after
        choices.append(choice)
    ends, j = [], h
    for choice in reversed(choices):
        ends.append(j - 1)
        j = choice[j]
    return ends[::-1]


def _never_least(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Line b is nowhere below both a and c; slopes fall from a to c."""
    return (c[1] - a[1]) * (a[0] - b[0]) <= (b[1] - a[1]) * (a[0] - c[0])


def pack(df: DataFrame, id_column: str = "doc_id", length: Column | None = None, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET) -> DataFrame:
    """(id, n_tokens, bucket, bucket_width, batch, slot, padding) for every row."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    lengths = scratch.save(df.select(F.col(id_column), (n_words(F.col("text")) if length is None else length).cast("long").alias("n_tokens")), "lengths")
    histogram = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("n_tokens")
    counts, widths = histogram.column("n").to_pylist(), histogram.column("n_tokens").to_pylist()
    ends = [widths[i] for i in optimal_buckets(counts, widths, n_buckets)]
    bucket, width = F.lit(None).cast("int"), F.lit(None).cast("long")
    for b in reversed(range(len(ends))):
        inside = F.col("n_tokens") <= ends[b]
        bucket, width = F.when(inside, b).otherwise(bucket), F.when(inside, F.lit(ends[b])).otherwise(width)
    placed = lengths.withColumn("bucket", bucket).withColumn("bucket_width", width.cast("long"))
    numbered = number_within(placed, "bucket", id_column, "__at", sum(counts))
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_width"), F.lit(1))))
    return numbered.select(
        id_column,
        "n_tokens",
        "bucket",
        "bucket_width",
        F.floor(F.col("__at") / per_batch).cast("long").alias("batch"),
        (F.col("__at") % per_batch).cast("long").alias("slot"),
        (F.col("bucket_width") - F.col("n_tokens")).alias("padding"),
    )


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


OP10_SQL = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens AS width, count(*) AS n FROM w GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY width) AS j, width, CAST(sum(n) OVER (ORDER BY width) AS BIGINT) AS cn, CAST(sum(n * width) OVER (ORDER BY width) AS BIGINT) AS ct FROM h),
z AS MATERIALIZED (SELECT j, cn, ct FROM c UNION ALL SELECT 0, 0, 0),
pad AS MATERIALIZED (SELECT z.j AS i, c.j AS j, (c.cn - z.cn) * c.width - (c.ct - z.ct) AS p FROM z JOIN c ON z.j < c.j),
dp AS (
  SELECT 0 AS k, CAST(0 AS BIGINT) AS j, CAST(0 AS HUGEINT) AS m
  UNION ALL
  SELECT dp.k + 1, pad.j, min(CAST(dp.m // 1000000 + pad.p AS HUGEINT) * 1000000 + pad.i)
  FROM dp JOIN pad ON dp.j = pad.i WHERE dp.k < (SELECT least({N_BUCKETS}, count(*)) FROM c) GROUP BY dp.k, pad.j),
back AS (
  SELECT k, j, m FROM dp WHERE k = (SELECT least({N_BUCKETS}, count(*)) FROM c) AND j = (SELECT max(j) FROM c)
  UNION ALL
  SELECT dp.k, dp.j, dp.m FROM back JOIN dp ON dp.k = back.k - 1 AND dp.j = back.m % 1000000 WHERE dp.k > 0),
ends AS (SELECT CAST(back.k - 1 AS INTEGER) AS bucket, c.width AS bucket_width, coalesce(lag(c.width) OVER (ORDER BY back.k), -1) AS below FROM back JOIN c ON c.j = back.j),
p AS (SELECT doc_id, n_tokens, bucket, bucket_width, row_number() OVER (PARTITION BY bucket ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos,
        greatest(1, {TOKEN_BUDGET} // greatest(bucket_width, 1)) AS per FROM w JOIN ends ON n_tokens > below AND n_tokens <= bucket_width)
SELECT doc_id, n_tokens, bucket, bucket_width, CAST(pos // per AS BIGINT) AS batch, CAST(pos % per AS BIGINT) AS slot, bucket_width - n_tokens AS padding FROM p
"""
