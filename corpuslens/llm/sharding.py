"""K-d tree sharding: recursive weighted-median splits along the widest metadata dimension.

All steps are DataFrame expressions. The text is read once, for its size and checksum; from then on a narrow table (id, size,
place on each axis, shard so far) is read, and written anew at each level, so plans stay short however deep the tree is.
Metadata values become integers in [0, 2**30); a split key is
that integer followed by 32 hash bits of the id, so that ties (a source holding a third of all
rows, say) can be cut anywhere. A weighted quantile is found by histograms, for all nodes of a level at once: bytes are summed
per (node, bin) with partial aggregation, the bin that holds the quantile is split into BINS finer
bins, and so on until that bin weighs at most TOLERANCE of a shard. The driver sees one row per
node and pass, at most as many as there are shards; nodes go back as a relation, broadcast if they are at most
MAX_BROADCAST_NODES.

Defined cases: a null text has no bytes and weighs only its overhead; null metadata count as the
empty string or 0; rows with equal ids and metadata stay together; an empty table gives no rows; when there
are fewer rows than shards some shards stay empty. Other input columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.tables import documents
from corpuslens.plans.numbering import number_within
from corpuslens.plans.scratch import Scratch

BINS = 4096
TOLERANCE = 0.0005
OVERHEAD_BYTES = 8
MAX_BROADCAST_NODES = 100_000
_SCALE = 2**30 - 1


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def category(column: Column) -> Column:
    """Categories take a fixed place on the axis: the CRC-32 of their name."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")).cast("double")


def default_dimensions() -> dict[str, Column]:
    return {
        "source": category(F.col("source")),
        "lang": category(F.col("lang")),
        "length": F.log2(F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0)) + F.lit(1.0)),
        "id": F.coalesce(F.col("doc_id"), F.lit(0)).cast("double"),
    }


def _relation(spark, schema: str, rows: list[dict]) -> DataFrame:
    """One row per tree node, from a single literal; marked for a broadcast if it is small."""
    made = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
    return F.broadcast(made) if len(rows) <= MAX_BROADCAST_NODES else made


def _split_key(n_dimensions: int) -> Column:
    chosen = F.element_at(F.array(*[F.col(f"__d{i}") for i in range(n_dimensions)]), F.col("__dim") + 1)
    return chosen * F.lit(2**32) + F.col("__tie")


def _descend(spark, rows: DataFrame, nodes: list[dict], n_dimensions: int) -> DataFrame:
    """Move the rows right of their node's threshold to the node's right child."""
    splits = _relation(spark, "__node int, __dim int, __cut bigint, __left int", [{"__node": n["shard"], "__dim": n["dim"], "__cut": n["cut"], "__left": n["left"]} for n in nodes])
    moved = rows.join(splits, F.col("shard") == F.col("__node"), "left")
    right = F.col("__cut").isNotNull() & (_split_key(n_dimensions) >= F.col("__cut"))
    return moved.withColumn("shard", F.when(right, F.col("shard") + F.col("__left")).otherwise(F.col("shard"))).select(*rows.columns)


def _find_cuts(spark, rows: DataFrame, nodes: list[dict], n_dimensions: int, shard_bytes: float) -> None:
    """Refine each node's bracket [lo, hi) until the bin that holds its target weight is light enough; sets cut."""
    by_node = Window.partitionBy("__node").orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)  # BINS rows a node
    pending = list(nodes)
    while pending:
        for n in pending:
            n["width"] = max(1, -(-(n["hi"] - n["lo"]) // BINS))
        brackets = _relation(
            spark,
            "__node int, __dim int, __lo bigint, __hi bigint, __width bigint, __before bigint, __target double",
            [{"__node": n["shard"], "__dim": n["dim"], "__lo": n["lo"], "__hi": n["hi"], "__width": n["width"], "__before": n["before"], "__target": n["target"]} for n in pending],
        )
        keyed = rows.join(brackets, F.col("shard") == F.col("__node")).withColumn("__key", _split_key(n_dimensions)).filter("__key >= __lo AND __key < __hi")
        bins = keyed.groupBy("__node", F.expr("(__key - __lo) div __width").alias("__bin")).agg(F.sum("size").alias("__bytes"), F.first("__before").alias("__b"), F.first("__target").alias("__t"))
        reached = bins.withColumn("__upto", F.col("__b") + F.sum("__bytes").over(by_node)).filter("__upto >= __t")
        found = {r["__node"]: r["m"] for r in reached.groupBy("__node").agg(F.min(F.struct("__bin", "__upto", "__bytes")).alias("m")).collect()}  # a row a node
        still = []
        for n in pending:
            r = found.get(n["shard"])
            if r is None:
                n["cut"] = n["hi"]
                continue
            lo = n["lo"] + r["__bin"] * n["width"]
            hi, before = min(lo + n["width"], n["hi"]), r["__upto"] - r["__bytes"]
            if n["width"] == 1 or r["__bytes"] <= TOLERANCE * shard_bytes:
                n["cut"] = hi if r["__upto"] - n["target"] < n["target"] - before else lo
            else:
                n |= {"lo": lo, "hi": hi, "before": before}
                still.append(n)
        pending = still


def kd_tree_shards(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    n_shards: int | None = None,
    target_bytes: int | None = None,
    dimensions: dict[str, Column] | None = None,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; shards have nearly equal bytes.

    Give n_shards, or target_bytes from which the number of leaves follows. A node of m leaves is
    cut at the weighted quantile floor(m/2)/m along the dimension that is widest inside it,
    measured as a share of the dimension's whole width.
    """
    if (n_shards is None) == (target_bytes is None):
        raise ValueError("give either n_shards or target_bytes")
    spark = df.sparkSession
    scratch = Scratch(spark, "kd-tree")
    dims = dimensions or default_dimensions()
    k = len(dims)
    raw = scratch.save(
        df.select(
            F.col(id_column).alias(id_column),
            (text_bytes(F.col(text_column)) + OVERHEAD_BYTES).alias("size"),
            F.crc32(F.coalesce(F.col(text_column), F.lit("")).cast("binary")).alias("text_crc32"),
            F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")).alias("__tie"),
            *[F.coalesce(c, F.lit(0.0)).alias(f"__v{i}") for i, c in enumerate(dims.values())],
        ),
        "rows",
    )
    stats = raw.agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *[f(f"__v{i}").alias(f"{s}{i}") for i in range(k) for s, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    total = stats["bytes"] or 0
    leaves = n_shards if n_shards is not None else max(1, -(-total // target_bytes))
    axes = []
    for i in range(k):
        lo, width = stats[f"lo{i}"] or 0.0, (stats[f"hi{i}"] or 0.0) - (stats[f"lo{i}"] or 0.0)
        scaled = F.floor((F.col(f"__v{i}") - F.lit(lo)) / F.lit(width) * F.lit(float(_SCALE))) if width > 0 else F.lit(0)
        axes.append(scaled.cast("long").alias(f"__d{i}"))
    rows = scratch.save(raw.select(id_column, "size", "text_crc32", "__tie", *axes, F.lit(0).alias("shard")), "level")
    sizes = {0: leaves}  # first shard of each node -> number of leaves below it
    while total and any(m > 1 for m in sizes.values()):
        spread = (
            rows.groupBy("shard")
            .agg(F.sum("size").alias("bytes"), *[f(f"__d{i}").alias(f"{s}{i}") for i in range(k) for s, f in (("lo", F.min), ("hi", F.max))])
            .collect()
        )
        nodes = []
        for r in spread:
            m = sizes[r["shard"]]
            if m < 2:
                continue
            dim = max(range(k), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"], -i))
            nodes.append(
                {"shard": r["shard"], "dim": dim, "lo": r[f"lo{dim}"] << 32, "hi": (r[f"hi{dim}"] + 1) << 32, "before": 0, "left": m // 2, "target": r["bytes"] * (m // 2) / m}
            )
        if not nodes:
            break
        _find_cuts(spark, rows, nodes, k, total / leaves)
        below = scratch.save(_descend(spark, rows, nodes, k), "level")
        scratch.drop(rows)
        rows = below
        children = {n["shard"]: n["left"] for n in nodes}
        sizes |= {n["shard"] + n["left"]: sizes[n["shard"]] - n["left"] for n in nodes}
        sizes |= children
    return number_within(rows.select(id_column, "size", "text_crc32", "shard"), "shard", id_column, "slot", stats["n"])


def op5_kd_tree_sharding(spark, sf_dir: str) -> DataFrame:
    out = kd_tree_shards(documents(spark, sf_dir), n_shards=24)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
