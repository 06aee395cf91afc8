r"""Reply trees to formatted conversations, in DataFrame expressions only.

Root-to-leaf paths come from iterative self-joins that double their reach, so a tree of depth d takes log2(d) rounds. The
first rounds run over messages: after k of them each knows its 2**k-th ancestor and the sum of scores on the way, with one row
a message however many branches share it. Branches are ranked
by the sum of their messages' scores (a null counts 0; ties go to the smaller leaf id), and only the chosen ones
are enumerated, by the same jumps, and formatted as one conversation each.

Template: ``<|im_start|>role\ntext<|im_end|>\n`` per turn. In texts and roles a backslash is doubled,
every control string gets a backslash after its first character, and a newline in a role becomes
``\n``, so formatted text can be read back exactly. The loss mask is a list of code point spans that
cover the (escaped) texts of the trainable role.

Defined cases: null roles and texts are empty; messages of one tree with a parent id that does not
exist count as roots; messages caught in a cycle of parents have no root and form no path; repeated
rows of a linear conversation are turns of their own, ordered by turn, role, text (nulls first);
null tree ids are one tree; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.tables import table
from corpuslens.plans.scratch import Scratch

START, END = "<|im_start|>", "<|im_end|>"
#: Fixed control strings of common chat templates, as one pattern (first character, rest).
CONTROL = r"(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|</?SYS>>)|(\[)(/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    between = F.split(role, r"\\\\")  # doubled backslashes stand between the parts
    return F.array_join(F.transform(between, lambda part: unescape(F.replace(part, F.lit("\\n"), F.lit("\n")))), "\\")


def linear_tree(turns: DataFrame) -> DataFrame:
    """A conversation table (conv_id, turn, role, text) as trees in which each turn answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select("conv_id", node.alias("node"), "role", "text").select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def ranked_leaves(messages: DataFrame, scratch: Scratch, paths_per_tree: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(conv_id, leaf, score, rank) of the best leaves of each tree, and the jumps (conv_id, node, above) of 1, 2, 4, ... steps up."""
    links = messages.select("conv_id", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("total"))
    known = links.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    now = scratch.save(links.join(known, same & (F.col("parent") == F.col("n")), "left").select("conv_id", "node", F.col("n").alias("above"), "total"), "links")
    inner = now.filter("above IS NOT NULL").select(F.col("conv_id").alias("c"), F.col("above").alias("n")).distinct()
    leaves = scratch.save(now.join(inner, same & (F.col("node") == F.col("n")), "left_anti").select(F.col("conv_id").alias("lc"), F.col("node").alias("leaf")), "leaves")
    largest = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    # done: messages whose root is reached; their totals are final and are saved once
    done, open_, jumps, reach = now.filter("above IS NULL"), now.filter("above IS NOT NULL"), [], 1
    while reach < largest and not open_.isEmpty():
        jumps.append(open_.select("conv_id", "node", "above"))
        to = done.unionByName(open_).select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("above").alias("a"), F.col("total").alias("t"))
        further = open_.join(to, same & (F.col("above") == F.col("n")))
        further = scratch.save(further.select("conv_id", "node", F.col("a").alias("above"), (F.col("total") + F.col("t")).alias("total")), "jumps")
        done, open_ = done.unionByName(further.filter("above IS NULL")), further.filter("above IS NOT NULL")
        reach *= 2
    # messages that are still open are caught in a cycle
    scored = leaves.join(done, F.col("lc").eqNullSafe(F.col("conv_id")) & (F.col("leaf") == F.col("node"))).select("conv_id", "leaf", F.col("total").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    return scratch.save(ranked if paths_per_tree is None else ranked.filter(F.col("rank") <= paths_per_tree), "ranked"), jumps


def reply_paths(leaves: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(conv_id, leaf, node, up) for all messages between the leaves (conv_id, leaf) and their roots; up counts from the leaf."""
    paths = leaves.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(jumps):
        to = jump.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("above").alias("a"))
        further = paths.join(to, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
        paths = scratch.save(paths.unionByName(further.select("conv_id", "leaf", F.col("a").alias("node"), (F.col("up") + 2**k).alias("up"))), "paths")
    return paths


def format_trees(messages: DataFrame, paths_per_tree: int | None = None, trainable_role: str = "assistant") -> DataFrame:
    """(conv_id, leaf, score, rank, formatted, loss_spans) for the chosen branches of each tree.

    messages: conv_id, node, parent, role, text, score. paths_per_tree: how many of the best
    branches to format; None formats all.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    messages = scratch.save(messages.select("conv_id", "node", "parent", "role", "text", "score"), "messages")
    ranked, jumps = ranked_leaves(messages, scratch, paths_per_tree)
    paths = reply_paths(ranked, jumps, scratch)
    keyed = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    chosen = ranked.select(F.col("conv_id").alias("rc"), F.col("leaf").alias("rl"), F.col("score").alias("path_score"), "rank")
    turns = (
        paths.join(chosen, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("leaf") == F.col("rl")))
        .join(keyed, same & (F.col("node") == F.col("n")))
        .select("conv_id", "leaf", "path_score", "rank", (-F.col("up")).alias("at"), escape_role(F.col("role")).alias("r"), escape(F.col("text")).alias("t"), (F.col("role") == trainable_role).alias("train"))
    )
    before = Window.partitionBy("conv_id", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("piece", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END + "\n")))
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("r") + (len(START) + 1))
    span = F.when(F.coalesce(F.col("train"), F.lit(False)), F.struct(F.col("start").alias("start"), (F.col("start") + F.length("t")).alias("end")))
    return (
        turns.groupBy("conv_id", "leaf")
        .agg(
            F.first("path_score").alias("score"),
            F.first("rank").alias("rank"),
            F.array_sort(F.collect_list(F.struct("at", "piece", span.alias("span")))).alias("turns"),
        )
        .select(
            "conv_id",
            "leaf",
            "score",
            "rank",
            F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
            F.filter(F.transform("turns", lambda t: t.span), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from formatted text."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        text = F.substring(piece, F.length(head) + 2, F.length(piece))
        return F.struct(unescape_role(F.substring(head, F.lit(len(START) + 1), F.length(head))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")


def op4_chat_formatting(spark, sf_dir: str) -> DataFrame:
    probe = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_trees(linear_tree(turns)).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '{CONTROL}', '\1\3\\\2\4', 'g')) AS text_chars,
    length(replace(regexp_replace(replace(role, '\', '\\'), '{CONTROL}', '\1\3\\\2\4', 'g'), chr(10), '\n')) AS role_chars FROM t),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(text_chars + role_chars + {len(START) + len(END) + 2}) AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
