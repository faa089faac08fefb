"""Reply trees: the best root-to-leaf paths, each formatted as one conversation with a loss mask."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackweave.llm.common import c, let, saved, scratch

# The control strings of the template. A turn is [INST]role[/INST]text</s>, a conversation <s> and its turns.
OPEN, CLOSE, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"


@dataclass(frozen=True)
class Branches:
    """best: paths kept of each tree, by score. trained: the role whose texts are under the loss mask."""

    best: int = 1
    trained: str = "assistant"


def escaped(text: Column) -> Column:
    """text with no control string in it: backslashes double, and one goes behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for x in (OPEN, CLOSE, ROLE, TEXT):
        out = F.replace(out, F.lit(x), F.lit(x[0] + "\\" + x[1:]))
    return out


def unescaped(text: Column) -> Column:
    """The text that escaped() was given: a backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def linear_trees(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as trees without branches: (tree, node, parent, score, role, text), by turn, then role, then text.

    Nulls: a null text or role is empty; null turns come first; rows of a null conv_id are one conversation.
    Repeated rows stay turns of their own.
    """
    clean = rows.select(
        c(conv_id).cast("long").alias("tree"), c(turn).alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text")
    )
    node = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    numbered = clean.withColumn("node", node)
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def best_paths(nodes: DataFrame, best: int = 1) -> DataFrame:
    """(tree, leaf, path_rank, place, node): the nodes of the best paths of each tree, place from 0 at the root.

    nodes: (tree, node, parent, score). A path's score is the sum of its nodes'; ties go to the smaller leaf. Each round of
    self-joins doubles how far every node sees towards its root, so the rounds grow with the logarithm of the depth, and
    nodes that have seen their root are left out. A parent that is not there makes its child a root; null scores are 0;
    nodes on a cycle or behind one reach no root and belong to no path: a path is no longer than its tree has nodes, so
    what is open after as many doublings is left. A node comes once in its tree (unique_nodes); null nodes take no part.
    """
    table = nodes.where("node is not null").select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = table.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    known = table.join(there, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    level = known.select("tree", "node", F.col("n").alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("steps"))
    level = saved(level, "level")
    jumps, done = [], [level.where("up is null")]
    most = level.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    while (1 << len(jumps)) < most and not level.where("up is not null").isEmpty():
        jumps.append(level.where("up is not null").select("tree", "node", "up"))
        x = level.where("up is not null").alias("x")
        y = level.union(done_rows(done[:-1])).alias("y") if len(done) > 1 else level.alias("y")
        on = F.col("x.tree").eqNullSafe(F.col("y.tree")) & (F.col("x.up") == F.col("y.node"))
        level = x.join(y, on).select(
            "x.tree", "x.node", F.col("y.up").alias("up"), (F.col("x.total") + F.col("y.total")).alias("total"), (F.col("x.steps") + F.col("y.steps")).alias("steps")
        )
        level = saved(level, "level")
        done.append(level.where("up is null"))
    scored = done_rows(done)
    parents = table.select(F.col("tree").alias("t"), F.col("parent").alias("p")).where("p is not null").distinct()
    leaves = scored.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    by = Window.partitionBy("tree").orderBy(F.desc("total"), "node")
    chosen = leaves.withColumn("path_rank", F.row_number().over(by)).where(F.col("path_rank") <= best)
    path = saved(chosen.select("tree", F.col("node").alias("leaf"), "path_rank", (F.col("steps") - 1).alias("place"), "node"), "path")
    for k in reversed(range(len(jumps))):
        j = jumps[k].select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        up = path.join(j, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        path = path.union(up.select("tree", "leaf", "path_rank", F.col("place") - (1 << k), F.col("up").alias("node")))
        path = saved(path, "path")
    return path


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent, score, role, text) with one row a node: the one of the highest score, then by parent, role, text."""
    rest = F.struct((-F.coalesce("score", F.lit(0.0))).alias("low"), "parent", "role", "text")
    one = nodes.groupBy("tree", "node").agg(F.min(rest).alias("x"))
    return one.select("tree", "node", "x.parent", (-F.col("x.low")).alias("score"), "x.role", "x.text")


def done_rows(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def formatted(nodes: DataFrame, rules: Branches = Branches(), unique: bool = False) -> DataFrame:
    """(tree, leaf, path_rank, formatted, mask): one row for each chosen path of the trees (tree, node, parent, score, role, text).

    mask: the [start, end) in code points of the trained texts, in order. No nodes, no rows. unique: nodes are known to come once
    in their tree, else unique_nodes() sees to it. Null roles and texts are empty.
    """
    filled = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    nodes = nodes.select("tree", "node", "parent", "score", *filled)
    nodes = saved(nodes if unique else unique_nodes(nodes), "nodes")
    with scratch(nodes.sparkSession) as kept:
        path = saved(best_paths(nodes.select("tree", "node", "parent", "score"), rules.best), "paths")
        kept.append(path)
    turns = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), "role", "text")
    on = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
    one = path.join(turns, on).select(
        "tree", "leaf", "path_rank", "place",
        F.concat(F.lit(ROLE), escaped(F.col("role")), F.lit(TEXT)).alias("head"),
        escaped(F.col("text")).alias("body"),
        (F.col("role") == rules.trained).alias("loss"),
    )
    turn = F.struct("place", "head", "body", "loss")
    whole = one.groupBy("tree", "leaf", "path_rank").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = F.concat(F.lit(OPEN), F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), ""))
    span = "array<struct<start:bigint,end:bigint>>"
    first = F.struct(F.lit(len(OPEN)).cast("long").alias("at"), F.array().cast(span).alias("mask"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.char_length(x["head"])
        end = start + F.char_length(x["body"])
        own = F.array(F.struct(start.alias("start"), end.alias("end"))).cast(span)
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), F.when(x["loss"], F.concat(a["mask"], own)).otherwise(a["mask"]).alias("mask"))

    return whole.select("tree", "leaf", "path_rank", text.alias("formatted"), F.aggregate("turns", first, step, lambda a: a["mask"]).alias("mask"))


def parsed(text: Column) -> Column:
    """The turns {role, text} of a formatted conversation."""
    pieces = F.split(F.substring(text, len(OPEN) + 1, 2**31 - 1), CLOSE, -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, TEXT, 1)
        return F.struct(
            unescaped(F.substring(head, len(ROLE) + 1, 2**31 - 1)).alias("role"),
            unescaped(x.substr(F.char_length(head) + len(TEXT) + 1, F.char_length(x))).alias("text"),
        )

    return F.transform(turns, turn)


def masked(text: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda m: unescaped(text.substr((m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


def conversation_digests(out: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations finds: turns, loss text and length of each."""
    turns = let(parsed(F.col("formatted")), lambda p: F.struct(
        F.size(p).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(p, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("sha"),
    ))
    loss = let(masked(F.col("formatted"), F.col("mask")), lambda x: F.struct(F.char_length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha")))
    return out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        F.col("tree").alias("conv_id"),
        F.col("turns.n").alias("n_turns"),
        F.col("turns.sha").alias("turns_sha256"),
        F.col("loss.n").alias("loss_chars"),
        F.col("loss.sha").alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
