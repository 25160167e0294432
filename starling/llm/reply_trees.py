"""Chat formatting from reply trees.

Nodes name their parent. Self-joins double every node's ancestor pointer (1, 2, 4, … levels) until all have reached
their root, which takes log2(depth) rounds and gives depth, root and the path's score sum. The best branches of each
root are then walked back from their leaf: the set of nodes on a chosen path is joined with the pointer tables, and
doubles with each. Every path becomes one conversation in a template whose control strings cannot come out of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that a tokenizer or template may take as control, ours and others' (fixed values).
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_REST = "|".join("".join(f"\\x{ord(c):02x}" for c in s[1:]) for s in CONTROL)


def escape(text: Column) -> Column:
    """Backslashes are doubled, and one is put after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), rf"([<\[])(?={_REST})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


#: What a role must not hold, and what stands for it (fixed values; the percent sign first).
ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape_role(role: Column) -> Column:
    for a, b in ROLE:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in reversed(ROLE):
        role = F.replace(role, F.lit(b), F.lit(a))
    return role


def pointers(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of nodes (id, parent, score), each node's root, depth and path score; and the pointer tables by power of two.

    A parent that is missing makes its child a root. Nodes on a cycle never reach a root; after as many rounds as the
    node count allows they are left out.
    """
    ids = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    start = lambda rows, up: rows.select("id", up.alias("up"), "score", F.lit(1).alias("steps"), F.col("id").alias("root"))
    replies = start(nodes.where("parent IS NOT NULL").join(ids, "parent", "left"), F.when(F.col("known"), F.col("parent")))
    roots = nodes.where("parent IS NULL")  # not joined: they would meet in one task
    at = replies.unionByName(start(roots, F.lit(None).cast(nodes.schema["parent"].dataType)))
    at, jumps = stored(at), []
    rounds = 1 + max(1, at.count()).bit_length()
    while at.where("up IS NOT NULL").take(1) and len(jumps) < rounds:
        open_, above = at.where("up IS NOT NULL"), at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("more"), F.col("steps").alias("far"), F.col("root").alias("top"))
        jumps.append(open_.select("id", "up"))
        moved = open_.join(above, "up").select("id", F.col("up2").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("steps") + F.col("far")).alias("steps"), F.col("top").alias("root"))
        at = stored(moved.unionByName(at.where("up IS NULL")))  # nodes that have reached their root rest
    return at.where("up IS NULL").drop("up"), jumps


def chosen_paths(nodes: DataFrame, branches: int) -> DataFrame:
    """Rows (root, leaf, id, depth) of the branches best root-to-leaf paths of each root.

    Branches rank by mean score, then by depth, then by the leaf's id.
    """
    at, jumps = pointers(nodes)
    parents = nodes.select(F.col("parent").alias("id")).where("id IS NOT NULL").distinct()
    leaves = at.join(parents, "id", "left_anti")
    best = Window.partitionBy("root").orderBy(F.desc(F.col("score") / F.col("steps")), F.desc("steps"), F.asc("id"))
    on = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches).select("root", F.col("id").alias("leaf"), "id", "rank")
    for jump in jumps:
        on = stored(on)  # read twice below, so that the plan would double with every round
        on = on.unionByName(on.join(jump, "id").select("root", "leaf", F.col("up").alias("id"), "rank"))
    return on.join(at.select("id", F.col("steps").alias("depth")), "id")


def format_paths(paths: DataFrame) -> DataFrame:
    """Of rows (root, leaf, rank, depth, role, text), one row (root, leaf, rank, formatted, loss) per path.

    loss lists (start, length) in code points of the assistant's texts inside formatted.
    """
    head = F.concat(F.lit(START), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    turn = F.struct("depth", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    tail = END + "\n"
    rows = paths.select("root", "leaf", "rank", turn.alias("turn")).groupBy("root", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        h, b = F.length(t["head"]), F.length(t["body"])
        span = F.struct((acc["at"] + h).cast("bigint").alias("start"), b.cast("bigint").alias("length"))
        return F.struct((acc["at"] + h + b + len(tail)).cast("bigint").alias("at"), F.when(t["learn"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return rows.select(
        "root", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "").alias("formatted"),
        F.aggregate("turns", start, step)["spans"].alias("loss"),
    )


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Of nodes (id, parent, role, text, score), the chosen branches of every tree as conversations.

    Null texts and roles are empty, null scores 0; rows with the same id are one node (the least role and text stands);
    an empty table gives no rows.
    """
    nodes = nodes.select("id", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("parent", "role", "text", "score")).alias("n")).select("id", "n.*")
    paths = chosen_paths(nodes.select("id", "parent", "score"), branches)
    return format_paths(paths.join(nodes.select("id", "role", "text"), "id"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with ``parsed``: an array of (role, text), got from the formatted string alone."""
    turn = lambda t: F.struct(
        unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
        unescape(F.substring(t, F.instr(t, "\n") + 1, F.length(t) - F.instr(t, "\n") - len(END) - 1)).alias("text"),
    )
    parts = F.split("formatted", r"\Q" + START + r"\E")  # the first is what stands before the first turn: nothing
    return formatted.withColumn("parsed", F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), turn))


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Rows by turn as a forest: each row answers the one before it. Equal turns stand in order of role and text."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("k", F.row_number().over(order))
    node = lambda k: F.struct("conv_id", k.alias("k"))
    return rows.select(node(F.col("k")).alias("id"), F.when(F.col("k") > 1, node(F.col("k") - 1)).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from the output."""
    rows = read_back(formatted)
    said = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return rows.select(
        F.col("root.conv_id").alias("conv_id"),
        F.size("parsed").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("bigint").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
