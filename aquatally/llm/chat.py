"""Reply trees as conversations: paths by iterative self-joins, ranked, in a chat template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aquatally.functions.dayvec import bind
from aquatally.llm.util import running_sum, written

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    """Text without control strings: no ``<|`` is left.  ``unescape`` undoes it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``, and without a line break, which ends a role."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\/"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\/"), F.lit("\n")))


def reply_paths(nodes: DataFrame, per_tree: int = 1) -> DataFrame:
    """Rows (tree, path, step, role, text) of the chosen root-to-leaf paths of reply trees.

    ``nodes`` has tree, node, parent, role, text, score; a null parent or one that is not there
    makes a root.  A branch's score is the sum along its path; the ``per_tree`` best leaves of a
    tree are chosen, ties by the smaller leaf.  A null tree is a tree of its own.  Of rows with the
    same tree and node the smallest counts.  Rows without a node, and nodes in a cycle, which no
    root leads to, belong to no path.  An empty table gives no rows.

    Every round joins the nodes with themselves and doubles the length of their jumps, so paths
    of any depth take a logarithm of rounds.  The jumps then enumerate a chosen leaf's ancestors,
    each once: the distance to one is a sum of distinct powers of two.
    """
    # joins go by a text that is never null
    key = F.coalesce(F.concat(F.lit("t"), F.col("tree").cast("string")), F.lit(""))
    row = F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "tree")
    nodes = nodes.where("node is not null").groupBy(key.alias("tree_key"), "node").agg(F.min(row).alias("row"))
    nodes = written(nodes.select("tree_key", "node", "row.*"), "chat-nodes")
    largest = nodes.groupBy("tree_key").count().agg(F.max("count")).first()[0] or 0

    def met(left: DataFrame, at: str, right: DataFrame, how: str) -> DataFrame:
        other = right.withColumnRenamed("tree_key", "__key").withColumnRenamed("node", "__node")
        same = (F.col("tree_key") == F.col("__key")) & (F.col(at) == F.col("__node"))
        return left.join(other, same, how).drop("__key")

    # up: the node 2 ** round steps above; steps and total: from the node to just below it
    first = met(nodes.select("tree_key", "node", "parent", "score"), "parent", nodes.select("tree_key", "node"), "left")
    levels = [
        written(
            first.select("tree_key", "node", F.col("__node").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")),
            "chat-jumps",
        )
    ]
    while 2 ** (len(levels) - 1) < largest and not levels[-1].where("up is not null").isEmpty():
        above = levels[-1].select(
            "tree_key", "node", F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("total").alias("total2")
        )
        longer = met(levels[-1], "up", above, "left").select(
            "tree_key",
            "node",
            F.col("up2").alias("up"),
            (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
        )
        levels.append(written(longer, "chat-jumps"))
    parents = nodes.select("tree_key", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = met(levels[-1].where("up is null"), "node", parents, "left_anti")
    best = W.partitionBy("tree_key").orderBy(F.col("total").desc(), F.col("node"))
    chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_tree)
    paths = chosen.select("tree_key", F.col("node").alias("path"), F.col("node").alias("at"), F.col("steps").alias("step"))
    for distance, level in reversed(list(enumerate(levels))):
        hop = level.where("up is not null").select("tree_key", "node", "up")
        higher = met(paths, "at", hop, "inner").select(
            "tree_key", "path", F.col("up").alias("at"), (F.col("step") - 2**distance).alias("step")
        )
        paths = written(paths.unionByName(higher), "chat-paths")
    return met(paths, "at", nodes.select("tree_key", "node", "tree", "role", "text"), "inner").select(
        "tree", "tree_key", "path", "step", "role", "text"
    )


def format_conversations(paths: DataFrame, learn: str = "assistant") -> DataFrame:
    """(tree, path, formatted, loss) per path: turns in the template, and for every turn the code
    points [start, end) of ``formatted`` that are learnt, null where the role is not ``learn``.

    Control strings inside texts and roles are escaped; ``read_back`` undoes it.  Null roles and
    texts are empty.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    turn = F.struct(
        F.col("step"),
        F.concat(head, escape(text), F.lit(END + "\n")).alias("piece"),
        F.char_length(head).cast("long").alias("from"),
        F.char_length(escape(text)).cast("long").alias("length"),
        (role == learn).alias("learnt"),
    )
    turns = paths.groupBy("tree_key", "path").agg(F.first("tree").alias("tree"), F.sort_array(F.collect_list(turn)).alias("turns"))
    ends = running_sum(F.transform("turns", lambda t: F.char_length(t["piece"]).cast("long")))

    def spans(ends: Column) -> Column:
        def span(t: Column, i: Column) -> Column:
            start = F.get(ends, i) - F.char_length(t["piece"]) + t["from"]
            return F.when(t["learnt"], F.struct(start.alias("start"), (start + t["length"]).alias("end")))

        return F.transform("turns", span)

    return turns.select(
        "tree",
        "path",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        bind(ends, spans).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and the text ``learnt``, both parsed from the output."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    out = formatted.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    size = len(END) + 1
    ends = running_sum(F.transform("pieces", lambda p: (F.char_length(p) + size).cast("long")))

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(START) + 1))
        cut = F.instr(body, "\n")
        return F.struct(
            unescape_role(F.substr(body, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(body, cut + 1)).alias("text")
        )

    def learnt(bound: Column) -> Column:
        def masked(piece: Column, i: Column) -> Column:
            span = F.get(bound["loss"], i)
            begin = F.get(bound["ends"], i) - F.char_length(piece) - size
            under = F.substr(piece, (span["start"] - begin + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
            return F.when(span.isNotNull(), unescape(under)).otherwise("")

        return F.array_join(F.transform("pieces", masked), "")

    # bound, so that a long conversation computes them once and not for every turn
    masks = F.struct(F.col("loss").alias("loss"), ends.alias("ends"))
    return out.withColumn("learnt", bind(masks, learnt)).withColumn("turns", F.transform("pieces", turn)).drop("pieces")
