"""Chat formatting of reply trees: paths from root to leaf, ranked by score, each formatted as one conversation.

Messages name their parent. Paths are enumerated by self-joins that double the reach each time: first every leaf, then
leaf and parent, then four, eight ... messages, so a path of n messages takes about log2(n) joins.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles a backslash is put between ``<`` and
``|`` (after backslashes that stand there already, one more), so no control string can arise and the texts can be
recovered; a line end inside a role becomes ``<|nl|>``, which escaped text cannot hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<|nl|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def thread(turns: DataFrame) -> DataFrame:
    """Rows by turn as reply trees: each turn answers the one before it in its conversation.

    Adds tree_id, message_id, parent_id and score 0. Turns of equal number follow each other by role and text; null
    turns come first; rows alike in everything are separate messages.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # one conversation, which its result holds whole
    rows = turns.select(F.col("conv_id").alias("tree_id"), "role", "text", F.row_number().over(order).cast("long").alias("message_id"))
    return rows.withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1)).withColumn("score", F.lit(0.0))


def paths(messages: DataFrame) -> DataFrame:
    """tree_id, leaf, message_id, up: all messages on the way from each leaf to its root; ``up`` is 0 at the leaf.

    Input: tree_id, message_id, parent_id (null at a root), unique by tree and message. A parent that does not exist
    makes its child a root. Replies in a circle have no leaf and give no path, and neither does a leaf whose way ends in
    a circle: it has no root. Jumps of one, two, four ... messages are found first; a message that can still jump as far
    as its tree has messages stands in or below a circle.
    """
    links = messages.select("tree_id", "message_id", "parent_id")
    known = links.select("tree_id", F.col("message_id").alias("p"))
    real = cut_lineage(links.where("parent_id IS NOT NULL").join(known.withColumnRenamed("tree_id", "t"), F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("p")), "left_semi"))
    parents = real.select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).distinct()
    leaves = links.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("p")), "left_anti")
    longest = links.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    jumps = [real.select(F.col("tree_id").alias("t"), F.col("message_id").alias("m"), F.col("parent_id").alias("far"))]
    while not jumps[-1].isEmpty():
        if 1 << (len(jumps) - 1) >= longest:
            lost = jumps.pop().select("t", "m")
            leaves = leaves.join(lost, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")), "left_anti")
            break
        there = jumps[-1].select(F.col("t").alias("t2"), F.col("m").alias("m2"), F.col("far").alias("further"))
        jumps.append(cut_lineage(jumps[-1].join(there, F.col("t").eqNullSafe(F.col("t2")) & (F.col("far") == F.col("m2"))).select("t", "m", F.col("further").alias("far"))))
    held = cut_lineage(leaves.select("tree_id", F.col("message_id").alias("leaf"), "message_id", F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps):
        step = held.join(jump, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")))
        more = step.select("tree_id", "leaf", F.col("far").alias("message_id"), (F.col("up") + (1 << k)).alias("up"))
        held = cut_lineage(held.unionByName(more))
    return held


def conversations(messages: DataFrame, best: int | None = 1, train_role: str = "assistant") -> DataFrame:
    """tree_id, leaf, rank, n_turns, score, text and loss (spans of characters, end excluded) per chosen branch.

    Input: tree_id, message_id, parent_id, role, text, score. A branch's score is the sum over its messages, null
    as 0; ties go to the smaller leaf. ``best`` branches of each tree are formatted, all for None. Null texts and
    roles are empty. The loss covers the text of ``train_role`` turns as written, without role and control strings.
    """
    lines = paths(messages).join(messages.select("tree_id", "message_id", "role", "text", "score").withColumnRenamed("tree_id", "t").withColumnRenamed("message_id", "m"), F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("message_id") == F.col("m")))
    branches = lines.groupBy("tree_id", "leaf").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("total"))
    if best == 1:
        ranks = branches.groupBy("tree_id").agg(F.min(F.struct((-F.col("total")).alias("k"), F.col("leaf").alias("l"))).alias("who")).select("tree_id", F.col("who.l").alias("leaf"), F.lit(1).alias("rank"))
    else:  # a limit on the rank already holds before the shuffle
        ranks = branches.withColumn("rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("total"), "leaf")))
        ranks = (ranks if best is None else ranks.where(F.col("rank") <= best)).select("tree_id", "leaf", "rank")
    ranks = ranks.toDF("t1", "l1", "rank")
    scored = lines.join(ranks, F.col("tree_id").eqNullSafe(F.col("t1")) & (F.col("leaf") == F.col("l1")))
    rank = F.col("rank").cast("int")
    whole = scored.select("tree_id", "leaf", rank.alias("rank"), F.struct((-F.col("up")).alias("k"), escape_role(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), F.col("role").eqNullSafe(F.lit(train_role)).alias("loss"), F.coalesce("score", F.lit(0.0)).alias("score")).alias("turn"))
    whole = whole.groupBy("tree_id", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    head = lambda t: F.length(F.lit(START)) + F.length(t["role"]) + 1
    size = lambda t: head(t) + F.length(t["text"]) + F.length(F.lit(END)) + 1
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + head(t)
        span = F.array(F.struct(start.cast("long").alias("start"), (start + F.length(t["text"])).cast("long").alias("end")))
        return F.struct((acc["at"] + size(t)).cast("long").alias("at"), F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return whole.select("tree_id", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"), F.aggregate("turns", F.lit(0.0), lambda a, t: a + t["score"]).alias("score"), text.alias("text"), F.aggregate("turns", zero, add)["spans"].alias("loss"))


def turns_of(text: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation, unescaped."""
    bodies = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda x: x != "")
    after = lambda x: F.substring(x, F.length(F.lit(START)) + 1, F.length(x))
    cut = lambda x: F.instr(after(x), "\n")
    return F.transform(bodies, lambda x: F.struct(
        unescape_role(F.substring(after(x), F.lit(1), cut(x) - 1)).alias("role"), unescape(F.substring(after(x), cut(x) + 1, F.length(x))).alias("text")))


def masked_text(text: Column, loss: Column) -> Column:
    """The text under the loss spans, unescaped, in order."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))))
