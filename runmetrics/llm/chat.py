"""Chat formatting of reply trees.

Messages form trees: each names the message it replies to, or none. Self-joins by doubled steps (parents, grandparents,
4, 8, ... steps up) find root and score of every leaf in as many rounds as the depth has binary digits; branches are
ranked by the sum of their messages' scores, of equal sums the smaller leaf id first; the same steps then list the
messages of the chosen branches, and each branch is formatted as one conversation.

A turn is ``[INST]role, line break, text[/INST]``, an assistant's turn is ``<s>text</s>``. Control strings inside texts
and roles get a backslash behind their first character (one more, if there are some), which ``unescaped`` takes away
again; percent signs and line breaks inside roles are written %25 and %0A. A conversation is an array of segments
(text, loss): joined, they are the formatted text, and those with loss are the assistants' texts, the loss mask.

Null texts and roles are empty, null scores 0. A message whose parent isn't in its tree is a root. Messages on a cycle
or behind one have no root and are left out. Of rows that repeat a message id one stays, the first by parent, role and
text. Null tree ids are a tree of their own. An empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import whole, written

LOSS_ROLE = "assistant"
# Marks of turns, and the control strings that are escaped.
OPEN, CLOSE, LOSS_OPEN, LOSS_CLOSE = "[INST]", "[/INST]", "<s>", "</s>"
_TAIL = r"(/?INST\]|/?s>|</?SYS>>)"
_TURNS = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])(\\*)" + _TAIL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<])\\(\\*)" + _TAIL, "$1$2$3")


def _role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _plain_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _key(value: Column) -> Column:
    """A value as text that joins like any other when it is null."""
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))


def segments(role: Column, text: Column) -> Column:
    """The segments (text, loss) of a turn."""
    def part(value: Column, loss: bool) -> Column:
        return F.struct(value.alias("text"), F.lit(loss).alias("loss"))

    return F.when(role == LOSS_ROLE, F.array(part(F.lit(LOSS_OPEN), False), part(escaped(text), True), part(F.lit(LOSS_CLOSE), False))).otherwise(
        F.array(part(F.concat(F.lit(OPEN), _role(role), F.lit("\n")), False), part(escaped(text), False), part(F.lit(CLOSE), False)))


def formatted(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: s["text"]), "")


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    def one(turn: Column) -> Column:
        body = F.substring(turn, F.lit(len(OPEN) + 1), F.length(turn) - len(OPEN) - len(CLOSE))
        answer = F.substring(turn, F.lit(len(LOSS_OPEN) + 1), F.length(turn) - len(LOSS_OPEN) - len(LOSS_CLOSE))
        split = F.instr(body, "\n")
        return F.when(F.startswith(turn, F.lit(LOSS_OPEN)), F.struct(F.lit(LOSS_ROLE).alias("role"), unescaped(answer).alias("text"))).otherwise(
            F.struct(_plain_role(F.substring(body, F.lit(1), split - 1)).alias("role"), unescaped(F.substring(body, split + 1, F.length(body))).alias("text")))

    return F.transform(F.regexp_extract_all(text, F.lit(_TURNS), F.lit(0)), one)


def loss_text(of: Column) -> Column:
    """All text under the loss mask, in order, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(of, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def format_trees(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """Conversations of ``messages`` (tree_id, message_id, parent_id, role, text, score).

    Returns tree_id, leaf_id, rank, score, n_turns, segments for the ``branches`` best branches of each tree (None: all).
    """
    nodes = written(
        messages.select(_key(F.col("tree_id")).alias("tree"), _key(F.col("message_id")).alias("id"), F.when(F.col("parent_id").isNotNull(), _key(F.col("parent_id"))).alias("parent"),
                        "tree_id", "message_id", whole("role").alias("role"), whole("text").alias("text"), F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
        .groupBy("tree", "id").agg(F.min(F.struct("parent", "role", "text", "score", "tree_id", "message_id")).alias("m")).select("tree", "id", "m.*"), "messages")
    largest = nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    present = nodes.select("tree", F.col("id").alias("up"))
    # one step: from a message to its parent; ``passed`` is the score of the messages stepped to
    step = written(nodes.select("tree", "id", F.col("parent").alias("up")).join(
        nodes.select("tree", F.col("id").alias("up"), F.col("score").alias("passed")), ["tree", "up"]).select("tree", "id", "up", "passed"), "steps")
    steps = []
    while not step.isEmpty() and 1 << len(steps) <= largest:
        steps.append(step)
        further = step.select("tree", F.col("id").alias("up"), F.col("up").alias("far"), F.col("passed").alias("more"))
        step = written(step.join(further, ["tree", "up"]).select("tree", "id", F.col("far").alias("up"), (F.col("passed") + F.col("more")).alias("passed")), "steps")
    parents = steps[0].select("tree", F.col("up").alias("id")).distinct() if steps else None
    leaves = nodes.join(parents, ["tree", "id"], "left_anti") if parents is not None else nodes
    climbed = leaves.select("tree", F.col("id").alias("leaf"), F.col("message_id").alias("leaf_id"), "tree_id", F.col("id").alias("node"), "score")
    for step in reversed(steps):
        up = step.select("tree", F.col("id").alias("node"), "up", "passed")
        climbed = climbed.join(up, ["tree", "node"], "left").select(
            "tree", "leaf", "leaf_id", "tree_id", F.coalesce("up", "node").alias("node"), (F.col("score") + F.coalesce("passed", F.lit(0.0))).alias("score"))
    if steps:  # a branch that could still climb has no root
        climbed = climbed.join(steps[0].select("tree", F.col("id").alias("node")), ["tree", "node"], "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf_id", "leaf")
    chosen = climbed.withColumn("rank", F.row_number().over(order)).select("tree", "leaf", "leaf_id", "tree_id", "rank", "score")
    chosen = written(chosen if branches is None else chosen.filter(F.col("rank") <= branches), "branches")
    paths = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("height"))
    for power in range(len(steps) - 1, -1, -1):
        up = steps[power].select("tree", F.col("id").alias("node"), "up")
        here = F.struct("node", "height")
        there = F.struct(F.col("up").alias("node"), (F.col("height") + (1 << power)).alias("height"))
        paths = paths.join(up, ["tree", "node"], "left").select("tree", "leaf", F.explode(F.array(here, there)).alias("at")).select(
            "tree", "leaf", "at.node", "at.height").filter(F.col("node").isNotNull())
    turns = written(paths, "paths").join(nodes.select("tree", F.col("id").alias("node"), "role", "text"), ["tree", "node"])
    made = turns.select("tree", "leaf", F.struct((-F.col("height")).alias("at"), segments(F.col("role"), F.col("text")).alias("of")).alias("turn"))
    whole_path = made.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return whole_path.join(chosen, ["tree", "leaf"]).select(
        "tree_id", "leaf_id", "rank", "score", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.transform("turns", lambda t: t["of"])).alias("segments"))


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: each row replies to the one before it.

    Rows that repeat a turn follow each other by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message_id", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree_id"), "message_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1).alias("parent_id"),
                       "role", "text", F.lit(1.0).alias("score"))
