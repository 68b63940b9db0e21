"""Conversations rebuilt from quotations.

A message's quoted lines are parsed into levels, quoted passages are normalised and hashed, and each is joined to the
first message of the conversation that wrote it.  The latest message that a message quotes on level 1 is its parent;
without one it starts a thread.  Quotes are dropped, and messages are ordered so that a reply follows what it answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faintlabel.llm.common import stored

#: A quoted line: signs, each perhaps with a blank after it.
QUOTED = r"^((?:>[ \t]?)+)"


def normalised(passage: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(passage, r"\s+", " ")))


def lines_of(messages: DataFrame) -> DataFrame:
    """A row per line: line number, level (0: the message's own words) and the words without quote signs."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "_raw"))
    sign = F.regexp_extract("_raw", QUOTED, 1)
    words = F.substring(F.col("_raw"), F.length(sign) + 1, F.length("_raw"))
    return lines.select("conv_id", "turn", "line", F.length(F.regexp_replace(sign, r"[ \t]", "")).alias("level"), normalised(words).alias("words")).where("words <> ''")


def own_text(text: Column) -> Column:
    """A text without its quoted lines and the blank lines that they leave at its ends."""
    kept = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(r"^>"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, origin and passages: how many quoted lines of each level come from which earlier message.

    The origin of a line is the first message of the conversation that has it among its own words; a line that no
    earlier message wrote links to nothing.
    """
    lines = lines_of(messages).withColumn("hash", F.xxhash64("words")).drop("words")
    lines = stored(lines, "lines")
    wrote = stored(lines.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("origin")), "wrote")
    quoted = lines.where("level > 0").join(wrote, ["conv_id", "hash"]).where("origin < turn")
    return quoted.groupBy("conv_id", "turn", "level", "origin").agg(F.count(F.lit(1)).alias("passages"))


def conversations(messages: DataFrame, most_rounds: int = 64) -> DataFrame:
    """conv_id, turn, role, reply_to, root, depth and text (without quotes) of every message.

    Sorted by conv_id, root, depth, reply_to and turn, each reply follows what it answers.  reply_to is null for a
    message that quotes nothing known.  Rows with a null conv_id or turn stand for themselves: they quote nothing and
    have no root; repeated (conv_id, turn) rows share parent and root; null texts are empty.
    """
    parents = links(messages).where("level = 1").groupBy("conv_id", "turn").agg(F.max("origin").alias("reply_to"))
    spots = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn").distinct()
    tree = stored(spots.join(parents, ["conv_id", "turn"], "left"), "tree")
    # pointer doubling: ``up`` is an ancestor ``far`` steps above
    state = stored(tree.select("conv_id", "turn", F.coalesce("reply_to", "turn").alias("up"), F.col("reply_to").isNotNull().cast("long").alias("far")), "state")
    going, done = state, None  # only messages that have not reached their root are joined again
    for _ in range(most_rounds):
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        after = stored(going.join(above, ["conv_id", "up"]).select("conv_id", "turn", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"), (F.col("_far") > 0).alias("_moved")), "state")
        there = after.where("not _moved").drop("_moved")
        done = there if done is None else done.unionAll(there)
        going = after.where("_moved").drop("_moved")
        state = done.unionAll(going)
        if going.isEmpty():
            break
    placed = tree.join(state, ["conv_id", "turn"]).select("conv_id", "turn", "reply_to", F.col("up").alias("root"), F.col("far").alias("depth"))
    own = messages.select("conv_id", "turn", "role", own_text(F.col("text")).alias("text"))
    return own.join(stored(placed, "placed"), ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "reply_to", "root", "depth", "text")


def reply_ordered(threads: DataFrame) -> DataFrame:
    """The messages over all tasks in reply order, ranges of it in each, so that no conversation has to fit into one."""
    order = ["conv_id", "root", "depth", "reply_to", "turn"]
    return threads.repartitionByRange(*order).sortWithinPartitions(*order)


def as_mailbox(messages: DataFrame) -> DataFrame:
    """The turns as mail: each quotes the turn before it on level 1, and that one's own quote, the turn before that, on level 2."""
    def marked(text: Column, sign: str) -> Column:
        return F.regexp_replace(text, r"(?m)^", sign)

    base = messages.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("_text"))
    one = base.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("_text").alias("_one"))
    two = base.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("_text").alias("_two"))
    both = stored(one.join(two, ["conv_id", "turn"], "left"), "quoted")
    mail = messages.join(both, ["conv_id", "turn"], "left")
    quote = F.concat_ws("\n", marked(F.col("_two"), ">> "), marked(F.col("_one"), "> "))
    return mail.select("conv_id", "turn", "role", F.concat_ws("\n", F.when(F.col("_one").isNotNull(), quote), "text").alias("text"))
