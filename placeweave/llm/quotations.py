"""Quotation linking: messages with quoted passages become threads of messages without quotes.

All steps are DataFrame functions. A quoted line is a passage with a nesting level; its hash is
looked up among the lines that messages hold as their own. The message that most of the
shallowest quoted passages come from is the one replied to, and following the replies gives the
thread.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.columns import hot_rows
from placeweave.operators.skew import Hot, hot_from_rows, salted_join
from placeweave.staging import Stage

# Possessive, so that a line of very many marks is matched without recursion.
_MARKS = r"^[ \t]*+((?:>[ \t]?+)++)"
# What \s matches.
_SPACE = " \t\n\x0b\x0c\r"
_MESSAGE = ["conv_id", "turn"]


def lines(text: Column) -> Column:
    """The lines of a message as structs (level, content); level 0 is the message's own text."""

    def parse(line: Column) -> Column:
        marks = F.regexp_extract(line, _MARKS, 1)
        return F.struct(
            F.char_length(F.regexp_replace(marks, r"[ \t]", "")).alias("level"),
            F.regexp_replace(line, _MARKS, "").alias("content"),
        )

    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    return F.transform(F.split(plain, "\n"), parse)


def own_text(text: Column) -> Column:
    """The message without quoted lines and without blank lines at its ends."""
    kept = F.filter(lines(text), lambda line: line["level"] == 0)
    joined = F.array_join(F.transform(kept, lambda line: line["content"]), "\n")
    return F.trim(joined, F.lit(_SPACE))


def passage_hash(content: Column) -> Column:
    """Hash of a passage without regard to case and white space; null for a blank one."""
    plain = F.lower(F.trim(F.regexp_replace(content, r"\s+", " ")))
    return F.when(plain != "", F.sha2(plain, 256))


def link_quotations(messages: DataFrame, stage: Stage) -> DataFrame:
    """Messages (conv_id, turn, role, text) in the order of replies, without quotes.

    Each row gets `message` (the own text after its role), the numbers of quoted and of linked
    passages, the message replied to (`reply_conv_id`, `reply_turn`), the first message of the
    thread (`thread_conv_id`, `thread_turn`) and `depth`, the replies from there. A passage is
    looked up in its own conversation, as the first earlier turn that has it, and else among all
    messages, as the smallest (conv_id, turn) before its own. Of the messages quoted at the lowest
    level, the one with most passages is replied to; among equals a message of the conversation,
    then the latest. Rows that repeat (conv_id, turn) are one message with the lines of all; a row
    without conv_id or turn is a thread of its own. A null text counts as empty, a null role as
    unknown. Extra columns are dropped.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        "text",
    )
    passages = rows.dropna(subset=_MESSAGE).select(
        *_MESSAGE, F.explode(lines(F.col("text"))).alias("line")
    )
    passages = passages.select(
        *_MESSAGE, "line.level", passage_hash(F.col("line.content")).alias("hash")
    ).filter("hash IS NOT NULL")
    passages, seen = stage.keep_measured(passages, "passages", size=F.count(F.lit(1)))
    quoted = passages.filter("level > 0")
    hot = hot_from_rows(quoted, ["hash"], hot_rows(seen["size"]), seen["size"])
    linked = stage.keep(_sources(quoted, passages.filter("level = 0"), hot), "sources")
    numbers = quoted.groupBy(*_MESSAGE).agg(F.count(F.lit(1)).alias("n_quoted"))
    found = linked.groupBy(*_MESSAGE).agg(F.count(F.lit(1)).alias("n_linked"))
    threads = _threads(rows, _replies(linked), stage)
    result = (
        rows.join(numbers, _MESSAGE, "left")
        .join(found, _MESSAGE, "left")
        .join(threads, _MESSAGE, "left")
    )
    text = own_text(F.col("text"))
    return result.select(
        F.coalesce("thread_conv_id", "conv_id").alias("thread_conv_id"),
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        "conv_id",
        "turn",
        "reply_conv_id",
        "reply_turn",
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text).alias("message"),
    ).orderBy("thread_conv_id", "thread_turn", "depth", "conv_id", "turn")


def _sources(quoted: DataFrame, own: DataFrame, hot: Hot) -> DataFrame:
    """The quoted passages whose original is found, with the message that it is in.

    Originals are reduced to one message per passage before the join, so a passage that very many
    messages hold makes one row, and only its quotations are many; those of `hot` ones are split.
    """
    here = own.groupBy("conv_id", "hash").agg(F.min("turn").alias("here"))
    anywhere = own.groupBy("hash").agg(F.min(F.struct(*_MESSAGE)).alias("anywhere"))
    met = quoted.join(here, ["conv_id", "hash"], "left")
    met = salted_join(met, anywhere, ["hash"], hot, "left")
    inside = F.col("here") < F.col("turn")
    before = F.col("anywhere") < F.struct(*_MESSAGE)
    source = F.when(inside, F.struct(F.col("conv_id"), F.col("here").alias("turn"))).when(
        before, F.col("anywhere")
    )
    return met.select(*_MESSAGE, "level", source.alias("source")).filter("source IS NOT NULL")


def _replies(linked: DataFrame) -> DataFrame:
    counts = linked.groupBy(*_MESSAGE, "level", "source").agg(F.count(F.lit(1)).alias("n"))
    inside = F.col("source.conv_id") == F.col("conv_id")
    rank = F.struct((-F.col("level")).alias("level"), "n", inside.alias("inside"), "source")
    best = counts.groupBy(*_MESSAGE).agg(F.max(rank).alias("best"))
    return best.select(
        *_MESSAGE,
        F.col("best.source.conv_id").alias("reply_conv_id"),
        F.col("best.source.turn").alias("reply_turn"),
    )


def _threads(rows: DataFrame, replies: DataFrame, stage: Stage) -> DataFrame:
    """For each message the message replied to, the first of its thread and the depth.

    Every round doubles the replies that are followed, of the messages that have not yet reached
    the first of their thread. A reply is later than what it answers, so the rounds end, after the
    logarithm of the longest chain.
    """
    known = rows.dropna(subset=_MESSAGE).select(*_MESSAGE).distinct()
    start = known.join(replies, _MESSAGE, "left").withColumns(
        {
            "thread_conv_id": F.coalesce("reply_conv_id", "conv_id"),
            "thread_turn": F.coalesce("reply_turn", "turn"),
            "depth": F.col("reply_turn").isNotNull().cast("int"),
        }
    )
    start = stage.keep(start, "replies")
    columns = start.columns
    done, under_way = start.filter("depth = 0"), start.filter("depth > 0")
    while not under_way.isEmpty():
        onward = done.union(under_way).filter("depth > 0").select(
            F.col("conv_id").alias("thread_conv_id"),
            F.col("turn").alias("thread_turn"),
            F.col("thread_conv_id").alias("_conv_id"),
            F.col("thread_turn").alias("_turn"),
            F.col("depth").alias("_depth"),
        )
        met = under_way.join(onward, ["thread_conv_id", "thread_turn"], "left")
        met = met.select(
            *_MESSAGE,
            "reply_conv_id",
            "reply_turn",
            F.coalesce("_conv_id", "thread_conv_id").alias("thread_conv_id"),
            F.coalesce("_turn", "thread_turn").alias("thread_turn"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
            F.col("_depth").isNotNull().alias("went_on"),
        )
        met = stage.keep(met, "replies")
        done = done.union(met.filter("NOT went_on").select(columns))
        under_way = met.filter("went_on").select(columns)
    return done
