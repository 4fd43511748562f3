"""Chat formatting with Spark expressions only.

The rows of a conversation are collected as structs, sorted by turn, and cut into
messages: a message is a run of adjacent turns of one role. One message reads

    <s>[INST role]first turn<+>second turn</s>

with a line feed after it. The output is an array of segments (text, train): the
formatted text is their concatenation, and the loss mask covers the segments with
``train``, which hold the turns of the trained role and nothing else. Strings of
the template that stand inside a role or text are escaped by one backslash after
their first character; reading back takes one away, so nothing is lost.

A null role or text counts as empty. Rows of one turn number are ordered by role,
then text; a null turn comes first; repeated rows are turns each. A conversation
is one output row, so its turns meet in one task: that is the operator's result,
and the only data of unbounded size it gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, END_ROLE, JOIN, CLOSE = "<s>", "[INST ", "]", "<+>", "</s>\n"
# What the template, and usual readers of such templates, would take for control strings: an opening
# bracket, any backslashes, and the rest. The rest holds no opening bracket, so matches never overlap.
_HELD = r"([<\[])(\\*)(s>|/s>|\+>|INST\b|/INST\b)"
_FREED = r"([<\[])\\(\\*)(s>|/s>|\+>|INST\b|/INST\b)"


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, _HELD, r"$1\\$2$3")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, _FREED, "$1$2$3")


def _role(c: Column) -> Column:
    """Role inside its bracket: the closing bracket and the line feed are escaped as well."""
    return F.replace(F.replace(escaped(c), F.lit("%"), F.lit("%25")), F.lit("]"), F.lit("%5D"))


def _role_back(c: Column) -> Column:
    return unescaped(F.replace(F.replace(c, F.lit("%5D"), F.lit("]")), F.lit("%25"), F.lit("%")))


def format_chats(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, train>>, formatted: one row per conversation."""
    row = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    # Where a message begins: the role differs from that of the turn before.
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    starts = sorted_turns.withColumn("begins", begins)
    # Merge: each run of turns becomes (role, texts).
    bounds = F.arrays_zip(F.col("begins").alias("a"), F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("turns"))).alias("b"))
    run = lambda m: F.slice("turns", m["a"] + 1, m["b"] - m["a"])
    merged = starts.withColumn("bounds", bounds).withColumn("messages", F.transform("bounds", lambda m: F.struct(
        F.get("turns", m["a"])["role"].alias("role"), F.transform(run(m), lambda t: t["text"]).alias("texts"))))

    def segments(m: Column) -> Column:
        train = m["role"] == train_role
        head = F.concat(F.lit(OPEN + ROLE), _role(m["role"]), F.lit(END_ROLE))
        first = F.array(F.struct(head.alias("text"), F.lit(False).alias("train")))
        last = F.array(F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("train")))
        joint = F.struct(F.lit(JOIN).alias("text"), F.lit(False).alias("train"))
        texts = F.flatten(F.transform(m["texts"], lambda t, i: F.when(i == 0, F.array(F.struct(escaped(t).alias("text"), train.alias("train"))))
                                      .otherwise(F.array(joint, F.struct(escaped(t).alias("text"), train.alias("train"))))))
        return F.concat(first, texts, last)

    out = merged.select("conv_id", F.flatten(F.transform("messages", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: str | Column = "formatted") -> Column:
    """array<struct<role, text>> of every original turn, read from the formatted text alone."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    messages = F.filter(F.split(text, r"\Q" + CLOSE + r"\E"), lambda m: m != "")
    head = len(OPEN + ROLE)

    def turns(m: Column) -> Column:
        stop = F.instr(m, END_ROLE)
        role = _role_back(F.substring(m, F.lit(head + 1), stop - 1 - head))
        body = F.substring(m, stop + len(END_ROLE), F.length(m))
        return F.transform(F.split(body, r"\Q" + JOIN + r"\E"), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def trained_text() -> Column:
    """Everything under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter("segments", lambda s: s["train"]), lambda s: unescaped(s["text"])), "")
