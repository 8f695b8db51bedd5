"""Chat formatting from event logs, with DataFrame functions only.

A log has one row an event: conv_id, seq, message, kind, role, text. It is dealt by conversation and message (a log that is dealt
by conversation already, as table_log's is, does not move again), and the events of each message are sorted by seq and folded:

- open starts the message (its text may hold a beginning), delta appends text to it;
- edit replaces its text, and later deltas append to that;
- regenerate starts it anew and drops the messages after it that were begun before: the chat goes on from there;
- delete removes it, unless a later open, edit or regenerate brings it back.

Messages follow each other in the order of their key. render marks turns by a template's control strings and escapes control
strings inside roles and texts by a backslash after their first character (one more where there are some already), which
read_back takes off again. An escaped text holds no control string, and none begins in one piece and ends in another, since
the first characters of control strings stand nowhere else in them. The mask is the part of each turn that is trained on.

A conversation is one row of the result, so it is bounded by what a row holds (2 GB); its events need not be: they are
folded message by message, and the windows over a conversation's messages spill.

Defined cases: null roles and texts are empty. Events that are equal in every column, as from repeated delivery, count once;
different ones with the same seq are taken in the order of kind, role and text. A null seq comes before all others, a null
message or conv_id is a key like any other, other kinds and null ones are left out. A message without an open begins with its
first event. Other columns are ignored whatever their names; empty logs give no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("open", "delta", "edit", "regenerate", "delete")
FIRST = -(2**63)


@dataclass(frozen=True)
class Template:
    """How turns are marked: start, role, middle, text, end. guarded: other control strings that texts may not hold unescaped."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    guarded: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")

    def __post_init__(self) -> None:
        strings = self.strings()
        openers = {s[0] for s in strings}
        if any(len(s) < 2 or "\\" in s or openers & set(s[1:]) for s in strings) or len({self.start, self.middle, self.end}) < 3:
            raise ValueError("control strings must differ, and their first characters and backslashes must stand nowhere else in them")

    def strings(self) -> tuple[str, ...]:
        return (self.start, self.middle, self.end, *self.guarded)

    def pattern(self, less: int = 0) -> str:
        """Groups: an opener, and backslashes (the first one of less outside the group) with the rest of a control string."""
        openers = "".join(sorted({re.escape(s[0]) for s in self.strings()}))
        rests = "|".join(dict.fromkeys(re.escape(s[1:]) for s in sorted(self.strings(), key=len, reverse=True)))
        return rf"([{openers}])" + r"\\" * less + rf"(\\*(?:{rests}))"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(F.coalesce(text, F.lit("")), self.pattern(), r"$1\\$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern(1), "$1$2")


TEMPLATE = Template()


def fold(events: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, message, role, text."""
    event, kind = F.struct("seq", "kind", "role", "text"), F.col("kind")
    log = events.select("conv_id", "message", F.coalesce(F.col("seq").cast("long"), F.lit(FIRST)).alias("seq"), "kind", "role", "text").where(kind.isin(*KINDS))
    messages = log.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_set(event)).alias("log"), F.max(F.when(kind.isin("open", "edit", "regenerate"), event)).alias("first"), F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.max(F.when(kind == "regenerate", F.col("seq"))).alias("restart"), F.max(F.when(kind == "delete", F.col("seq"))).alias("gone"),
    ).withColumn("began", F.coalesce("first.seq", F.lit(FIRST)))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    messages = messages.withColumn("restarted", F.max("restart").over(before)).where("(gone is null or gone < began) and (restarted is null or restarted < began)")
    parts = F.filter("log", lambda e: (F.col("first").isNull() | (e >= F.col("first"))) & (e["kind"] != "delete"))
    text = F.array_join(F.transform(parts, lambda e: F.coalesce(e["text"], F.lit(""))), "")
    return messages.select("conv_id", "message", "role", text.alias("text"))


def render(messages: DataFrame, template: Template = TEMPLATE, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, turns: for each turn where it starts and stops in formatted, and of which part the loss is taken
    (loss_start = loss_stop: none). All in code points from 0; stops are exclusive."""
    rows = messages.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), template.escape(F.col("text")).alias("body"))
    head = F.concat(F.lit(template.start), template.escape(F.col("role")), F.lit(template.middle))
    rows = rows.select("conv_id", "message", "role", head.alias("head"), "body").withColumn("turn", F.concat("head", "body", F.lit(template.end)))
    upto = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("turn").cast("long")).over(upto)).withColumn("start", F.col("stop") - F.length("turn"))
    loss = F.col("start") + F.length("head")
    span = F.struct("start", "stop", loss.alias("loss_start"), F.when(F.col("role").isin(*trained), loss + F.length("body")).otherwise(loss).alias("loss_stop"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "turn", span.alias("span")))).alias("all"))
    return out.select("conv_id", F.array_join(F.transform("all", lambda t: t["turn"]), "").alias("formatted"), F.transform("all", lambda t: t["span"]).alias("turns"))


def read_back(rendered: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, formatted and messages (role, text, loss: the text under the mask; all unescaped), parsed from formatted and turns."""
    pieces = F.split("formatted", re.escape(template.start), -1)
    zipped = F.arrays_zip(F.slice(pieces, F.lit(2), F.size("turns")).alias("piece"), F.col("turns").alias("span"))
    skip = len(template.start)

    def parse(z: Column) -> Column:
        piece, span = z["piece"], z["span"]
        inner = F.substring_index(piece, template.end, 1)
        under = F.substring(piece, (span["loss_start"] - span["start"] - skip + 1).cast("int"), (span["loss_stop"] - span["loss_start"]).cast("int"))
        role = F.substring_index(inner, template.middle, 1)
        text = F.substring(inner, F.length(role) + len(template.middle) + 1, F.length(inner))
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"), template.unescape(under).alias("loss"))

    return rendered.select("conv_id", "formatted", zipped.alias("zipped")).select("conv_id", "formatted", F.transform("zipped", parse).alias("messages"))


def format_chats(events: DataFrame, template: Template = TEMPLATE, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    return render(fold(events), template, trained)


def table_log(conversations: DataFrame) -> DataFrame:
    """The log of a table of turns (conv_id, turn, role, text), as a stream of it has it: every row opens a message and sends its
    lines as deltas. Rows follow by turn (null first), then role and text; repeated rows are turns of their own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    opened = F.struct(F.lit("open").alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.lit(None).cast("string").alias("text"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=\n)", -1), lambda x: F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), x.alias("text")))
    out = rows.select("conv_id", "message", F.posexplode(F.concat(F.array(opened), lines)).alias("at", "event"))
    return out.select("conv_id", (F.col("message") * (1 << 32) + F.col("at")).alias("seq"), "message", "event.kind", "event.role", "event.text")


def digests(read: DataFrame) -> DataFrame:
    """Per conversation of read_back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    joined = lambda part: F.array_join(F.transform("messages", part), "")
    out = read.select("conv_id", "formatted", "messages", joined(lambda m: m["loss"]).alias("loss"))
    return out.select(
        "conv_id", F.size("messages").cast("long").alias("n_turns"), F.sha2(joined(lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))).cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
