r"""Chat formatting (operator 5) by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only
its reply is under the loss. Where a conversation does not end with an assistant turn, a last
example without a target keeps the remaining turns, so nothing is lost.

The template, turn by turn (``role`` other than the three known ones, or null, which counts as
empty, is written out):

    system      <<SYS>> text <</SYS>>
    user        <s>[INST] text [/INST]
    assistant    text </s>
    other       [ROLE] role [/ROLE] text </s>

Marks stand alone or after a blank. A mark inside a text gets one more backslash before it than it
has, and loses one on the way back; so a mark after a backslash is always text, and one without is
always a mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")

#: The same as one expression (for Java's and RE2's syntax).
MARK_PATTERN = r"(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])"

#: One written turn: how it opens, its text, how it closes.
TURN_PATTERN = r"(?s)(<<SYS>>|<s>\[INST\]|\[ROLE\] .*? \[/ROLE\]|) (.*?) (<</SYS>>|\[/INST\]|</s>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*)" + MARK_PATTERN, r"\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)" + MARK_PATTERN, "$1$2")


def written(role: Column, text: Column) -> Column:
    """A turn in the template."""
    inner = escaped(text)
    return (
        F.when(role == "system", F.concat(F.lit("<<SYS>> "), inner, F.lit(" <</SYS>>")))
        .when(role == "user", F.concat(F.lit("<s>[INST] "), inner, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit(" "), inner, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [/ROLE] "), inner, F.lit(" </s>")))
    )


def expand(
    turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Examples: conv_id, example (from 0), whole (it holds all turns), formatted, and the loss
    mask ``loss_start``, ``loss_length`` in characters of ``formatted`` (null and 0 without a target).

    Turns are in the order of ``turn`` (null first), then role, then text; repeated rows are turns
    of their own; null texts and roles are empty; rows without a conversation are one. A conversation
    has to fit in a row, as each example holds all its context. An empty table gives no examples.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    last = F.size("turns") - 1
    placed = whole.select(
        "conv_id",
        F.transform("turns", lambda t: written(t["role"], t["text"])).alias("pieces"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("reply"),
        F.transform("turns", lambda t: F.length(escaped(t["text"]))).alias("inner"),
        last.alias("last"),
    )
    examples = placed.select(
        "conv_id", "pieces", "reply", "inner", "last",
        F.posexplode(F.filter(F.sequence(F.lit(0), "last"), lambda i: F.get("reply", i) | (i == F.col("last")))).alias("example", "at"),
    )
    formatted = F.array_join(F.slice("pieces", F.lit(1), F.col("at") + 1), "")
    length, target = F.get("inner", F.col("at")), F.get("reply", F.col("at"))
    return examples.select(
        "conv_id", "example", (F.col("at") == F.col("last")).alias("whole"), formatted.alias("formatted"),
        F.when(target, F.length(formatted) - length - F.length(F.lit(" </s>"))).alias("loss_start"),
        F.when(target, length).otherwise(0).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Conversations from their examples: conv_id, turns (role, text), replies in order, formatted_chars."""
    reply = unescaped(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    per_example = examples.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("loss_start").isNotNull(), F.struct("example", reply.alias("reply"))).alias("target"),
        F.when(F.col("whole"), F.col("formatted")).alias("all"),
    )
    grouped = per_example.groupBy("conv_id").agg(
        F.sum("chars").alias("formatted_chars"),
        F.transform(F.sort_array(F.collect_list("target")), lambda t: t["reply"]).alias("replies"),
        F.max("all").alias("all"),
    )
    opened, texts = (F.regexp_extract_all("all", F.lit(TURN_PATTERN), F.lit(g)) for g in (1, 2))
    name = lambda mark: (
        F.when(mark == "", "assistant").when(mark == "<<SYS>>", "system").when(mark == "<s>[INST]", "user")
        .otherwise(unescaped(F.regexp_extract(mark, r"(?s)^\[ROLE\] (.*) \[/ROLE\]$", 1)))
    )
    return grouped.select(
        "conv_id", "formatted_chars", "replies",
        F.zip_with(opened, texts, lambda m, t: F.struct(name(m).alias("role"), unescaped(t).alias("text"))).alias("turns"),
    )
