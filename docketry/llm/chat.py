"""Chat formatting from an event log, with DataFrame functions only.

An event is (conv_id, seq, turn, kind, role, text). Within a conversation events
are sorted by turn and sequence and folded into final messages:

``message``     opens a message of its own at its turn
``delta``       appends to the message last opened at its turn (any unknown kind too)
``edit``        replaces the text that message has so far
``regenerate``  the same, and takes back whatever later turns held until then

Messages are then rendered with a template. Control strings inside roles and
texts are escaped reversibly, and spans say which characters are trained on.

Scale: a conversation is cut into blocks of ``block_turns`` turns; sorting,
folding and rendering work on (conversation, block), so a conversation with a
third of all events is spread over the cluster. Only the newest regeneration
of each block, one number, is combined per conversation. The rendered output
keeps one row per block (a *part*); parts joined in order are the conversation.

Edge cases: null kind is ``message``; null role and text are empty; null seq
and null turn sort first; a null conv_id is a conversation like any other;
repeated events count as often as they occur, ties are sorted by kind, role and
text; a delta before any message opens one; no events give no rows; other
columns of the log are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("message", "regenerate", "edit")
FIRST = -(2**62)  # where null sorts; turns are larger


@dataclass(frozen=True)
class Template:
    """Marks around a turn, and further strings that texts must not contain.

    No control string may end with the beginning of another one.
    """

    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    reserved: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    trained_roles: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        return (self.turn, self.text, self.end, *self.reserved)

    def pattern(self, escaped: bool) -> str:
        """First character, backslashes (one more if escaped), the other characters."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        tails = "|".join(re.escape(c[1:]) for c in self.controls)
        return rf"([{heads}])(\\*)" + (r"\\" if escaped else "") + f"({tails})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.pattern(False)), F.lit(r"$1$2\\$3"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, F.lit(self.pattern(True)), F.lit("$1$2$3"))


DEFAULT = Template()


def fold_events(events: DataFrame, block_turns: int = 64) -> DataFrame:
    """Final messages: (conv_id, block, turn, opened, role, text)."""
    log = events.select(
        F.col("conv_id"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(FIRST)).cast("long").alias("block"),
        F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"),
        F.coalesce(F.col("seq").cast("long"), F.lit(FIRST)).alias("seq"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    regenerated = F.when(F.col("kind") == "regenerate", F.col("seq"))
    earlier_blocks = (
        log.groupBy(F.col("conv_id").alias("of_conv"), F.col("block").alias("of_block"))
        .agg(F.max(regenerated).alias("in_block"))
        .withColumn(
            "before_block",
            F.max("in_block").over(
                Window.partitionBy("of_conv")
                .orderBy("of_block")
                .rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .where(F.col("before_block").isNotNull())
        .drop("in_block")
    )
    block = Window.partitionBy("conv_id", "block")
    at_turn = Window.partitionBy("conv_id", "block", "turn").orderBy(
        "seq", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), "role", "text"
    )
    message = Window.partitionBy("conv_id", "block", "turn", "opened")
    resets = F.col("kind").isin(*KINDS)
    return (
        log.join(
            earlier_blocks,
            F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("block") == F.col("of_block")),
            "left",
        )
        .withColumn(
            "taken_back",
            F.greatest(
                "before_block",
                F.max(regenerated).over(
                    block.orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
                ),
            ),
        )
        .where(F.col("taken_back").isNull() | (F.col("seq") >= F.col("taken_back")))
        .withColumn("place", F.row_number().over(at_turn))
        .withColumn(
            "opened",
            F.sum((F.col("kind") == "message").cast("int")).over(
                at_turn.rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .withColumn("last_reset", F.max(F.when(resets, F.col("place"))).over(message))
        .groupBy("conv_id", "block", "turn", "opened")
        .agg(
            F.max_by("role", F.when(F.col("role") != "", F.col("place"))).alias("role"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("last_reset").isNull() | (F.col("place") >= F.col("last_reset")),
                        F.struct("place", "text"),
                    )
                )
            ).alias("pieces"),
        )
        .select(
            "conv_id",
            "block",
            "turn",
            "opened",
            F.coalesce("role", F.lit("")).alias("role"),
            F.array_join(F.col("pieces.text"), "").alias("text"),
        )
    )


def render(messages: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Parts: (conv_id, part, n_turns, formatted, loss).

    ``loss`` holds (start, length) in characters of ``formatted``: the escaped
    texts of the trained roles.
    """
    order = (
        Window.partitionBy("conv_id", "block")
        .orderBy("turn", "opened")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    number = Window.partitionBy("conv_id", "block").orderBy("turn", "opened")
    head = F.concat(F.lit(template.turn), template.escape(F.col("role")), F.lit(template.text))
    return (
        messages.withColumn("head", head)
        .withColumn("body", template.escape(F.col("text")))
        .withColumn(
            "length",
            F.char_length("head") + F.char_length("body") + F.lit(len(template.end)),
        )
        .withColumn("start", F.coalesce(F.sum("length").over(order), F.lit(0)))
        .withColumn("nth", F.row_number().over(number))
        .groupBy("conv_id", F.col("block").alias("part"))
        .agg(
            F.count("*").alias("n_turns"),
            F.sort_array(F.collect_list(F.struct("nth", "head", "body"))).alias("turns"),
            F.sort_array(
                F.collect_list(
                    F.when(
                        F.col("role").isin(*template.trained_roles),
                        F.struct(
                            (F.col("start") + F.char_length("head")).alias("start"),
                            F.char_length("body").alias("length"),
                        ),
                    )
                )
            ).alias("loss"),
        )
        .select(
            "conv_id",
            "part",
            "n_turns",
            F.array_join(
                F.transform(
                    "turns", lambda t: F.concat(t["head"], t["body"], F.lit(template.end))
                ),
                "",
            ).alias("formatted"),
            "loss",
        )
    )


def format_chat(
    events: DataFrame, template: Template = DEFAULT, block_turns: int = 64
) -> DataFrame:
    """Fold an event log and render it."""
    return render(fold_events(events, block_turns), template)


def read_turns(formatted: Column, template: Template = DEFAULT) -> Column:
    """array<struct<role, text>> that a rendered part holds."""
    pieces = F.split(formatted, re.escape(template.turn))
    return F.transform(
        F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))),
        lambda p: F.struct(
            template.unescape(F.substring_index(p, template.text, 1)).alias("role"),
            template.unescape(
                F.substring_index(F.substring_index(p, template.text, -1), template.end, 1)
            ).alias("text"),
        ),
    )


def read_trained_text(
    formatted: Column, loss: Column, template: Template = DEFAULT
) -> Column:
    """All text under the loss spans, unescaped, in order."""
    return F.array_join(
        F.transform(
            loss,
            lambda s: template.unescape(
                F.substring(formatted, (s["start"] + 1).cast("int"), s["length"])
            ),
        ),
        "",
    )


def conversation_digests(parts: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and hashes of every conversation, read back from its parts."""
    read = parts.select(
        "conv_id",
        "part",
        "n_turns",
        F.char_length("formatted").alias("chars"),
        read_turns(F.col("formatted"), template).alias("turns"),
        read_trained_text(F.col("formatted"), F.col("loss"), template).alias("trained"),
    ).select(
        "conv_id",
        "part",
        F.size("turns").cast("long").alias("n"),
        "chars",
        F.array_join(
            F.transform(
                "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
            ),
            "",
        ).alias("turns"),
        "trained",
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.sort_array(F.collect_list(F.struct("part", "turns", "trained"))).alias("parts"),
    )
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.col("parts.turns"), ""), 256).alias("turns_sha256"),
        F.char_length(F.array_join(F.col("parts.trained"), "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(F.col("parts.trained"), ""), 256).alias("loss_sha256"),
        "formatted_chars",
    )
