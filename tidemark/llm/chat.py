"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is
trainable.  Everything is DataFrame functions.

Template.  A turn is ``<turn>role\\ntext</turn>\\n``.  Inside roles and texts ``\\`` is written ``\\b`` and ``<``
is written ``\\l`` (in roles also a line end as ``\\n``), so no control string can occur in them; after escaping, a
backslash is always followed by one of these letters, which makes the two replacements reversible one after
the other.

Defined results.  Null texts and roles are empty.  Rows of one conversation are ordered by turn, then role, then
text (a null turn first), so repeated turn numbers and repeated rows stay, in a fixed order.  A null
``conv_id`` is a conversation of its own.  Turns after the last assistant turn, or a conversation without one,
come as one last example without trainable text.  Texts of any length are
formatted whole; a conversation is one row while it is formatted, and each of its examples holds all turns before.
An empty table gives no example.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<turn>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, example_no, text, loss_start, loss_end, is_last).

    ``loss_start`` and ``loss_end`` are code points of the example's text, the end exclusive; equal where nothing
    is trainable.  ``is_last`` marks the example that holds every turn of its conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    convs = (
        turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select(
            "conv_id",
            F.transform("t", lambda x: F.concat(F.lit(OPEN), escape_role(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(CLOSE))).alias("pieces"),
            F.transform("t", lambda x: F.char_length(escape(x["text"])).cast("long")).alias("lengths"),
            F.filter(F.transform("t", lambda x, i: F.when(x["role"] == "assistant", i)), lambda i: i.isNotNull()).alias("targets"),
        )
    )
    n = F.size("pieces")
    # A conversation that doesn't end with an assistant turn gets -1: an example of all turns with no target.
    targets = F.when(F.element_at(F.concat(F.array(F.lit(-1)), F.col("targets")), -1) == n - 1, F.col("targets")).otherwise(F.concat("targets", F.array(F.lit(-1))))
    rows = convs.select("conv_id", "pieces", "lengths", F.posexplode(targets).alias("example_no", "target"))
    shown = F.when(F.col("target") < 0, n).otherwise(F.col("target") + 1)
    rows = rows.select("conv_id", F.col("example_no").cast("long").alias("example_no"), "target", (shown == n).alias("is_last"), F.array_join(F.slice("pieces", F.lit(1), shown), "").alias("text"), F.get("lengths", F.col("target")).alias("trained"))
    end = F.char_length("text").cast("long") - F.when(F.col("target") < 0, 0).otherwise(len(CLOSE))
    return rows.select("conv_id", "example_no", "text", (end - F.coalesce("trained", F.lit(0))).alias("loss_start"), end.alias("loss_end"), "is_last")


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: (conv_id, n_turns, turns, loss_text, formatted_chars).

    ``turns`` holds each turn's role and text, unescaped; ``loss_text`` is the text under the loss masks.
    """
    turn = lambda x: F.substring(x, F.lit(len(OPEN) + 1), F.char_length(x))
    parsed = F.transform(
        F.filter(F.split("text", CLOSE), lambda x: x != ""),
        lambda x: F.struct(
            unescape_role(F.substring_index(turn(x), "\n", 1)).alias("role"),
            unescape(F.substring(turn(x), F.instr(turn(x), F.lit("\n")) + 1, F.char_length(x))).alias("text"),
        ),
    )
    trained = unescape(F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int")))
    return (
        examples.select("conv_id", "example_no", F.when(F.col("is_last"), parsed).alias("turns"), trained.alias("trained"), F.char_length("text").cast("long").alias("chars"))
        .groupBy("conv_id")
        .agg(
            F.max("turns").alias("turns"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example_no", "trained"))), lambda x: x["trained"]), "").alias("loss_text"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", "loss_text", "formatted_chars")
    )
