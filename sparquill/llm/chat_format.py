"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns of
one role are merged with array functions, and the pieces are joined to one text:

    <|im_start|>ROLE \\n TEXT [<|im_next|> TEXT ...] <|im_end|> \\n

Every control string begins with `<|`. Inside roles and texts a backslash becomes
two, `<|` becomes `<\\|`, and in roles a line feed becomes `\\n`; so no control
string occurs there, and one left-to-right pass undoes it. `<|im_next|>` keeps the
border between merged turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def _unrole(c: Column) -> Column:
    # \n is a line feed, unless its backslash belongs to a pair.
    return unescape(F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id of turns (conv_id, turn, role, text).

    Returns conv_id, formatted: string, and mask: array<struct<length, loss>>, an
    entry per turn in order with the length of its escaped text and whether that
    text counts for the loss (the turns of `loss_role`).

    Turns are sorted by turn (nulls first), then role, then text, so ties and
    repeated rows have one order; each row is a turn. A null text or role is empty.
    Null conv_id is a conversation like any other. Other columns are ignored. An
    empty table gives an empty result. A conversation is one row of the result,
    and so must fit into one.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    sorted_ = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    # Where runs of one role begin; each run ends where the next begins.
    begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("ts", i)["role"] != F.get("ts", i - 1)["role"]))
    begun = sorted_.select("conv_id", "ts", begins.alias("b"))
    runs = F.transform(F.col("b"), lambda at, k: F.slice("ts", at + 1, F.coalesce(F.get("b", k + 1), n) - at))
    block = lambda run: F.concat(F.lit(START), _role(F.get(run, F.lit(0))["role"]), F.lit("\n"), F.array_join(F.transform(run, lambda t: escape(t["text"])), NEXT), F.lit(END + "\n"))
    mask = F.transform("ts", lambda t: F.struct(F.length(escape(t["text"])).cast("long").alias("length"), (t["role"] == loss_role).alias("loss")))
    return begun.select("conv_id", F.array_join(F.transform(runs, block), "").alias("formatted"), mask.alias("mask"))


def read_conversations(formatted: DataFrame) -> DataFrame:
    """The inverse of format_conversations: adds turns, array<struct<role, text, loss>>.

    The turns come from the formatted text alone; the mask must fit them, else the
    query fails.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    role = lambda b: F.substring_index(b, "\n", 1)
    texts = lambda b: F.split(F.substring_index(F.substr(b, F.length(role(b)) + 2), END, 1), r"<\|im_next\|>", -1)
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(_unrole(role(b)).alias("role"), t.alias("text")))))
    fits = lambda t, i: F.when(F.length(t["text"]) == F.get("mask", i)["length"], F.get("mask", i)["loss"]).otherwise(F.raise_error(F.lit("mask and text differ")).cast("boolean"))
    read = lambda t, i: F.struct(t["role"].alias("role"), unescape(t["text"]).alias("text"), fits(t, i).alias("loss"))
    return formatted.withColumn("parsed", turns).withColumn("turns", F.transform("parsed", read)).drop("parsed")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, digests of what its output reads back as."""
    lost = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_conversations(formatted).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
