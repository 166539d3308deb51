"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
Turns after the last assistant turn (or a conversation without one) give one more example that has no target, so that
no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template's control strings (fixed values). In texts and roles a backslash is doubled, and "<|" is written "<\|".
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns in order; ties in ``turn`` stand by role and text, null roles and texts are empty."""
    clean = conversations.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    return clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, target, text, loss_start, loss_end): the formatted examples.

    ``target`` is the number of the trainable turn, from 0, or null; the loss mask is the code points
    [loss_start, loss_end) of ``text`` (escaped as the text is). A row without a conversation id is in the
    conversation with the null id.
    """
    marked = turns_of(conversations).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"))).alias("m"))
    n = F.size("m")
    targets = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.col("m")[i]["role"] == "assistant")
    last = F.when(F.element_at("m", -1)["role"] == "assistant", F.array().cast("array<int>")).otherwise(F.array(F.lit(-1)))
    one = marked.select("conv_id", "m", F.posexplode(F.concat(targets, last)).alias("example", "_t"))
    size = F.when(F.col("_t") < 0, F.size("m")).otherwise(F.col("_t") + 1)
    text = F.array_join(F.transform(F.slice("m", F.lit(1), size), lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    built = one.select("conv_id", F.col("example").cast("long"), F.when(F.col("_t") >= 0, F.col("_t").cast("long")).alias("target"), text.alias("text"), F.when(F.col("_t") >= 0, F.char_length(F.col("m")[F.col("_t")]["body"])).alias("_body"))
    end = F.char_length("text") - len(END)
    return built.select("conv_id", "example", "target", "text", F.when(F.col("target").isNotNull(), end - F.col("_body")).cast("long").alias("loss_start"), F.when(F.col("target").isNotNull(), end).cast("long").alias("loss_end"))


def parse(text: Column) -> Column:
    """Array of (role, text) that a formatted example holds."""
    blocks = F.filter(F.split(text, r"<\|turn\|>"), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(unescape(F.substring_index(b, TEXT, 1)).alias("role"), unescape(F.regexp_extract(b, r"(?s)<\|text\|>(.*)<\|end\|>$", 1)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from the examples: turns, their digest, and what the loss masks hold."""
    loss = F.coalesce(unescape(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_end - loss_start as int))")), F.lit(""))
    per = examples.select("conv_id", "example", "text", loss.alias("loss"), F.char_length("text").cast("long").alias("chars"))
    whole = per.groupBy("conv_id").agg(F.max_by("text", "example").alias("text"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("l"), F.sum("chars").alias("formatted_chars"))
    read = whole.select("conv_id", parse(F.col("text")).alias("p"), F.array_join(F.transform("l", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
    return read.select(
        "conv_id", F.size("p").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("p", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
