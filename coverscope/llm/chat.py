"""Chat formatting: each dialogue once for every participant, who is the assistant there while others are named users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.runtime import salted_join

#: A rendering is one text, stored in parts of SEGMENT turns, so that no row grows with its dialogue. Where they have over CROWD messages, a part is of one
#: turn, and of some CROWD of its messages.
SEGMENT, CROWD = 256, 1024
SALTS = 16
SYSTEM = "system"
START, STOP = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """A text that can't be taken for a marker."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotated(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, perspective, part, start, text, train_spans, n_messages): for every participant of a dialogue its rendering with that speaker as assistant.

    Participants are the distinct roles of the dialogue but SYSTEM, whose messages keep their role. A message is
    START, the role (assistant; "user name=..." of others), a line break, its text, STOP, a line break. A rendering is the texts of its parts in order,
    with nothing between; nearly all have the one part 0. start: code points of the parts before. train_spans lists start:end of what the assistant
    says with its STOP, in code points of the whole rendering, comma-joined: the mask of the training targets. Messages go by turn (null first), and those of
    one turn by the md5 of role, line break and text; repeated rows are one message; a null role is the speaker "unknown"; a null text is empty, and
    very long ones are taken whole. A dialogue of system messages alone has no perspective; an empty table gives no rows; other columns aren't read.

    Messages are counted by turn before they are gathered, so that a part is of bounded size whatever shares a dialogue or a turn, and offsets
    are carried from part to part by a row for each. A set aggregate drops repeats before the shuffle.
    """
    own = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"), _clean(F.col(text_col).cast("string")).alias("body")
    )
    first = F.lit(-(2**63)).cast("long")  # before any other, as null is
    own = own.select(
        F.col("conv_id").isNull().alias("cn"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ck"), "conv_id", F.coalesce("turn", first).alias("turn"), F.coalesce(F.floor(F.col("turn") / SEGMENT).cast("long"), first).alias("seg"),
        F.md5(F.concat_ws("\n", "role", "body")).alias("h"), "role", "body",
    )
    key = ["cn", "ck"]
    counts = own.select(*key, "seg", "turn", "h").distinct().groupBy(*key, "seg", "turn").agg(F.count(F.lit(1)).alias("n"))
    crowded = counts.groupBy(*key, "seg").agg(F.sum("n").alias("n_seg")).where(F.col("n_seg") > CROWD)
    split = counts.join(crowded, [*key, "seg"], "left_semi").select(*key, "seg", "turn", F.ceil(F.col("n") / CROWD).alias("c"))
    placed = salted_join(own, split, [*key, "seg", "turn"], F.col("h"), SALTS, "left")
    place = F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * F.col("c") / 65536).cast("long")
    placed = placed.withColumn("t", F.when(F.col("c").isNotNull(), F.col("turn")).otherwise(first)).withColumn("b", F.coalesce(place, F.lit(0)))
    part = [*key, "seg", "t", "b"]
    gathered = placed.groupBy(*part, "conv_id").agg(F.sort_array(F.collect_set(F.struct("turn", "h", "role", "body"))).alias("m"))
    speakers = own.where(F.col("role") != SYSTEM).select(*key, F.col("role").alias("perspective")).distinct()
    both = salted_join(gathered, speakers, key, F.struct("seg", "t", "b"), SALTS)

    def head(role: Column) -> Column:
        name = F.when(role == F.col("perspective"), "assistant").when(role == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), _clean(role)))
        return F.concat(F.lit(START), name, F.lit("\n"))

    size = F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + F.length(head(x["role"])) + F.length(x["body"]) + len(STOP) + 1)
    sizes = both.select(*part, "perspective", size.alias("size"))
    order = Window.partitionBy(*key, "perspective").orderBy("seg", "t", "b")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = sizes.select(*part, "perspective", (F.row_number().over(order) - 1).cast("long").alias("part"), before.alias("start"))
    pieces = F.transform("m", lambda x: F.struct((x["role"] == F.col("perspective")).alias("train"), head(x["role"]).alias("head"), F.concat(x["body"], F.lit(STOP)).alias("said")))
    both = both.join(starts, [*part, "perspective"]).select("conv_id", "perspective", "part", "start", F.explode(F.array(pieces)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["said"], F.lit("\n"))), "")
    start = F.struct(F.col("start").alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["head"])
        b = a + F.length(x["said"])
        spans = F.when(x["train"], F.concat(acc["spans"], F.array(F.concat_ws(":", a.cast("string"), b.cast("string"))))).otherwise(acc["spans"])
        return F.struct((b + 1).cast("long").alias("at"), spans.alias("spans"))

    spans = F.aggregate("p", start, step, lambda acc: F.array_join(acc["spans"], ","))
    return both.select("conv_id", "perspective", "part", "start", text.alias("text"), spans.alias("train_spans"), F.size("p").cast("long").alias("n_messages"))
