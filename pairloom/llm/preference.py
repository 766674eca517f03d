"""Preference pairs from chosen and rejected conversations, with built-in functions only.

A pair has two sides, each a sequence of turns. The longest common prefix of turns is rendered once as the prompt; what
follows on each side is that side's completion, with the spans of characters a model is trained on (the contents of the
assistant's turns and their end mark, not their headers and not the user's turns).

Rows are (pair_id, side, turn, role, text). Several rows of one turn on one side: equal ones count once, different ones
are messages of that turn in the order of role and text. Null role or text: empty. Null turn: before all others. Null
pair_id: a pair of its own. A side without rows: an empty conversation. Sides that are equal throughout: the whole
conversation is the prompt, both completions are empty. Only the named columns are read, so extra columns do not matter.
Empty input: empty result. A pair is as long as its conversations; nothing is grouped by anything wider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIDES = ("chosen", "rejected")
HEADER = "<|{role}|>\n"
END = "<|end|>\n"


def rendered_header(role: Column) -> Column:
    before, after = HEADER.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after))


def preference_pairs(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, n_prompt_turns, prompt, and per side the completion and its trained spans.

    Spans are ``start:end`` in characters of the completion, end exclusive, joined by commas.
    """
    message = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = [
        F.sort_array(F.collect_set(F.when(F.col("side") == side, message))).alias(side) for side in SIDES
    ]
    aligned = turns.where(F.col("side").isin(*SIDES)).groupBy("pair_id", "turn").agg(*sides)
    in_order = Window.partitionBy("pair_id").orderBy(F.col("turn").asc_nulls_first())
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A turn belongs to the prompt while no turn up to it differs.
    marked = aligned.withColumn(
        "shared", F.max((~F.col("chosen").eqNullSafe(F.col("rejected"))).cast("int")).over(so_far) == 0)
    parts = marked.select(
        "pair_id", "turn",
        F.explode(
            F.when(F.col("shared"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("messages"))))
            .otherwise(F.array(*[F.struct(F.lit(s).alias("part"), F.col(s).alias("messages")) for s in SIDES]))
        ).alias("p"),
    ).select("pair_id", "turn", "p.part", F.posexplode_outer("p.messages").alias("at", "m"))
    header, body = rendered_header(F.col("m.role")), F.concat(F.col("m.text"), F.lit(END))
    ordered = Window.partitionBy("pair_id", "part").orderBy(F.col("turn").asc_nulls_first(), "at")
    segments = (
        parts.withColumn("segment", F.when(F.col("m").isNull(), "").otherwise(F.concat(header, body)))
        .withColumn("to", F.sum(F.length("segment")).over(
            ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("span", F.when(
            F.col("m.role") == trained_role,
            F.concat_ws(":", (F.col("to") - F.length(body)).cast("string"), F.col("to").cast("string"))))
    )

    def joined(part: str, value: str, by: str) -> Column:
        kept = F.when(F.col("part") == part, F.struct(F.col("turn"), F.col("at"), F.col(value).alias("v")))
        return F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda s: s["v"]), by)

    return segments.groupBy("pair_id").agg(
        F.count_distinct(F.when(F.col("part") == "prompt", F.coalesce(F.col("turn"), F.lit(-1)))).alias("n_prompt_turns"),
        joined("prompt", "segment", "").alias("prompt"),
        joined("chosen", "segment", "").alias("chosen"),
        joined("rejected", "segment", "").alias("rejected"),
        joined("chosen", "span", ",").alias("chosen_spans"),
        joined("rejected", "span", ",").alias("rejected_spans"),
    )


def branched(conversations: DataFrame) -> DataFrame:
    """Pairs derived from a table of conversations: each conversation is chosen, and rejected is the same conversation
    whose turns from its last assistant turn on are those of the conversation with the next id."""
    plain = conversations.select("conv_id", "turn", "role", "text")
    last = plain.where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("of")).agg(
        F.max("turn").alias("branch"))
    chosen = plain.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    kept = (
        plain.join(last, F.col("conv_id") == F.col("of"), "left")
        .where(F.col("branch").isNull() | (F.col("turn") < F.col("branch")))
        .select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    )
    other = (
        plain.join(last, F.col("conv_id") == F.col("of") + 1)
        .where(F.col("turn") >= F.col("branch"))
        .select(F.col("of").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    )
    return chosen.unionByName(kept).unionByName(other)
