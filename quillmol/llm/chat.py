"""Preference formatting: the shared turns of two conversations once, then both completions with loss masks.

DataFrame functions only. One shuffle brings the turns of a pair together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADER = "<|{}|>\n"
END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column) -> Column:
    """Runs of flag:characters; 1 marks what the loss counts: what the assistant says and its end mark."""

    def runs(t):
        h, b = F.length(_header(t)).cast("string"), F.length(_body(t)).cast("string")
        trained = F.concat(F.lit("0:"), h, F.lit(",1:"), b)
        masked = F.concat(F.lit("0:"), (F.length(_header(t)) + F.length(_body(t))).cast("string"))
        return F.when(t["role"] == TRAINED_ROLE, trained).otherwise(masked)

    return F.array_join(F.transform(turns, runs), ",")


def preference_pairs(turns: DataFrame, pair: str = "pair_id", side: str = "side") -> DataFrame:
    """One row per pair from rows (pair, side 0 chosen or 1 rejected, turn, role, text).

    The prompt is the longest common prefix of turns, equal in role and text; the rest of each side is
    its completion with a mask. Null role or text counts as empty. Turns go by (turn, role, text), so repeated rows have a
    fixed place and stay. A pair with one side only has an empty prompt and an empty other completion.
    Rows with a null pair or side belong to no pair and give nothing; a null turn comes first. Other
    columns are left out. An empty table gives an empty table.
    """
    clean = turns.select(
        F.col(pair).alias("pair_id"),
        F.col(side).cast("int").alias("_side"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("_t"),
    ).where("pair_id is not null and _side in (0, 1)")
    both = clean.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("_side") == 0, F.col("_t")))).alias("_c"),
        F.sort_array(F.collect_list(F.when(F.col("_side") == 1, F.col("_t")))).alias("_r"),
    )
    shorter = F.least(F.size("_c"), F.size("_r"))
    differs = lambda c, r: ~((c["role"] == r["role"]) & (c["text"] == r["text"]))
    same = F.transform(F.arrays_zip(F.slice("_c", 1, shorter).alias("c"), F.slice("_r", 1, shorter).alias("r")), lambda z: differs(z["c"], z["r"]))
    first = F.array_position(same, True)
    both = both.withColumn("_k", F.when(first > 0, first - 1).otherwise(shorter).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("_k") + 1, F.size(c) - F.col("_k"))
    return both.select(
        "pair_id",
        F.col("_k").cast("long").alias("n_prompt_turns"),
        (F.size("_c") - F.col("_k")).cast("long").alias("n_chosen_turns"),
        (F.size("_r") - F.col("_k")).cast("long").alias("n_rejected_turns"),
        _render(F.slice("_c", F.lit(1), F.col("_k"))).alias("prompt"),
        _render(rest("_c")).alias("chosen"),
        _render(rest("_r")).alias("rejected"),
        _mask(rest("_c")).alias("chosen_mask"),
        _mask(rest("_r")).alias("rejected_mask"),
    )


def neighbour_pairs(conversations: DataFrame) -> DataFrame:
    """Pairs conversation 2k (chosen) with 2k + 1 (rejected): a pair has two conversations whatever their
    contents, so a first turn that many share makes no hot group."""
    c = F.col("conv_id").cast("long")
    return conversations.select(F.floor(c / F.lit(2)).cast("long").alias("pair_id"), F.pmod(c, F.lit(2)).cast("int").alias("side"), "turn", "role", "text")
