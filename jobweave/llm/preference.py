"""Preference formatting: a shared prompt, rendered once, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.shared import small_side, stash


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("\n"))


def _first_differences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair, _first) of the pairs whose sides differ, with the first turn at which they do.

    A turn is what its rows add up to, however many they are: two sums over 64-bit hashes of role and
    text, positive for one side and negative for the other, and both zero where the sides agree.
    Only hashes travel, and they are added up before they do.
    """
    def signed(side: DataFrame, sign: int) -> DataFrame:
        parts = [p for c in ("role", "text") for p in (F.col(c).isNull(), F.col(c))]
        number = lambda *seed: (F.xxhash64(*seed, *parts).cast("decimal(38,0)") * sign).cast("decimal(38,0)")
        return side.select("pair_id", "turn", number().alias("_h"), number(F.lit(7)).alias("_g"), F.lit(sign).alias("_n"))

    sums = signed(chosen, 1).unionByName(signed(rejected, -1)).groupBy("pair_id", "turn").agg(
        *[F.sum(c).alias(c) for c in ("_h", "_g", "_n")])
    differ = sums.where("_h <> 0 or _g <> 0 or _n <> 0")
    return differ.groupBy(F.col("pair_id").alias("_pair")).agg(F.min(_place(F.col("turn"))).alias("_first"))


def _place(turn: Column) -> Column:
    """Order of turns with the null first, as a struct that compares."""
    return F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).cast("long").alias("turn"))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows (pair_id, side, turn, role, rendered, in_loss, tie), one for each rendered turn.

    Both inputs have pair_id, turn, role and text; other columns are left behind, whatever their names.
    Turns are compared by number: the prompt is every turn before the first number at which the two
    sides differ, and comes out once, with side ``prompt`` and outside the loss.  From there on
    each side's turns come out as ``chosen`` and ``rejected``; the loss covers those of the
    assistant.  Where one side ends first, its completion is empty; where both are the same,
    everything is prompt and ``tie`` is true.  Several rows of one number are one turn of several
    parts, repeated rows too; they are compared without regard to their order and come out as
    several rows.  A null turn number comes first; null role and text render as empty and equal each
    other only.  Pairs with one side only have an empty prompt.  Texts of any length are rendered
    whole; empty tables give no rows.

    No conversation is gathered: a pair may have any number of turns.
    """
    columns = ["pair_id", "turn", "role", "text"]
    chosen, rejected = chosen.select(*columns), rejected.select(*columns)
    first = small_side(stash(_first_differences(chosen, rejected), "first_differences"))

    def placed(side: DataFrame) -> DataFrame:
        rows = side.join(first, F.col("pair_id").eqNullSafe(F.col("_pair")), "left")
        return rows.withColumn("_shared", F.col("_first").isNull() | (_place(F.col("turn")) < F.col("_first")))

    own = placed(chosen).withColumn("side", F.when(F.col("_shared"), F.lit("prompt")).otherwise(F.lit("chosen")))
    other = placed(rejected).where(~F.col("_shared")).withColumn("side", F.lit("rejected"))
    return own.unionByName(other).select(
        "pair_id", "side", "turn", "role", render(F.col("role"), F.col("text")).alias("rendered"),
        ((F.col("side") != "prompt") & F.coalesce(F.col("role") == "assistant", F.lit(False))).alias("in_loss"),
        F.col("_first").isNull().alias("tie"))


def reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected sides made from plain conversations, all their turns on both sides.

    Chosen is a conversation as it is; in rejected one reply is that of its partner, the
    conversation whose number differs in the lowest bit.  It is the last reply of both, or in
    every other two partners, those whose numbers have the second bit, the first of both, so that what follows
    belongs to the completions.  Without a partner's reply the rejected side has none; a
    conversation without assistant turns is the same on both sides.  A reply is every
    assistant row of its turn; the largest text of a turn stands for it.  A null number has no partner.
    """
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    reply = F.struct("turn", "text")
    early = F.col("pair_id").bitwiseAND(F.lit(2)) != 0
    found = turns.where(F.col("role") == "assistant").groupBy("pair_id").agg(
        F.min(F.col("turn")).alias("_begin"), F.max_by("text", F.struct(-F.col("turn"), "text")).alias("_early"), F.max(reply).alias("_late"))
    found = stash(found.select(
        "pair_id", F.when(early, F.col("_begin")).otherwise(F.col("_late.turn")).alias("_at"),
        F.when(early, F.col("_early")).otherwise(F.col("_late.text")).alias("_reply")), "replies")
    partner = found.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("_partner"), F.col("_reply").alias("_other"), F.lit(True).alias("_has"))
    both = found.join(partner, F.col("pair_id") == F.col("_partner"), "left").select(F.col("pair_id").alias("_own"), "_at", "_other", "_has")
    both = small_side(stash(both, "reply_pairs"))
    rows = turns.join(both, F.col("pair_id") == F.col("_own"), "left")
    columns = ["pair_id", "turn", "role", "text"]
    is_reply = F.coalesce((F.col("turn") == F.col("_at")) & (F.col("role") == "assistant"), F.lit(False))
    rejected = rows.where(~is_reply | F.col("_has")).withColumn("text", F.when(is_reply, F.col("_other")).otherwise(F.col("text")))
    return turns, rejected.select(*columns)
