"""Preference formatting of chat data. DataFrame functions only.

A pair is two conversations, chosen and rejected, given as rows of turns. The longest common
prefix of turns (same role and text) is the prompt and is rendered once; what follows on
either side is its completion. Each turn is rendered as

    <|role|>\n text <|end|>\n

and the completions come with masks: character ranges of the completion that the loss counts,
which are the assistant turns' texts with their end marks. Everything else is masked.

A pair is one row of the result, so it is gathered as a row; that is bounded by the length of
the conversations themselves. Conversations are never compared with each other beyond the
given pairs.

Defined results: turns are ordered by number, then role and text, null numbers last; repeated
turn rows are turns of their own; a null role is rendered as ``unknown``, a null text as an
empty one, and both count as equal to what they are rendered as; a side without turns has an
empty completion; two equal conversations have two empty completions and ``differs`` false;
rows with a null pair or side belong to no pair and are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
LEARNED = "assistant"
SIDES = ("chosen", "rejected")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _mask(turns: Column) -> Column:
    """(start, end) of the learned parts in the rendered turns, in characters."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        head = state["at"] + F.length(turn["role"]) + len(OPEN) + len(CLOSE)
        stop = head + F.length(turn["text"]) + len(END)
        span = F.array(F.struct(head.alias("start"), stop.alias("end")))
        spans = F.when(turn["role"] == LEARNED, F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda state: state["spans"])


def format_preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: prompt, chosen, rejected, their masks, and how many turns each has."""
    c = F.col
    row = F.struct(c(f"`{turn}`").isNull().alias("none"), c(f"`{turn}`").alias("turn"),
                   F.coalesce(c(f"`{role}`"), F.lit("unknown")).alias("role"), F.coalesce(c(f"`{text}`"), F.lit("")).alias("text"))
    rows = (turns.where(c(f"`{pair}`").isNotNull() & c(f"`{side}`").isin(*SIDES))
            .select(c(f"`{pair}`").alias("pair_id"), c(f"`{side}`").alias("_side"), row.alias("_turn")))
    both = rows.groupBy("pair_id").agg(*[
        F.sort_array(F.collect_list(F.when(c("_side") == s, c("_turn")))).alias(f"_{s}") for s in SIDES])
    plain = [F.transform(f"_{s}", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias(f"_{s}") for s in SIDES]
    both = both.select("pair_id", *plain)
    # The first place where the two differ; a missing turn differs from any.
    same = F.zip_with("_chosen", "_rejected", lambda a, b: F.coalesce(
        (a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    apart = F.array_position(same, False)
    both = both.withColumn("_n", F.when(apart == 0, F.size(same)).otherwise(apart - 1).cast("int"))
    rest = {s: F.slice(f"_{s}", c("_n") + 1, F.size(f"_{s}")) for s in SIDES}
    both = both.select("pair_id", F.slice("_chosen", F.lit(1), c("_n")).alias("_prompt"), *[rest[s].alias(f"_{s}") for s in SIDES])
    return both.select(
        "pair_id", F.size("_prompt").alias("prompt_turns"), _joined(c("_prompt")).alias("prompt"),
        *[x for s in SIDES for x in (F.size(f"_{s}").alias(f"{s}_turns"), _joined(c(f"_{s}")).alias(s),
                                     _mask(c(f"_{s}")).alias(f"{s}_mask"))],
        (F.size("_chosen") + F.size("_rejected") > 0).alias("differs"))


def swapped_answers(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                    text: str = "text") -> DataFrame:
    """Pairs from plain conversations: each one is chosen; its rejected twin has the last answer
    of the conversation whose id differs in the lowest bit in place of its own last answer.

    A conversation's last answer is its assistant turn with the highest (turn, text), a null
    number being the lowest; of equal rows one. All its other turns, later ones too, are on
    both sides. Without an own answer both sides are equal; without a partner's answer the
    rejected side has the other turns only.
    """
    c = F.col
    rows = conversations.select(c(f"`{conv_id}`").alias("pair_id"), c(f"`{turn}`").alias("turn"), c(f"`{role}`").alias("role"),
                                c(f"`{text}`").alias("text")).where(c("pair_id").isNotNull())
    learned = F.coalesce(c("role") == LEARNED, F.lit(False))
    order = Window.partitionBy("pair_id").orderBy(F.desc(learned), F.desc_nulls_last("turn"), F.desc(F.coalesce("text", F.lit(""))))
    marked = rows.withColumn("_answer", learned & (F.row_number().over(order) == 1))
    shared = marked.where(~c("_answer")).select("pair_id", "turn", "role", "text", F.explode(F.array(*map(F.lit, SIDES))).alias("side"))
    last = marked.where("_answer").select("pair_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    other = (last.select(c("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), "text")
             .join(last.select("pair_id", "turn", "role"), "pair_id").select("pair_id", "turn", "role", "text"))
    return (shared.unionByName(last.withColumn("side", F.lit("chosen")))
            .unionByName(other.withColumn("side", F.lit("rejected"))))
