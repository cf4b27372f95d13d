"""Preference formatting: the common turns of a chosen and a rejected conversation once as prompt, then two completions with masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands around a turn. A text that holds one of these marks has a blank put into it.
OPEN, CLOSE = "<|turn|>", "<|end|>"
#: The role whose words count for the loss.
SPEAKER = "assistant"


def turns(rows: DataFrame, key: str = "conv_id", *more: str) -> DataFrame:
    """Conversations (id, turns: array of role and text in order of turn) from rows key, turn, role, text; ``more`` columns that depend on the key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark.replace("|", "| ", 1)))
    role = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    one = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    kept = rows.where(F.col(key).isNotNull() & F.col("turn").isNotNull())
    order = F.array_sort(F.collect_set(one))
    return kept.groupBy(*more, F.col(key).alias("id")).agg(order.alias("turns")).select(*more, "id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common from their first on."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(equal, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(equal)).cast("int")


def _render(part: Column) -> Column:
    return F.array_join(F.transform(part, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def _mask(part: Column) -> Column:
    """Character spans [begin, end) of the rendered part that count: what the speaker says and the end mark."""
    extra = len(OPEN) + 1
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + extra + F.length(t["role"])
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == SPEAKER, F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(part, state, step, lambda s: s["spans"])


def pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per id that both sides (as ``turns`` gives them) have: id, shared_turns, prompt, and for either side completion and mask.

    The prompt is the longest common prefix of turns, rendered once; a completion is the rest of its conversation. A mask holds the spans of
    the completion's characters that count for the loss. Conversations that are equal give no row, nor does an id that one side lacks.
    Where one conversation begins the other, its completion and mask are empty. Null texts are empty, null roles read "unknown", rows
    with a null id or turn are left out, repeated rows count once, and several texts of one turn follow each other by role and text. Columns other
    than key, turn, role and text are not read. Texts may be of any length. Empty tables give no rows.
    """
    return formatted(chosen.select("id", F.col("turns").alias("c")).join(rejected.select("id", F.col("turns").alias("r")), "id"))


def formatted(both: DataFrame) -> DataFrame:
    """``pairs`` of rows that hold both sides: id, c and r."""
    both = both.withColumn("shared_turns", common(F.col("c"), F.col("r")))
    rest = {x: F.slice(x, F.col("shared_turns") + 1, F.greatest(F.size(x) - F.col("shared_turns"), F.lit(0))) for x in "cr"}
    both = both.where((F.col("shared_turns") < F.size("c")) | (F.col("shared_turns") < F.size("r")))
    prompt = F.slice("c", F.lit(1), F.col("shared_turns"))
    return both.select(
        "id", "shared_turns", _render(prompt).alias("prompt"),
        _render(rest["c"]).alias("chosen"), _mask(rest["c"]).alias("chosen_mask"), _render(rest["r"]).alias("rejected"), _mask(rest["r"]).alias("rejected_mask"),
    )


#: Conversations whose ids differ in so many of their last bits alone lend each other turns.
NEIGHBOURS = 3


def lent(conversations: DataFrame) -> DataFrame:
    """Both sides (id, c, r) from conversations without ratings. The chosen side is the whole conversation; the rejected one departs from it at one
    of the speaker's turns (the one numbered id modulo their number) and goes on with the turns of the next conversation, from that one's own
    place on.

    The next one is that of the same 2 ** ``NEIGHBOURS`` ids with a turn by the speaker, after the last the first again; without another one the rejected side
    ends where it would depart. A conversation without a turn by the speaker has no row. Null ids and turns, repeated rows and other
    columns are treated as in ``turns``; texts may be of any length; an empty table gives no rows. One exchange.
    """
    rows = conversations.withColumn("conv_id", F.col("conv_id").cast("long")).where("conv_id is not null").withColumn("block", F.shiftright("conv_id", NEIGHBOURS))
    all_ = turns(rows.repartition("block"), "conv_id", "block")
    at = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == SPEAKER)
    known = all_.withColumn("at", at).where("size(at) > 0").withColumn("place", F.element_at("at", (F.pmod(F.col("id"), F.size("at")) + 1).cast("int")))
    block = known.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "turns", "place"))).alias("m"))
    each = block.select(F.inline(F.transform("m", lambda own, i: F.struct(own.alias("own"), F.when(F.size("m") > 1, F.get("m", (i + 1) % F.size("m"))).alias("other")))))
    before = F.slice("own.turns", F.lit(1), F.col("own.place") - 1)
    after = F.when(F.col("other").isNotNull(), F.concat(before, F.slice("other.turns", F.col("other.place"), F.size("other.turns")))).otherwise(before)
    return each.select(F.col("own.id").alias("id"), F.col("own.turns").alias("c"), after.alias("r"))
