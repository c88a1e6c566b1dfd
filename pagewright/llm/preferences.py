"""Operator 6: preference formatting of conversations.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; what follows
in either is its completion, with a mask of the spans that count for the loss: what the assistant says there, its end
mark included. A table of conversations gives pairs in two ways: conversations that open with the same turn, each with
the next one by id; and each conversation with itself, its last answer exchanged for a neighbour's. DataFrame functions
only. An opening that very many conversations share is dealt out in ranges of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import cut, partitions

#: Ids of one range: within it, rows of one opening are paired in one task; ranges are then chained by one row each.
RANGE = 1024
END = "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def loss_spans(turns: Column) -> Column:
    """[start, end) in code points of the rendered turns: text and end mark of each assistant turn."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        after = acc["at"] + F.length(rendered(t))
        head = acc["at"] + F.length(t["role"]) + 5
        span = F.array(F.struct(head.alias("start"), after.alias("end")))
        return F.struct(after.alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def conversations(turns: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, opening (hash), turns in order, said: how good it is.

    scores (conv_id, score), one row each, say so; a conversation without a score comes after all that have one. Without
    scores the length of what the assistant says, in code points, stands for them."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    c = c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    said = F.aggregate(F.filter("turns", lambda x: x["role"] == "assistant"), F.lit(0).cast("long"), lambda n, x: n + F.length(x["text"]))
    if scores is not None:
        c = c.join(scores.select("conv_id", F.col("score").cast("double").alias("score")), "conv_id", "left")
        said = F.coalesce("score", F.lit(float("-inf")))
    return c.select("conv_id", F.sha2(F.to_json(F.col("turns")[0]), 256).alias("opening"), "turns", said.alias("said"))


def opening_pairs(turns: DataFrame, span: int = RANGE, scores: DataFrame | None = None) -> DataFrame:
    """(x, y): chosen and rejected conversation, as structs of conv_id and turns.

    Of two conversations in a row (by id) with the same opening turn, the better one is chosen (see conversations), of
    equals the one with the smaller id. A conversation whose opening no other shares makes no pair. Ids, openings and
    what is said go through the pairing; the turns of those who made a pair are joined at the end."""
    whole = conversations(turns, scores)
    pairs = opening_numbers(whole.select("conv_id", "opening", "said"), span)
    of = lambda name: whole.select(F.col("conv_id").alias(name), F.struct("conv_id", "turns").alias(f"{name}_of"))
    same = lambda name: F.col(f"p.{name}").eqNullSafe(F.col(f"o.{name}"))
    found = pairs.alias("p").join(of("x").alias("o"), same("x")).select("p.x", "p.y", "o.x_of")
    return found.alias("p").join(of("y").alias("o"), same("y")).select(F.col("p.x_of").alias("x"), F.col("o.y_of").alias("y"))


def opening_numbers(c: DataFrame, span: int = RANGE) -> DataFrame:
    """(x, y): ids of chosen and rejected conversation, of (conv_id, opening, said)."""
    c = c.withColumn("range", F.floor(F.coalesce("conv_id", F.lit(-1)) / span))
    me = F.struct("conv_id", "said")
    inside = Window.partitionBy("opening", "range").orderBy(F.col("conv_id").asc_nulls_first())
    rows = c.select("opening", "range", me.alias("b"), F.lag(me).over(inside).alias("a"))
    first = rows.where("a is null").select("opening", "range", "b")
    last = c.groupBy("opening", "range").agg(F.max_by(me, F.coalesce("conv_id", F.lit(-(1 << 63)))).alias("tail"))
    chained = last.select("opening", "range", F.lag("tail").over(Window.partitionBy("opening").orderBy("range")).alias("a")).where("a is not null")
    pairs = rows.where("a is not null").select("a", "b").unionAll(first.join(chained, ["opening", "range"]).select("a", "b"))
    a, b = F.col("a"), F.col("b")
    better = a["said"] >= b["said"]
    return pairs.select(F.when(better, a).otherwise(b)["conv_id"].alias("x"), F.when(better, b).otherwise(a)["conv_id"].alias("y"))


def numbered(c: DataFrame) -> DataFrame:
    """c with `number`, consecutive by conv_id: a row's place in its range of ids after the rows of the ranges before it."""
    ranged = cut(c.select("conv_id").repartitionByRange(partitions(c.sparkSession), "conv_id").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("size"))  # a row per partition
    before = sizes.select("range", (F.sum("size").over(Window.orderBy("range")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("conv_id"))
    return c.join(ranged.join(F.broadcast(before), "range").select("conv_id", (F.col("before") + place).alias("number")), "conv_id")


def swapped_pairs(turns: DataFrame, gaps: bool = False) -> DataFrame:
    """(x, y): each conversation up to its last answer is chosen; rejected is the same with the last answer of the
    conversation with the next id, if there is none that of the one before, whose id it carries. Conversations without an
    answer, without an id, or without a neighbour that has an answer make no pair. Ids are those of conversations, so unique.

    The next id is conv_id + 1; with `gaps` it is the next id of a conversation with an answer, however far."""
    back = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant")
    c = conversations(turns).withColumn("back", back).where("back > 0 and conv_id is not null")
    c = c.withColumn("turns", F.slice("turns", 1, (F.size("turns") - F.col("back") + 1).cast("int")))
    c = numbered(c) if gaps else c.withColumn("number", F.col("conv_id"))
    said = c.select("number", "conv_id", F.element_at("turns", -1).alias("answer"))
    at = lambda by, name: said.select((F.col("number") - by).alias("number"), F.struct("conv_id", "answer").alias(name))
    near = c.join(at(1, "after"), "number", "left").join(at(-1, "before"), "number", "left").withColumn("other", F.coalesce("after", "before")).where("other is not null")
    head = F.slice("turns", 1, F.size("turns") - 1)
    return near.select(F.struct("conv_id", "turns").alias("x"), F.struct(F.col("other.conv_id").alias("conv_id"), F.concat(head, F.array("other.answer")).alias("turns")).alias("y"))


def format_pairs(pairs: DataFrame, *extra: str) -> DataFrame:
    """One row per pair (x, y): ids, prompt, chosen and rejected completion with their loss spans.

    A completion may be empty, where one conversation is a prefix of the other; of equal conversations both are."""
    x, y = F.col("x.turns"), F.col("y.turns")
    differs = F.array_position(F.zip_with(x, y, lambda s, t: s.eqNullSafe(t)), False)
    p = pairs.withColumn("common", F.when(differs > 0, differs - 1).otherwise(F.size(x)).cast("int"))
    rest = lambda t: F.slice(t, F.col("common") + 1, F.greatest(F.size(t), F.lit(1)))
    return p.select(
        *extra, F.col("x.conv_id").alias("chosen_id"), F.col("y.conv_id").alias("rejected_id"), F.col("common").alias("prompt_turns"),
        render(F.slice(x, 1, F.col("common"))).alias("prompt"),
        render(rest(x)).alias("chosen"), loss_spans(rest(x)).alias("chosen_loss"),
        render(rest(y)).alias("rejected"), loss_spans(rest(y)).alias("rejected_loss"),
    )


def preference_pairs(turns: DataFrame, span: int = RANGE, gaps: bool = False, scores: DataFrame | None = None) -> DataFrame:
    """The pairs of both ways, formatted; `kind` is opening or swap. With `gaps`, swaps reach over missing ids.

    Null roles and texts count as empty; a null conv_id is a conversation of its own and comes first; turns that repeat
    a number are ordered by role and text."""
    both = opening_pairs(turns, span, scores).withColumn("kind", F.lit("opening")).unionByName(swapped_pairs(turns, gaps).withColumn("kind", F.lit("swap")))
    return format_pairs(both, "kind")
