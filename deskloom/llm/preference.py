"""Preference formatting: one shared prompt and two masked completions from a chosen and a rejected conversation.

The prompt is the longest run of turns, from the start, in which both conversations have the same messages; it is
rendered once. What follows in each is its completion; only the words of assistant messages, with the mark that
ends a turn, are to be learned, and ``*_mask`` holds their spans (code points, end exclusive) in the completion.

A null text or role is rendered as an empty one and equals only another null. Messages of one turn number stand in order of role, then
text, repeated ones as often as they are there; a null turn number comes before all others. Rows without the id of a pair or
conversation belong to none and are left out. If one conversation is the start of the other its completion is
empty; a pair with one side only has an empty prompt. An empty table gives no row; other columns are not read.
A conversation is one value of one row, so the turns of a pair meet in one task, as any form of rendering needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import scratch

END = "<|end|>\n"


def _head(m: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("")), F.lit("|>\n"))


def _body(m: Column) -> Column:
    return F.concat(F.coalesce(m["text"], F.lit("")), F.lit(END))


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(_head(m), _body(m))), "")


def mask(messages: Column) -> Column:
    """Spans of what assistants say, in the rendered messages."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, m: Column) -> Column:
        begin = a["at"] + F.length(_head(m))
        end = begin + F.length(_body(m))
        own = F.when(m["role"] == "assistant", F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(a["spans"], own).alias("spans"))

    return F.aggregate(messages, start, step, lambda a: a["spans"])


def _messages(conversations: DataFrame, id_: str) -> DataFrame:
    """id and m: all messages of each conversation, by turn, role and text."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))
    message = F.struct(turn.alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return conversations.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias("id")).agg(F.sort_array(F.collect_list(message)).alias("m"))


def _formatted(both: DataFrame, pair: str) -> DataFrame:
    """both: id, and the messages c and r of its two conversations."""
    first = F.array_position(F.zip_with("c", "r", lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int") - 1
    other = F.when(first >= 0, F.least(F.get("c", first)["turn"], F.get("r", first)["turn"]))  # the first turn with different messages
    both = both.withColumn("other", other)
    prompt = F.filter("c", lambda x: F.col("other").isNull() | (x["turn"] < F.col("other")))
    rest = lambda side: F.filter(side, lambda x: x["turn"] >= F.col("other"))
    t = both.select("id", prompt.alias("p"), *(F.coalesce(rest(x), F.slice(x, 1, 0)).alias(x) for x in ("c", "r")))
    return t.select(
        F.col("id").alias(pair), F.size(F.array_distinct(F.transform("p", lambda x: x["turn"]))).alias("prompt_turns"), rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), rendered(F.col("r")).alias("rejected"), mask(F.col("r")).alias("rejected_mask"),
    )


def pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id") -> DataFrame:
    """chosen, rejected: ``pair``, turn, role, text. One row for each pair: prompt, prompt_turns, completions and masks."""
    both = _messages(chosen, pair).withColumnRenamed("m", "c").join(_messages(rejected, pair).withColumnRenamed("m", "r"), "id", "full")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    return _formatted(both.withColumns({x: F.coalesce(x, none) for x in ("c", "r")}), pair)


def _before(ids: DataFrame) -> DataFrame:
    """id and before: the id that comes before it in order, for the first the last one."""
    dealt = scratch.table(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    ends = dealt.groupBy("part").agg(F.max("id").alias("end"))  # one row of each task
    ends = ends.withColumn("end", F.coalesce(F.lag("end").over(Window.orderBy("part")), F.max("end").over(Window.partitionBy())))
    own = dealt.withColumn("lag", F.lag("id").over(Window.partitionBy("part").orderBy("id")))
    return own.join(F.broadcast(ends), "part").select("id", F.coalesce("lag", "end").alias("before"))


def answered_otherwise(conversations: DataFrame, pair: str = "conv_id") -> DataFrame:
    """Pairs from plain conversations: each one up to its last assistant turn, and the same start with the last reply of the next one.

    Next is the conversation with a reply that follows in order of id, after the last the first. A lone conversation
    with a reply has no other, and gives no pair. Texts are gathered once, and replies sent once to the conversation before.
    """
    conversations = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ids = conversations.where("role = 'assistant' AND conv_id IS NOT NULL").select(F.col("conv_id").alias("id")).distinct()
    m = _messages(conversations, "conv_id")
    said = F.filter("m", lambda x: x["role"] == "assistant")
    m = m.withColumn("last", F.array_max(F.transform(said, lambda x: x["turn"]))).where("last IS NOT NULL")
    own = m.select("id", "last", F.filter("m", lambda x: x["turn"] <= F.col("last")).alias("c"))
    reply = m.select("id", F.filter("m", lambda x: (x["turn"] == F.col("last")) & (x["role"] == "assistant")).alias("reply"))
    reply = reply.join(_before(ids).where("id <> before"), "id").select(F.col("before").alias("id"), "reply")
    moved = F.transform("reply", lambda x: F.struct(F.col("last").alias("turn"), x["role"].alias("role"), x["text"].alias("text")))
    both = own.join(reply, "id").select("id", "c", F.concat(F.filter("c", lambda x: x["turn"] < F.col("last")), moved).alias("r"))
    return _formatted(both, pair)
