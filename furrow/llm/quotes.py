"""Quotation linking: messages without their quotes, tied to the messages they quote, in reply order.

A line's level is the number of ``>`` before it. A passage is a run of lines of one level of one or more. Its units are the
passage itself, its paragraphs, lines and sentences, as word sequences: case and line breaks don't count, so a passage
that was wrapped anew stays the same. Units are hashed and joined, within their conversation, with the latest earlier
message that says them itself: as its whole text without quotes, or as a paragraph, line or sentence of it. A passage's
original is the message that has most of its units' words, of equals the latest; passages of every level find their own.
A message replies to the original of most words of its passages of level 1, or of the lowest level that has originals.

Threads are found by pointer doubling, and places in reply order (each message stands behind the one it replies to, with
its own replies before the next sibling's) by list ranking over the way around each thread; the rounds of both are the logarithm of
a thread's length. A conversation is read by (thread, place). No step holds the rows of a conversation or of a passage
in one task: what must be in order is dealt by ranges, and the ranges' ends are joined.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.llm.common import released, stage_table

_QUOTE = r"^(?:[ \t]*>)+"
_MARK, _SPACE, _END = re.compile(_QUOTE), re.compile(r"[\x20\x09-\x0D]+"), re.compile(r"([.!?]) ")
UNITS = "conv_id long, turn long, passage int, level int, hash binary, words int"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _QUOTE, 0), "[^>]", ""))


def units_of(lines: list[str]) -> dict[str, int]:
    """Normalised lines to the distinct word sequences among them, and their numbers of words. An empty line ends a paragraph."""
    paragraphs, held = [], []
    for line in [*lines, ""]:
        if line:
            held.append(line)
        elif held:
            paragraphs.append(" ".join(held))
            held = []
    found = [" ".join(paragraphs), *paragraphs, *(x for x in lines if x)]
    for p in paragraphs:
        found += _END.sub("\\1\n", p).split("\n")
    return {u: u.count(" ") + 1 for u in found if u}


def passages_of(text: str) -> list[tuple[int, list[str]]]:
    """Runs of lines of one level as (level, normalised lines); the lines of level 0 come first, all together, with an empty line for each run between them."""
    own, runs = [], []
    for line in text.split("\n"):
        mark = _MARK.match(line)
        level = mark[0].count(">") if mark else 0
        plain = _SPACE.sub(" ", line[mark.end() :] if mark else line).strip(" ").lower()
        if not level:
            own.append(plain)
            runs.append((0, []))
            continue
        own.append("")
        if not runs or runs[-1][0] != level:
            runs.append((level, []))
        runs[-1][1].append(plain)
    return [(0, own), *((n, r) for n, r in runs if n)]


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in released(batches):
        rows = []
        for conv, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for n, (level, lines) in enumerate(passages_of(text)):
                rows += [(conv, turn, n, level, hashlib.blake2b(u.encode(), digest_size=16).digest(), w) for u, w in units_of(lines).items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "turn", "passage", "level", "hash", "words"])


def _in_ranges(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """``rows`` dealt out by ranges of ``order``, with the range's number: a key with very many rows has several of them."""
    return stage_table(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)


def _originals(said: DataFrame, quoted: DataFrame) -> DataFrame:
    """(conv_id, hash, turn) of quoting and of saying to (conv_id, hash, turn, origin): the latest earlier turn that says it."""
    met = said.join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
    both = met.select("conv_id", "hash", "turn", F.lit(True).alias("says")).distinct().unionByName(quoted.select("conv_id", "hash", "turn", F.lit(False).alias("says")).distinct())
    dealt = _in_ranges(both, "quote-units", "conv_id", "hash", "turn", "says")
    key = ["conv_id", "hash", "_range"]
    at = F.when(F.col("says"), F.col("turn"))
    last = F.last(at, ignorenulls=True).over(W.partitionBy(*key).orderBy("turn", "says").rowsBetween(W.unboundedPreceding, -1))
    tops = dealt.groupBy(*key).agg(F.max(at).alias("top"))
    carried = F.max("top").over(W.partitionBy("conv_id", "hash").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    held = dealt.withColumn("last", last).where(~F.col("says")).join(tops.withColumn("carried", carried).select(*key, "carried"), key)
    return held.select("conv_id", "hash", "turn", F.coalesce("last", "carried").alias("origin")).where("origin is not null")


def _threads(link: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) to (conv_id, turn, thread, depth) of all replies."""
    chain = stage_table(link.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")), "chains")
    while True:
        above = chain.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        held = chain.join(above, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_t")), "left")
        held = stage_table(held.select("conv_id", "turn", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_up").isNotNull().alias("moved")), "chains")
        chain = held.drop("moved")
        if held.where("moved").isEmpty():
            return chain.withColumnRenamed("up", "thread")


def _places(link: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to) to (conv_id, turn, place) of all messages of threads with replies: 0 for the first, then on in reply order.

    Each message is entered and left once on the way around its thread; a message's place is the number of entries before its own.
    """
    dealt = _in_ranges(link.select("conv_id", F.col("reply_to").alias("up"), "turn"), "siblings", "conv_id", "up", "turn")
    key = ["conv_id", "up", "_range"]
    after = F.lead("turn").over(W.partitionBy(*key).orderBy("turn"))
    heads = dealt.groupBy(*key).agg(F.min("turn").alias("head"))
    heads = heads.withColumn("beyond", F.lead("head").over(W.partitionBy("conv_id", "up").orderBy("_range")))
    siblings = dealt.withColumn("after", after).join(heads.select(*key, "beyond"), key).select("conv_id", "turn", "up", F.coalesce("after", "beyond").alias("sibling"))
    first = dealt.groupBy("conv_id", F.col("up").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = siblings.join(first, ["conv_id", "turn"], "full")
    step = lambda turn, way: F.struct(turn.alias("turn"), F.lit(way).alias("way"))
    enter = F.when(F.col("child").isNotNull(), step(F.col("child"), "in")).otherwise(step(F.col("turn"), "out"))
    leave = F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), "in")).when(F.col("up").isNotNull(), step(F.col("up"), "out"))
    way = nodes.select("conv_id", F.explode(F.array(F.struct(step(F.col("turn"), "in").alias("at"), enter.alias("next"), F.lit(1).cast("long").alias("n")), F.struct(step(F.col("turn"), "out").alias("at"), leave.alias("next"), F.lit(0).cast("long").alias("n")))).alias("e"))
    way = stage_table(way.select("conv_id", "e.*"), "ways")
    while not way.where("next is not null").isEmpty():
        ahead = way.select(F.col("conv_id").alias("_c"), F.col("at").alias("_a"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        going = way.where("next is not null").join(ahead, (F.col("conv_id") == F.col("_c")) & (F.col("next") == F.col("_a"))).select("conv_id", "at", F.col("_next").alias("next"), (F.col("n") + F.col("_n")).alias("n"))
        way = stage_table(going.unionByName(way.where("next is null")), "ways")
    return way.where("at.way = 'in'").select("conv_id", F.col("at.turn").alias("turn"), F.col("n").alias("left"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row for each row: conv_id, turn, role, reply_to, thread, place, depth, n_quoted, n_passages, n_linked, sources, own_text.

    ``reply_to`` is the turn replied to, null if nothing is quoted or no quote is found; ``thread`` the turn that begins the
    thread (the own turn if nothing is replied to), ``place`` the place in it in reply order and ``depth`` the number of replies above. ``n_quoted``
    counts quoted lines, ``n_passages`` and ``n_linked`` passages with words and those with an original, which ``sources`` lists as level:turn.
    ``own_text`` has the lines that aren't quoted. A null text has no lines and an empty own text. Rows with a null conv_id or turn link with
    nothing. Rows that repeat (conv_id, turn) are one message and get equal links. Other columns are left out.
    """
    base = messages.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    known = base.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    quoting = F.col("text").rlike(r"(?m)^[ \t]*>")
    quoted = stage_table(known.where(quoting).mapInArrow(_units, UNITS).where("level > 0"), "quoted")
    said = known.mapInArrow(_units, UNITS).where("level = 0").select("conv_id", "hash", "turn")
    origins = _originals(said, quoted)
    found = quoted.join(origins, ["conv_id", "hash", "turn"]).groupBy("conv_id", "turn", "level", "passage", "origin").agg(F.sum("words").alias("words"))
    found = stage_table(found.groupBy("conv_id", "turn", "level", "passage").agg(F.max(F.struct("words", "origin")).alias("best")), "passages")
    passages = quoted.groupBy("conv_id", "turn").agg(F.countDistinct("passage", "level").alias("n_passages"))
    listed = F.concat_ws(":", F.col("level").cast("string"), F.col("best.origin").cast("string"))
    linked = found.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_linked"), F.sort_array(F.collect_list(F.struct("passage", "level", listed.alias("s")))).alias("s"))
    replies = found.groupBy("conv_id", "turn", "level", F.col("best.origin").alias("origin")).agg(F.sum("best.words").alias("words"))
    replies = replies.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "words", "origin")).getField("origin").alias("reply_to"))
    replies = stage_table(replies, "replies")
    threads, places = stage_table(_threads(replies), "threads"), stage_table(_places(replies), "places")
    members = places.join(threads, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    whole = members.where("thread = turn").select("conv_id", "thread", F.col("left").alias("size"))
    members = members.join(whole, ["conv_id", "thread"]).select("conv_id", "turn", "thread", "depth", (F.col("size") - F.col("left")).alias("place"))
    links = passages.join(linked, ["conv_id", "turn"], "left").join(replies, ["conv_id", "turn"], "left").join(members, ["conv_id", "turn"], "full")
    links = stage_table(links.withColumn("s", F.concat_ws(",", F.transform("s", lambda x: x["s"]))), "quote-links")
    lines = F.split("text", "\n")
    counted = base.withColumn("n_quoted", F.size(F.filter(lines, lambda x: _level(x) > 0)).cast("long")).withColumn("own_text", F.array_join(F.filter(lines, lambda x: _level(x) == 0), "\n")).drop("text")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return counted.join(links, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("thread", "turn").alias("thread"), number("place"), number("depth"),
        "n_quoted", number("n_passages"), number("n_linked"), F.coalesce("s", F.lit("")).alias("sources"), "own_text",
    )


def conversations(linked: DataFrame) -> DataFrame:
    """The messages of ``link_quotes`` without quotes in reply order: sorted by conversation, thread and place, dealt by ranges of them."""
    order = ["conv_id", "thread", "place"]
    return linked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "thread", "place", "depth", "turn", "role", F.col("own_text").alias("text"))
