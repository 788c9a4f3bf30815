"""Exact dedup: a two-pass Bloom filter finds possibly repeated texts; only those rows shuffle.

Pass 1 counts the hits of each of 2**64 slots, kept sparsely: one slot of 8 bytes for each row, combined in each task before
it shuffles. Slots hit twice or more are set in a Bloom filter of two hashes, whose size follows from their number.
Pass 2 probes the filter. A row whose two bits aren't both set has a text that no other row has; it goes straight to the
result. The others, true repeats and the filter's false alarms, are grouped exactly by their SHA-256.

The filter is broadcast in parts of up to ``max_bits`` for each hash (2 x 16 MB by default). A larger one is cut into ranges of
slots and probed range by range, so its share of false alarms is the same at any size; each row is probed once, and the table is read
once for each range (16 MB of bits hold the repeats of about 8 million different texts).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from furrow.llm.common import WS, hot_join, stage_table, text_of

#: Runs of white space that aren't already one space; single spaces need no replacement.
_RUN = rf"[\x09-\x0D][{WS}]*|\x20[{WS}]+"
_PAGE = 32768


def normalised(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, _RUN, " ")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_of(text_col)), 256)).alias("sha"))


class Bloom(NamedTuple):
    """Pages of a filter (segment, page, bits), the bits of each hash in a segment, and the number of segments."""

    pages: DataFrame
    bits: int
    segments: int


def _print() -> Column:
    return F.xxhash64("sha")


def _segment(print_: Column, segments: int) -> Column:
    return F.pmod(F.xxhash64(print_, F.lit("segment")), F.lit(segments))


def _slot(print_: Column, which: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(print_, F.lit(which)), F.lit(bits)) + F.lit(which * bits)


def _probe(df: DataFrame, pages: DataFrame, which: int, bits: int) -> DataFrame:
    slot, at = _slot(_print(), which, bits), F.col(f"_at{which}")
    held = df.withColumn("_page", F.floor(slot / _PAGE)).withColumn(f"_at{which}", (slot % _PAGE).cast("int"))
    held = held.join(F.broadcast(pages), held["_page"] == pages["page"], "left").drop("_page", "page")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr(f"shiftright({'_byte'}, _at{which} % 8) & 1")
    return held.withColumn("_byte", byte).withColumn(f"_seen{which}", F.coalesce(bit == 1, F.lit(False))).drop("_byte", "bits", f"_at{which}")


def repeated(narrow: DataFrame, max_bits: int = 1 << 27) -> Bloom:
    """Pass 1: the filter of the slots that two rows or more with ``sha`` came to."""
    twice = stage_table(narrow.groupBy(_print().alias("print")).count().where("count > 1").select("print"), "twice")
    total = 1 << max(16, (16 * twice.count()).bit_length())
    bits = min(total, max_bits)
    segments = total // bits
    slots = twice.select(_segment(F.col("print"), segments).alias("segment"), F.explode(F.array(*[_slot(F.col("print"), k, bits) for k in (0, 1)])).alias("slot"))
    pages = slots.groupBy("segment", F.floor(F.col("slot") / _PAGE).alias("page")).agg(F.bitmap_construct_agg((F.col("slot") % _PAGE).cast("long")).alias("bits"))
    return Bloom(stage_table(pages, "bloom"), bits, segments)


def split(df: DataFrame, bloom: Bloom) -> tuple[DataFrame, DataFrame]:
    """Pass 2: rows whose ``sha`` no other row has, and rows that may be repeated. Neither side shuffles."""
    sides: list[list[DataFrame]] = [[], []]
    for k in range(bloom.segments):
        part = df if bloom.segments == 1 else df.where(_segment(_print(), bloom.segments) == k)
        pages = bloom.pages.where(F.col("segment") == k).select("page", "bits")
        held = _probe(_probe(part, pages, 0, bloom.bits), pages, 1, bloom.bits)
        again = F.col("_seen0") & F.col("_seen1")
        sides[0].append(held.where(~again).select(*df.columns))
        sides[1].append(held.where(again).select(*df.columns))
    alone, maybe = (reduce(DataFrame.unionByName, side) for side in sides)
    return alone, maybe


def _decided(maybe: DataFrame) -> DataFrame:
    """Exact groups of the rows that may be repeated."""
    groups = stage_table(
        maybe.groupBy("sha", "doc_id").count()
        .groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.sum("count").alias("group_size"), F.min_by("count", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("ties")),
        "groups",
    )
    rows = hot_join(maybe, groups, "sha", "group_size")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    tied = rows.where(first & (F.col("ties") > 1))
    tied = tied.withColumn("kept", F.row_number().over(W.partitionBy("sha").orderBy("doc_id")) == 1)
    plain = rows.where(~(first & (F.col("ties") > 1))).withColumn("kept", first)
    return plain.unionByName(tied)


def exact_dedup(narrow: DataFrame, max_bits: int = 1 << 27) -> DataFrame:
    """Rows (doc_id, sha) to (doc_id, keep_id, group_size, kept, sha), one for each input row.

    Of equal texts the smallest doc_id stays; a null doc_id counts as the largest. Of rows that repeat both
    doc_id and text one is kept. An empty table gives no rows.
    """
    narrow = stage_table(narrow, "fingerprints")
    alone, maybe = split(narrow, repeated(narrow, max_bits))
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    return alone.unionByName(_decided(maybe).select(*alone.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 1 << 27) -> DataFrame:
    """The rows of ``docs`` whose text no row of smaller id has; all columns stay as they are.

    Whole rows shuffle only if the filter holds their text for repeated; the others pass straight through. Rows that repeat id
    and text are one document and give one row.
    """
    narrow = stage_table(fingerprints(docs, id_col, text_col), "fingerprints")
    bloom = repeated(narrow, max_bits)
    ids = _decided(split(narrow, bloom)[1])
    gone = ids.where(~F.col("kept")).select(F.col("doc_id").alias("__furrow_i"), F.col("sha").alias("__furrow_s")).distinct()
    gone = stage_table(gone, "copies")
    held = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text_of(text_col)), 256)).alias("sha"))
    alone, maybe = split(held, bloom)
    same = maybe["doc_id"].eqNullSafe(gone["__furrow_i"]) & (maybe["sha"] == gone["__furrow_s"])
    kept = maybe.join(gone.hint("shuffle_hash"), same, "left_anti")
    # a row kept beside identical ones that go has the same id and text as they have
    ties = ids.where("kept").select("doc_id", "sha").intersect(ids.where("not kept").select("doc_id", "sha"))
    ties = stage_table(ties.select(F.col("doc_id").alias("__furrow_i"), F.col("sha").alias("__furrow_s")), "repeated")
    if not ties.isEmpty():
        same = maybe["doc_id"].eqNullSafe(ties["__furrow_i"]) & (maybe["sha"] == ties["__furrow_s"])
        kept = kept.unionByName(maybe.join(ties, same, "left_semi").dropDuplicates(["doc_id", "sha"]))
    return alone.unionByName(kept).select("row.*")
