"""Filter interaction audit: what five filters remove in each of their 120 orders, worked out from 32 cells for each part.

Native expressions give each document a mask with one bit for each filter that it fails. Filter E (an identical text has a smaller
id) needs the table: a grouping by the text's digest supplies the smallest id, and only rows (digest, id, part, mask) shuffle.
Documents are then counted by part and mask. All orders are enumerated from these cells, so their cost doesn't depend on the
number of documents: the documents that any set of filters leaves are the sum of the cells without its bits.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import stage_table, text_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_ALL = (1 << len(FILTERS)) - 1
_MEASURES = ("docs", "good", "toxic")


def _bit(condition: Column, name: str) -> Column:
    return F.when(condition, 1 << FILTERS.index(name)).otherwise(0)


def masked(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, part, mask) for each row: the bits of A to D, the SHA-256 of the text."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text_of().alias("_text"))
    words = F.array_remove(F.split(F.regexp_replace("_text", r"[\x09-\x0D]", " "), " "), "")
    held = held.withColumn("_words", words)
    distinct, capitals = F.size(F.array_distinct("_words")), F.length("_text") - F.length(F.regexp_replace("_text", "[A-Z]+", ""))
    mask = (
        _bit(F.size("_words") < 200, "A")
        .bitwiseOR(_bit(distinct.cast("long") * 100 < F.size("_words").cast("long") * 50, "B"))
        .bitwiseOR(_bit(capitals.cast("long") * 100 > F.length("_text").cast("long") * 2, "C"))
        .bitwiseOR(_bit(F.col("_text").rlike("[#$%&*|]"), "D"))
    )
    return held.select("doc_id", F.unhex(F.sha2("_text", 256)).alias("digest"), "part", mask.alias("mask"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add good and toxic. Rows without an id have no label; they stay out of the join, where they would be one key."""
    flag = lambda name: F.max(F.when(F.col(name) == 1, 1).otherwise(0))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    known = rows.where("doc_id is not null").join(marks.where("good + toxic > 0"), "doc_id", "left").fillna(0, ["good", "toxic"])
    bare = rows.where("doc_id is null").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    return known.unionByName(bare)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, docs, good, toxic): documents of each part by the five filters that they fail; empty cells are absent."""
    rows = stage_table(_labelled(stage_table(masked(docs), "masks"), labels), "labelled")
    keys = ["part", "mask", "good", "toxic"]
    everyone = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    # the rows of a text's smallest id; several if rows repeat both
    by_id = rows.groupBy("digest", "doc_id", *keys).agg(F.count("*").alias("n"))
    least = by_id.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")).select(F.col("digest").alias("_digest"), F.col("least.doc_id").alias("_id"))
    first = by_id.join(least, (by_id["digest"] == least["_digest"]) & by_id["doc_id"].eqNullSafe(least["_id"])).groupBy(*keys).agg(F.sum("n").alias("n"))
    copy = F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E")))
    signed = everyone.withColumn("mask", copy).unionByName(first).unionByName(first.withColumn("mask", copy).withColumn("n", -F.col("n")))
    sums = signed.groupBy("part", "mask").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    return sums.where("docs > 0")


def interactions(counted: DataFrame) -> DataFrame:
    """The cells' report: one row for each part, order and step."""
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *_MEASURES)).alias("cells"))
    sets = F.sequence(F.lit(0), F.lit(_ALL))

    def left(measure: str) -> Column:
        """At place s what remains after the filters of set s."""
        kept = lambda s: F.filter("cells", lambda c: c["mask"].bitwiseAND(s) == 0)
        return F.transform(sets, lambda s: F.aggregate(kept(s), F.lit(0).cast("long"), lambda n, c: n + c[measure]))

    alone = F.transform(sets, lambda s: F.aggregate(F.filter("cells", lambda c: c["mask"] == s), F.lit(0).cast("long"), lambda n, c: n + c["docs"]))
    held = parts.select("part", alone.alias("alone"), *[left(m).alias(m) for m in _MEASURES])
    held = held.select("*", F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order"))
    held = held.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda letters: F.expr(f"aggregate({letters}, 0, (s, x) -> s | shiftleft(1, instr('{FILTERS}', x) - 1))")
    held = held.withColumns({"before": bits("slice(split(filter_order, ''), 1, step - 1)"), "bit": bits("slice(split(filter_order, ''), step, 1)")})
    at = lambda measure, s: F.get(F.col(measure), s)
    before, bit = F.col("before"), F.col("bit")
    after = before.bitwiseOR(bit)
    removed = at("docs", before) - at("docs", after)
    # before an order's filter may stand any set of the others, in |set|! * (4 - |set|)! orders
    ways = "element_at(array(24L, 6L, 4L, 6L, 24L), cast(bit_count(s) as int) + 1)"
    shapley = F.expr(f"aggregate(filter(sequence(0, {_ALL}), s -> (s & bit) = 0), 0L, (n, s) -> n + {ways} * (get(docs, s) - get(docs, s | bit)))")
    return held.select(
        "part", "filter_order", "step", at("docs", after).alias("kept"), removed.alias("removed"),
        (at("docs", F.lit(0)) - at("docs", bit) - removed).alias("redundant"), at("alone", bit).alias("unique_fails"),
        (at("good", before) - at("good", after)).alias("good_lost"), (at("toxic", before) - at("toxic", after)).alias("toxic_lost"), shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step.

    A null text counts as empty and a null source as the part ``''``. A null doc_id is larger than any other and has no label; rows that
    repeat both id and text are none of them a copy of the other. Of repeated labels one with 1 is enough. Each row
    of ``docs`` counts once. A table without rows has no parts and gives no rows. Other columns, whatever their names, are left out.
    """
    return interactions(cells(docs, labels))
