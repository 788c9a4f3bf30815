"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) are certain by themselves. Weak parts -- identifiers, token-like strings and
endpoints -- say little alone. Parts are first made disjoint: a weak part that overlaps a base span, an identifier that overlaps
an endpoint and a token-like string that overlaps either of them is no part of its own, so nothing confirms itself. Each
part that is left is joined, by an interval join inside its document, with the nearest parts of the other classes before and
behind it, and is reported only if a complementary part starts or ends within ``scope`` code points: an identifier near
a secret, a token-like string near an identifier or an endpoint, an endpoint near both others. The joins are windows over
(document, start): one pass in each direction, no pairs.

Positions come from the pieces between matches, so that one scan of a kind is enough for documents without matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from furrow.llm.common import stage_table, text_of

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
WEAK_ID = r"""(?i:access|client|account|user|login)[_-]?(?i:id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{4,}"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[^\x20\x09-\x0D"'<>]+"""

#: Name, order in ties, class of part.
KINDS = (("assign", 0, "secret"), ("access", 1, "id"), ("hex", 2, "secret"), ("weak_id", 3, "id"), ("weak_secret", 4, "secret"), ("endpoint", 5, "endpoint"))
#: Weak kinds in the order in which they claim their place; base spans come before them.
RANKS = {"endpoint": 1, "weak_id": 2, "weak_secret": 3}
SPAN = "struct<start:int,no:int,kind:string,end:int>"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _spans(text: Column, pattern: str, kind: str, number: int, good: Column | None = None) -> Column:
    """Spans of a kind's matches; ``good`` says of each match, by place, whether it counts.

    Places are running sums over the pieces between matches and the matches, in blocks, so that the work is nearly in
    proportion to the number of matches.
    """
    block = 256
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps, sizes = F.transform(F.split(text, pattern, -1), F.length), F.transform(found, F.length)
    ok = F.transform(found, lambda _: F.lit(True)) if good is None else good
    steps = F.filter(F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), ok.alias("ok")), lambda x: x["size"].isNotNull())
    width = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
    before = lambda blocks: F.aggregate(F.transform(blocks, width), F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    def place(b: Column, start: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            first = s["at"] + x["gap"]
            span = F.struct(first.alias("start"), F.lit(number).alias("no"), F.lit(kind).alias("kind"), (first + x["size"]).alias("end"))
            return F.struct((first + x["size"]).alias("at"), F.when(x["ok"], F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

        return F.aggregate(b, F.struct(start.alias("at"), _none().alias("out")), step, lambda s: s["out"])

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / block).cast("int")), lambda k: F.slice(all_, k * block + 1, F.lit(block)))
    placed = _let(steps, lambda all_: _let(cut(all_), lambda blocks: _let(before(blocks), lambda starts: F.flatten(F.transform(blocks, lambda b, k: place(b, F.get(starts, k)))))))
    return F.when(F.size(found) == 0, _none()).otherwise(placed)


def _scan(df: DataFrame) -> DataFrame:
    """Rows (doc_id, dig, base, weak): base spans, and weak spans that nothing has confirmed yet."""
    t = F.col("_t")
    long_enough = F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda x: F.length(x) >= 6)
    # a digit and a letter; joined words in one case (paths, slugs, names) aren't token-like
    mixed = F.transform(F.regexp_extract_all(t, F.lit(WEAK_SECRET), F.lit(0)), lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (~x.rlike("[/_-]") | (x.rlike("[A-Z]") & x.rlike("[a-z]"))))
    base = F.concat(
        _spans(t, ASSIGN, "assign", 0, long_enough),
        F.when(t.contains("AKIA"), _spans(t, ACCESS, "access", 1)).otherwise(_none()),
        _spans(t, HEX, "hex", 2),
    )
    weak = F.concat(
        _spans(t, WEAK_ID, "weak_id", 3),
        _spans(t, WEAK_SECRET, "weak_secret", 4, mixed),
        F.when(t.contains("://"), _spans(t, ENDPOINT, "endpoint", 5)).otherwise(_none()),
    )
    return df.select("doc_id", F.xxhash64("_t").alias("dig"), F.sort_array(base).alias("base"), F.sort_array(weak).alias("weak"))


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(doc_id, dig, linked): the weak spans that a complementary part confirms."""
    classes = F.create_map(*[F.lit(x) for name, _, part in KINDS for x in (name, part)])
    parts = found.select("doc_id", "dig", F.explode(F.concat("base", "weak")).alias("s")).distinct()
    parts = parts.select("doc_id", "dig", "s", F.col("s.start").alias("b"), F.col("s.end").alias("e"), classes[F.col("s.kind")].alias("part"), (F.col("s.no") < 3).alias("base"))
    ahead = W.partitionBy("doc_id", "dig").orderBy("b", "rank", "s.no", "e").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("doc_id", "dig").orderBy(F.desc("b"), F.desc("rank"), F.desc("s.no"), F.desc("e")).rowsBetween(W.unboundedPreceding, -1)
    live = parts.withColumn("rank", F.when(F.col("base"), 0).otherwise(F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])[F.col("s.kind")]))
    for rank in RANKS.values():
        surer = F.col("rank") < rank
        over = (F.max(F.when(surer, F.col("e"))).over(ahead) > F.col("b")) | (F.min(F.when(surer, F.col("b"))).over(behind) < F.col("e"))
        live = live.withColumn("_over", (F.col("rank") == rank) & F.coalesce(over, F.lit(False))).where(~F.col("_over")).drop("_over")
    for part in ("id", "secret", "endpoint"):
        before = F.max(F.when(F.col("part") == part, F.col("e"))).over(ahead)
        after = F.min(F.when(F.col("part") == part, F.col("b"))).over(behind)
        live = live.withColumn(f"_{part}_before", before).withColumn(f"_{part}_after", after)
    near = lambda part: F.coalesce(F.col("b") - F.col(f"_{part}_before") <= scope, F.lit(False)) | F.coalesce(F.col(f"_{part}_after") - F.col("e") <= scope, F.lit(False))
    complete = (
        F.when(F.col("part") == "id", near("secret"))
        .when(F.col("part") == "secret", near("id") | near("endpoint"))
        .otherwise(near("id") & near("secret"))
    )
    return live.where(~F.col("base") & complete).groupBy("doc_id", "dig").agg(F.sort_array(F.collect_list("s")).alias("linked"))


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row for each row of ``df``: doc_id, dig (of the text), base, spans (base and linked weak ones, sorted).

    A null text counts as empty; null ids pass through. Rows that repeat id and text get the same spans. An empty table gives no rows; other columns are left out.
    Documents without weak parts don't shuffle.
    """
    found = stage_table(_scan(df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))), "spans")
    bare = found.where(F.size("weak") == 0).select("doc_id", "dig", "base", F.col("base").alias("spans"))
    with_weak = found.where(F.size("weak") > 0)
    linked = _linked(with_weak, scope).select(F.col("doc_id").alias("_id"), F.col("dig").alias("_dig"), "linked")
    same = with_weak["doc_id"].eqNullSafe(F.col("_id")) & (with_weak["dig"] == F.col("_dig"))
    joined = with_weak.join(linked, same, "left").select("doc_id", "dig", "base", F.sort_array(F.concat("base", F.coalesce("linked", _none()))).alias("spans"))
    return bare.unionByName(joined)


def span_text(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_scan(df: DataFrame, scope: int = 200) -> DataFrame:
    """Counts, the digest of the base spans and the list of all spans, one row for each row of ``df``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(df, scope=scope).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(span_text("base"), 256).alias("base_sha256"),
        span_text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_linked"),
    )


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = 200) -> DataFrame:
    """``docs`` with each secret span of ``text`` replaced by ``mask`` and ``n_chars``, if there, counted anew.

    Every row and column stays; null texts stay null; rows that repeat, and those with a null id, are masked like others; spans that overlap become one mask. An empty table stays empty. Columns
    may have any names but those used inside: ``__furrow_id``, ``__furrow_dig``, ``__furrow_spans`` and ``__furrow_d``.
    """
    spans = find_secrets(docs, scope=scope).where(F.size("spans") > 0).select(F.col("doc_id").alias("__furrow_id"), F.col("dig").alias("__furrow_dig"), F.col("spans").alias("__furrow_spans"))
    spans = stage_table(spans.dropDuplicates(["__furrow_id", "__furrow_dig"]), "redactions")
    marked = docs.withColumn("__furrow_d", F.xxhash64(text_of()))
    held = marked.join(spans, marked["doc_id"].eqNullSafe(spans["__furrow_id"]) & (marked["__furrow_d"] == spans["__furrow_dig"]), "left")
    text = F.col("text")
    masked = F.aggregate(
        "__furrow_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    held = held.withColumn("text", F.when(F.col("__furrow_spans").isNotNull(), masked).otherwise(text))
    if "n_chars" in docs.columns:
        held = held.withColumn("n_chars", F.when(F.col("__furrow_spans").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return held.select(*docs.columns)
