"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Everything is an expression over one row, so the plan is scan -> project: no shuffle, and a document's
cost is in proportion to its length (times a logarithm for the sort of its windows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import WS, WS_CHARS, text_of

SYMBOLS = "#*$%&|<>"
#: Function words of the corpus's languages; any text of prose has some of them.
STOP_WORDS = (
    "the of and to in is that for it with as was on be by this are from or an at not "
    "der die das und ist in den von zu mit sich auf für nicht ein eine dem im des als auch "
    "el la de que y en los del se las por un para con no una su al es lo "
    "le les et des du dans qui est pour sur pas par une au avec ce"
).split()

#: (measure, divided by, comparison that rejects, threshold, fewest words the rule looks at)
RULES = (
    ("n_words", None, "<", 10, 0),
    ("word_chars", "n_words", ">", 40.0, 0),
    ("n_symbols", "word_chars", ">", 0.15, 0),
    ("n_stop", "n_words", "<", 0.05, 60),
    ("n_dup_lines", "n_lines", ">", 0.5, 50),
)


def _measures(text: Column) -> dict[str, Column]:
    words = F.split(F.btrim(text, F.lit(WS_CHARS)), f"[{WS}]+")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)
    return {
        "_text": text,
        "_words": F.when(F.length(F.btrim(text, F.lit(WS_CHARS))) == 0, F.array().cast("array<string>")).otherwise(words),
        "_lines": lines,
    }


def _repeats(words: str, hash_bits: int = 40) -> str:
    """Words inside five-word windows that are found twice or more in the text, as one SQL expression.

    A window is packed into a long: 40 bits of its hash over 24 bits of its place. Sorted, equal windows stand side by
    side. Neighbours whose hashes agree are compared by their words; if some have other words, equal windows needn't be
    neighbours, and the text's windows themselves are sorted. So are those of texts over 2**24 words.
    """
    mask = ((1 << hash_bits) - 1) << 24
    mask -= 1 << 64 if mask >= 1 << 63 else 0
    window = f"slice({words}, cast({{}} as int), 5)"
    # places (from 1) of the windows, sorted by hash
    keys = f"sort_array(transform(sequence(1, size({words}) - 4), i -> (xxhash64({', '.join(f'{words}[i + {k}]' for k in range(-1, 4))}) & {mask}) | i))"
    place = "(k & 16777215)"
    same = lambda other: f"((ks[j] & {mask}) = (ks[{other}] & {mask}) and {window.format('(ks[j] & 16777215)')} = {window.format(f'(ks[{other}] & 16777215)')})"
    clash = f"exists(sequence(1, size(ks) - 1), j -> (ks[j] & {mask}) = (ks[j - 1] & {mask}) and not {same('j - 1')})"
    near = f"(j > 0 and {same('j - 1')}) or (j < size(ks) - 1 and {same('j + 1')})"
    starts = f"sort_array(transform(filter(ks, (k, j) -> {near}), k -> {place}))"
    cover = "aggregate(zip_with(ss, slice(ss, 2, greatest(size(ss) - 1, 0)), (a, b) -> coalesce(least(b - a, 5L), 5L)), 0L, (x, y) -> x + y)"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    wide = f"transform(sequence(1, size({words}) - 4), i -> struct({window.format('i')} as w, cast(i as long) as i))"
    near_w = "(j > 0 and ws[j].w = ws[j - 1].w) or (j < size(ws) - 1 and ws[j].w = ws[j + 1].w)"
    long = let("ws", f"array_sort({wide})", let("ss", f"sort_array(transform(filter(ws, (k, j) -> {near_w}), k -> k.i))", cover))
    short = let("ks", keys, f"case when size(array_distinct(transform(ks, k -> k & {mask}))) = size(ks) then 0L when {clash} then {long} else {let('ss', starts, cover)} end")
    return f"case when size({words}) < 6 then 0L when size({words}) < 16777216 then {short} else {long} end"


def measure(df: DataFrame, text_col: str = "text", hash_bits: int = 40) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_stop (all long).

    A null text counts as empty: no words, no lines, all measures 0. Columns that have these names are replaced; ``_text``,
    ``_words`` and ``_lines`` are used inside and dropped. The result doesn't depend on ``hash_bits``.
    """
    held = df.withColumns(_measures(text_of(text_col)))
    held = held.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.translate("_text", WS_CHARS, "")).cast("long"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.expr(_repeats("_words", hash_bits)),
        "n_stop": F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
    })
    return held.drop("_text", "_words", "_lines")


def compiled(rules=RULES) -> Column:
    """The table as one boolean expression: true if a rule rejects the row."""
    rejected = F.lit(False)
    for name, over, op, limit, least in rules:
        value = F.col(name) if over is None else F.col(name) / F.when(F.col(over) > 0, F.col(over))
        hit = value < limit if op == "<" else value > limit
        rejected = rejected | F.coalesce((F.col("n_words") >= least) & hit, F.lit(False))
    return rejected


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """One row for each row of ``df``: measures, base_failed and kept. Repeated rows and null ids pass through, a null text has no words and fails the base rule.

    An empty table gives no rows; other columns, whatever their names, are left out.
    """
    held = measure(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_source")), "_source")
    base = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    held = held.withColumn("base_failed", base)
    return held.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~compiled(rules)).alias("kept"), "n_lines", "n_stop",
    )
