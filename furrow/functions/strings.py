"""Text parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def key(text: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


_NUMBERED = r"&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});"


def numbered_entities(text: Column) -> Column:
    """``&#8364;`` and ``&#x20AC;`` as their characters; numbers that are no character stay as they are."""
    found = F.regexp_extract_all(text, F.lit(_NUMBERED), F.lit(0))

    def char(e: Column) -> Column:
        hex_ = F.lower(F.substring(e, 3, 1)) == "x"
        code = F.when(hex_, F.conv(F.regexp_extract(e, "([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+);", 1)).cast("int")
        good = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(e)

    pieces = F.split(text, _NUMBERED, -1)
    joined = F.array_join(F.zip_with(pieces, F.transform(found, char), lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&#"), joined).otherwise(text)


def strip_tags(html: Column) -> Column:
    """A text without tags; its entities, named and numbered, as characters."""
    out = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in ENTITIES.items():
        if entity != "&amp;":
            out = F.replace(out, F.lit(entity), F.lit(char))
    return F.replace(numbered_entities(out), F.lit("&amp;"), F.lit("&"))


def number_text(value: Column, digits: int) -> Column:
    """A number with fixed digits, ``n/a`` for null, NaN and infinities."""
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(good, F.format_string(f"%.{digits}f", value.cast("double"))).otherwise("n/a")


def matching_lines(text: Column, patterns: dict[str, str]) -> Column:
    """Array of (line, pattern): numbers from 1 of the lines that match, with the names of the patterns they match."""
    lines = F.split(text, "\n")

    def hits(name: str, pattern: str) -> Column:
        marked = F.transform(lines, lambda x, i: F.when(x.rlike(pattern), F.struct((i + 1).alias("line"), F.lit(name).alias("pattern"))))
        return F.filter(marked, lambda m: m.isNotNull())

    each = [hits(name, pattern) for name, pattern in patterns.items()]
    return F.sort_array(F.concat(*each))


def first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")


def clock_seconds(text: Column) -> Column:
    """``HH:MM:SS,mmm`` (or with a point) to seconds."""
    part = lambda i: F.regexp_extract(text, r"(\d+):(\d+):(\d+)[,.](\d+)", i).try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + part(4) / 1000


def clock(seconds: Column) -> Column:
    """Seconds to ``HH:MM:SS.mmm``; from 100 hours on with as many digits as the hours have."""
    ms = F.rint(seconds * 1000).cast("long")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    whole = F.floor(ms / 1000)
    hours = F.floor(whole / 3600).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), pad(F.floor(whole / 60) % 60, 2), F.lit(":"), pad(whole % 60, 2), F.lit("."), pad(ms % 1000, 3))


def padded_id(prefix: str, n: Column, width: int = 7) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def fraction(text: Column) -> Column:
    """``30000/1001`` to a number; a plain number stays; null for a zero divisor."""
    top, bottom = F.split(text, "/")[0].try_cast("double"), F.coalesce(F.get(F.split(text, "/"), F.lit(1)), F.lit("1")).try_cast("double")
    return top / F.when(bottom != 0, bottom)
