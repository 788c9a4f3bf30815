"""Personal data by weak supervision, in DataFrame functions only.

Base kinds (email, ip, card, phone) have a pattern and a test, and stay. Other kinds (names, spelt-out addresses of mail, local numbers,
identity numbers, account numbers, dates of birth, street addresses, hardware addresses) have wide patterns that alone say little. Each match of
any kind is a candidate on which five labelers vote yes, no or not at all:

- two by regular expressions: the strict form of the kind, and a test (check digits, ranges);
- one by gazetteers: given names, countries, street words, top-level domains, issuers;
- two by context: cue words before the match, and how it stands in its line.

Candidates are counted by kind, votes and shape; of such patterns there are at most kinds x 3**5 x 2**5, whatever the number of documents. On
the counts, expectation-maximisation estimates the labelers' reliabilities and each kind's share of true candidates (weak priors keep
rare kinds in place), and a logistic regression over votes, shape and kind is trained with the posteriors as labels. Both are folds
over the one row that holds the patterns. A candidate of another kind is reported if the classifier gives it ``least`` or more, a gazetteer or cue
word supports it, two of the three sorts of labelers vote for it, and no base span overlaps it.

Candidates are found and labelled where the document is; only the patterns, and the spans of documents with reported
candidates, shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from furrow.llm.common import stage_table, text_of

# The patterns of the base kinds. Possessive, and begun only where a run of the first class begins, they find the same
# matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Gazetteers, small ones; a larger list only raises recall.
GIVEN = (
    "Alexander Andreas Angela Anna Anne Antonio Barbara Carlos Carmen Catherine Charles Charlotte Christian Christine Claire Claudia Daniel David Elena Elisabeth Elizabeth Emily Emma "
    "Francisco François Frank George Hannah Hans Heinrich Helen Isabel Jack James Jane Javier Jean Jennifer Jessica Johann John Jorge José Joseph Juan Julia Julie Karl Katharina Klaus Laura "
    "Linda Lisa Louis Lucas Lucía Luis Manuel Margaret Maria María Marie Mark Martin Mary Matthew Maximilian Michael Miguel Nathalie Nicolas Olivia Patricia Paul Pedro Peter Philippe Pierre "
    "Richard Robert Sabine Sarah Sebastian Sofia Sophie Stefan Stephanie Susan Susanne Thomas Ursula Wolfgang William"
).split()
COUNTRIES = "AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 358 420 421".split()
DOMAINS = "com org net edu gov info io co uk de fr es it nl eu at ch be pt pl se no fi dk us ca au jp in br mx".split()
STREET = r"(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|Court|St\.|Ave\.|Rd\.|Blvd\.)"
TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Mme|Sr|Sra)\.\x20|(?:Herr|Frau|Monsieur|Madame|Señor|Señora)\x20"
_UPPER = r"\p{Lu}\p{Ll}++"
_NO = r"(?i)\b(?:version|release|build|isbn|issn|doi|order|invoice|chapter|page|figure|table|section|score|ratio|serial|part)\b"

Expression = Callable[[Column], Column]


class Kind(NamedTuple):
    """A kind of span. The labelers' expressions are of the match; None abstains."""

    name: str
    pattern: str
    cues: str
    strict: str
    test: Expression | None = None
    listed: Expression | None = None
    #: What a document must hold for a match to be possible.
    needs: str | None = None
    good: Expression | None = None


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Of up to 19 digits: every second one from the right is doubled, less 9 if over 9."""

    def total(d: Column) -> Column:
        each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
        return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0

    return _let(_digits(m), lambda d: F.when(F.length(d).between(16, 19), total(d)).otherwise(False))


def _iban(m: Column) -> Column:
    """The number whose letters count as 10 to 35 and whose first four characters come last is 1 modulo 97."""
    moved = _let(F.regexp_replace(m, "\x20", ""), lambda s: F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda r, c: _let(value(c), lambda v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _day(m: Column) -> Column:
    """A day, a month and a year of a living person, in either order."""
    n = lambda i: F.get(F.split(m, "[./-]"), F.lit(i)).cast("int")
    year = lambda y: y.between(1900, 2030)
    return (year(n(0)) & n(1).between(1, 12) & n(2).between(1, 31)) | (year(n(2)) & ((n(0).between(1, 31) & n(1).between(1, 12)) | (n(1).between(1, 31) & n(0).between(1, 12))))


def _first(m: Column) -> Column:
    """First word of a name, without a title."""
    return F.substring_index(F.regexp_replace(m, f"^(?:{TITLE})", ""), " ", 1)


_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_PLAIN_OCTET = "(?:0|[1-9][0-9]{0,2})"
KINDS = (
    Kind("email", EMAIL, r"e-?mail|mail|contact|write|correo|courriel|kontakt", r"^[A-Za-z0-9][^@]*@[^@]+\.[A-Za-z]{2,}$", None, lambda m: F.lower(F.substring_index(m, ".", -1)).isin(DOMAINS), "@", lambda m: F.lit(True)),
    Kind("ip", IP, r"ip|address|host|login|logged|client|server|adresse", rf"^{_PLAIN_OCTET}(?:\.{_PLAIN_OCTET}){{3}}$", lambda m: ~m.rlike(r"^(?:0|127|2[2-5][0-9])\."), None, ".", lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    Kind("card", CARD, r"card|visa|mastercard|credit|debit|karte|tarjeta|carte", r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?$", _luhn, lambda m: m.rlike("^[2-6]"), None, _luhn),
    Kind("phone", PHONE, r"phone|telephone|tel|call|mobile|cell|fax|whatsapp|telefon|teléfono|téléphone", r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]", lambda m: ~m.rlike(r"[().\x20-]{3,}"), lambda m: F.substring_index(F.regexp_replace(m, r"^\+", ""), " ", 1).isin(CALLING), "+", lambda m: F.length(_digits(m)).between(8, 15)),
    Kind("name", rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{TITLE}){_UPPER}(?:\x20{_UPPER}){{0,2}}+|{_UPPER}(?:\x20{_UPPER}){{1,2}}+)(?![\p{{L}}\p{{N}}_])", r"name|named|signed|author|contact|sincerely|regards|dear|herr|frau|señor|señora|monsieur|madame|nombre|nom", r"^.{5,40}$", None, lambda m: _first(m).isin(GIVEN) | m.rlike(f"^(?:{TITLE})")),
    Kind("mail_words", r"(?i)(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}\x20?[\[(]?\x20?at\x20?[\])]?\x20[A-Za-z0-9-]{2,40}\x20?[\[(]?\x20?(?:dot|\.)\x20?[\])]?\x20?(?:com|org|net|edu|de|fr|es)\b", r"e-?mail|mail|contact|write|reach", r"(?i)[\[(]at[\])]|\sdot\s", None, lambda m: m.rlike(r"(?i)[\[(]\x20?at\x20?[\])]"), None),
    Kind("phone_local", r"(?<![0-9+().-]|[0-9+()-]\x20)(?:\([0-9]{3,5}\)\x20?|[0-9]{3,5}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,5}(?![0-9.-]|\x20[0-9])", r"phone|telephone|tel|call|mobile|cell|fax|whatsapp|telefon|teléfono|téléphone", r"^\(?0?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}$", lambda m: F.length(_digits(m)).between(9, 14)),
    Kind("identity", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"ssn|social|security|identity|tax|insurance", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), None, "-"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"iban|account|bank|transfer|konto|cuenta|compte", r"^[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?$", _iban, lambda m: F.substring(m, 1, 2).isin(COUNTRIES)),
    Kind("birth", r"(?<![0-9./-])(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4})(?![0-9/-])", r"born|birth|birthday|dob|geboren|geburtsdatum|nacido|nacida|né|née|naissance", r"^[0-9]{1,4}([./-])[0-9]{1,2}\1[0-9]{1,4}$", _day),
    Kind("address", rf"(?<![0-9\p{{L}}])[0-9]{{1,5}}\x20(?:{_UPPER}\x20){{1,3}}?{STREET}|(?<![\p{{L}}])\p{{Lu}}\p{{Ll}}+(?<=straße|strasse|gasse|allee)\x20[0-9]{{1,4}}[a-z]?(?![0-9\p{{L}}])|(?<![0-9])[0-9]{{1,4}},?\x20(?:rue|avenue|boulevard)\x20(?:de\x20|du\x20|des\x20|la\x20)*+{_UPPER}", r"address|lives|living|resident|residing|adresse|wohnt|wohnhaft|domicilio|home", r"[0-9]", None, lambda m: F.lit(True)),
    Kind("hardware", r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])", r"mac|device|hardware|ethernet|wifi|bluetooth", r"^(?:[0-9a-f:]+|[0-9A-F:]+|[0-9A-F-]+)$", lambda m: ~m.rlike("(?i)^(?:00[:-]){5}00$|^(?:ff[:-]){5}ff$")),
)
BASE = 4
LABELERS = ("form", "test", "listed", "cue", "setting")
_SHAPE = 5
_BITS = 2 * len(LABELERS) + _SHAPE
_SPAN = "struct<no:int,start:int,end:int,key:int>"
_LEFT, _RIGHT = 40, 24


def _ends(sizes: Column) -> Column:
    """Running sums, in blocks of 64."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 64).cast("int")), lambda k: F.slice(sizes, k * 64 + 1, F.lit(64)))

    def placed(blocks: Column) -> Column:
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda out, b: F.concat(out, F.array(F.element_at(out, -1) + F.aggregate(b, F.lit(0), lambda n, x: n + x))))
        inside = lambda b: F.slice(F.aggregate(b, F.array(F.lit(0)), lambda out, x: F.concat(out, F.array(F.element_at(out, -1) + x))), 2, F.size(b))
        return _let(before, lambda at: F.flatten(F.transform(blocks, lambda b, k: F.transform(inside(b), lambda x: x + F.get(at, k)))))

    return _let(cut, placed)


def _key(kind: Kind, number: int, m: Column, left: Column, right: Column) -> Column:
    """Kind, votes (five bits of yes, five of no) and shape of a candidate in one number."""
    yes_no = lambda c: (F.coalesce(c, F.lit(False)), F.coalesce(~c, F.lit(False)))
    never = (F.lit(False), F.lit(False))
    cue, other = left.rlike(rf"(?i)\b(?:{kind.cues})\b"), left.rlike(_NO)
    inline = left.rlike(r"[\p{L}\p{N},]\x20\z") | left.rlike(r"[:=(<\[\"]\x20?\z")
    within = left.rlike(r"[\p{L}\p{N}_/@.]\z") | right.rlike(r"^[\p{L}\p{N}_/@]")
    votes = [
        yes_no(m.rlike(kind.strict)),
        yes_no(kind.test(m)) if kind.test else never,
        yes_no(kind.listed(m)) if kind.listed else never,
        (cue, other & ~cue),
        (inline & ~within, within),
    ]
    shape = [F.length(m) > 14, F.length(_digits(m)) * 2 >= F.length(m), m.rlike(r"[\x20./-]"), right.rlike(r"^(?:[\x20\n]|[.,;)]|\z)"), left.rlike(r"(?:^|\n)[\x20\t]*\z")]
    bits = [v[0] for v in votes] + [v[1] for v in votes] + shape
    out = F.lit(number << _BITS)
    for k, b in enumerate(bits):
        out = out + F.when(b, 1 << k).otherwise(0)
    return out


def _candidates(text: Column, number: int) -> Column:
    """All candidates of a kind in a text, each with its place and key."""
    kind = KINDS[number]
    none = F.array().cast(f"array<{_SPAN}>")

    def spans(ms: Column, gaps: Column) -> Column:
        sizes = F.transform(ms, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))

        def span(m: Column, i: Column, ends: Column) -> Column:
            left, right = F.substring(F.get(gaps, i), -_LEFT, _LEFT), F.substring(F.get(gaps, i + 1), 1, _RIGHT)
            key = _key(kind, number, m, left, right)
            end = F.get(ends, i)
            whole = F.struct(F.lit(number).alias("no"), (end - F.length(m)).alias("start"), end.alias("end"), key.alias("key"))
            return whole if kind.good is None else F.when(kind.good(m), whole)

        return _let(_ends(sizes), lambda ends: F.filter(F.transform(ms, lambda m, i: span(m, i, ends)), lambda x: x.isNotNull()))

    found = _let(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), lambda ms: F.when(F.size(ms) == 0, none).otherwise(_let(F.split(text, kind.pattern, -1), lambda gaps: spans(ms, gaps))))
    return found if kind.needs is None else F.when(F.contains(text, F.lit(kind.needs)), found).otherwise(none)


def _patterns(found: DataFrame) -> DataFrame:
    """(key, n) of all candidates, counted in each task before they shuffle."""
    return found.select(F.explode(F.concat("base", "weak")).alias("s")).groupBy(F.col("s.key").alias("key")).agg(F.count("*").alias("n"))


def _sum(rows: Column, body: Callable[[Column], Column]) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda s, x: s + body(x))


def _logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


#: Before any data: the share of true candidates of base and other kinds, a yes of true and of false candidates, and the candidates that these count for.
PRIORS, YES, WEIGHT = (0.9, 0.2), (0.85, 0.25), 20.0


def reliabilities(patterns: Column, rounds: int = 25) -> Column:
    """Expectation-maximisation over patterns (no, votes, n).

    Of a labeler two numbers are estimated, the chance that it says yes of a true and of a false candidate if it votes at all, and of each kind the
    share of true ones. The result lists the kinds' shares, and the two numbers of each labeler.
    """
    kinds, many = len(KINDS), len(LABELERS)
    start = [PRIORS[k >= BASE] for k in range(kinds)] + [x for _ in LABELERS for x in YES]

    def weighed(state: Column, x: Column) -> Column:
        share = F.get(state, x["no"])
        z = F.log(share / (1 - share))
        for j in range(many):
            t, f = F.get(state, F.lit(kinds + 2 * j)), F.get(state, F.lit(kinds + 2 * j + 1))
            says = x["votes"].bitwiseAND(F.lit((1 << j) | (1 << (many + j))))
            z = z + F.when(says == (1 << j), F.log(t / f)).when(says == (1 << (many + j)), F.log((1 - t) / (1 - f))).otherwise(0.0)
        return F.struct(x["no"].alias("no"), x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * _logistic(z)).alias("t"))

    def step(state: Column, _: Column) -> Column:
        def estimates(rows: Column) -> Column:
            out = []
            for k in range(kinds):
                own = lambda x, k=k: x["no"] == k
                out.append((_sum(rows, lambda x, own=own: F.when(own(x), x["t"]).otherwise(0.0)) + WEIGHT * start[k]) / (_sum(rows, lambda x, own=own: F.when(own(x), x["n"]).otherwise(0.0)) + WEIGHT))
            for j in range(many):
                yes = lambda x, j=j: x["votes"].bitwiseAND(F.lit(1 << j)) > 0
                voted = lambda x, j=j: x["votes"].bitwiseAND(F.lit((1 << j) | (1 << (many + j)))) > 0
                for part, prior in ((lambda x: x["t"], YES[0]), (lambda x: x["n"] - x["t"], YES[1])):
                    top = _sum(rows, lambda x, yes=yes, part=part: F.when(yes(x), part(x)).otherwise(0.0)) + WEIGHT * prior
                    out.append(top / (_sum(rows, lambda x, voted=voted, part=part: F.when(voted(x), part(x)).otherwise(0.0)) + WEIGHT))
            return F.array(*[F.least(F.greatest(x, F.lit(0.001)), F.lit(0.999)) for x in out])

        return _let(F.transform(patterns, lambda x: weighed(state, x)), estimates)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(x) for x in start]), step)


def posterior(state: Column, no: Column, votes: Column) -> Column:
    kinds, many = len(KINDS), len(LABELERS)
    share = F.get(state, no)
    z = F.log(share / (1 - share))
    for j in range(many):
        t, f = F.get(state, F.lit(kinds + 2 * j)), F.get(state, F.lit(kinds + 2 * j + 1))
        z = z + F.when(votes.bitwiseAND(F.lit(1 << j)) > 0, F.log(t / f)).when(votes.bitwiseAND(F.lit(1 << (many + j))) > 0, F.log((1 - t) / (1 - f))).otherwise(0.0)
    return _logistic(z)


def _linear(weights: Column, x: Column) -> Column:
    z = F.get(weights, x["no"])
    for k in range(_BITS):
        z = z + F.when(x["bits"].bitwiseAND(F.lit(1 << k)) > 0, F.get(weights, F.lit(len(KINDS) + k))).otherwise(0.0)
    return z


def classifier(rows: Column, rounds: int = 40, ridge: float = 1.0) -> Column:
    """Weights of a logistic regression over rows (no, bits, n, label): one of each kind, one of each bit.

    All weights move at once, each by its gradient over a bound of its curvature (its features' number times the variance), so that a step can't overshoot far.
    """

    def step(weights: Column, _: Column) -> Column:
        def one(x: Column) -> Column:
            return _let(_logistic(_linear(weights, x)), lambda p: F.struct(x["no"].alias("no"), x["bits"].alias("bits"), (x["n"] * (x["label"] - p)).alias("g"), (x["n"] * p * (1 - p) * (F.bit_count(x["bits"]) + 1)).alias("h")))

        def moved(each: Column) -> Column:
            out = []
            for k in range(len(KINDS) + _BITS):
                on = (lambda x, k=k: x["no"] == k) if k < len(KINDS) else (lambda x, k=k: x["bits"].bitwiseAND(F.lit(1 << (k - len(KINDS)))) > 0)
                w = F.get(weights, F.lit(k))
                g = _sum(each, lambda x, on=on: F.when(on(x), x["g"]).otherwise(0.0))
                out.append(w + (g - ridge * w) / (_sum(each, lambda x, on=on: F.when(on(x), x["h"]).otherwise(0.0)) + ridge))
            return F.array(*out)

        return _let(F.transform(rows, one), moved)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(*[F.lit(0.0)] * (len(KINDS) + _BITS)), step)


def _supported(bits: Column) -> Column:
    """A gazetteer or cue word says yes, and so do two sorts of labelers."""
    yes = lambda *js: bits.bitwiseAND(F.lit(sum(1 << j for j in js))) > 0
    sorts = F.when(yes(0, 1), 1).otherwise(0) + F.when(yes(2), 1).otherwise(0) + F.when(yes(3, 4), 1).otherwise(0)
    return yes(2, 3) & (sorts >= 2)


def fitted(patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """One row: the labelers' reliabilities, the classifier's weights and the keys of candidates that are reported."""
    votes = F.lit((1 << (2 * len(LABELERS))) - 1)
    rows = patterns.select("key", F.floor(F.col("key") / (1 << _BITS)).cast("int").alias("no"), F.col("key").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("bits"), F.col("n").cast("double").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("key", "no", "bits", F.col("bits").bitwiseAND(votes).alias("votes"), "n")))
    one = rows.agg(listed.alias("rows"))
    one = stage_table(one.select("rows", reliabilities(F.col("rows")).alias("labelers")), "labelers")
    labelled = F.transform("rows", lambda x: F.struct(x["key"].alias("key"), x["no"].alias("no"), x["bits"].alias("bits"), x["n"].alias("n"), posterior(F.col("labelers"), x["no"], x["votes"]).alias("label")))
    one = stage_table(one.select("labelers", labelled.alias("rows")).select("labelers", "rows", classifier(F.col("rows")).alias("weights")), "classifier")
    reported = F.filter("rows", lambda x: (x["no"] >= BASE) & _supported(x["bits"]) & (_logistic(_linear(F.col("weights"), x)) >= least))
    return one.select("labelers", "weights", F.transform(reported, lambda x: x["key"]).alias("keys"))


def _disjoint(rows: DataFrame) -> DataFrame:
    """(doc_id, dig, more): reported candidates that no base span overlaps, of documents that have some."""
    parts = rows.select("doc_id", "dig", F.explode(F.concat("base", "more")).alias("s")).distinct()
    parts = parts.select("doc_id", "dig", "s", F.col("s.start").alias("b"), F.col("s.end").alias("e"), (F.col("s.no") < BASE).alias("sure"))
    ahead = W.partitionBy("doc_id", "dig").orderBy("b", "s.no").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("doc_id", "dig").orderBy(F.desc("b"), F.desc("s.no")).rowsBetween(W.unboundedPreceding, -1)
    over = (F.max(F.when(F.col("sure"), F.col("e"))).over(ahead) > F.col("b")) | (F.min(F.when(F.col("sure"), F.col("b"))).over(behind) < F.col("e"))
    kept = parts.withColumn("_over", F.coalesce(over, F.lit(False))).where("not _over and not sure")
    return kept.groupBy(F.col("doc_id").alias("_id"), F.col("dig").alias("_dig")).agg(F.sort_array(F.collect_list("s")).alias("_more"))


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row for each row of ``df``: doc_id, dig (of the text), base, more (arrays of no, start, end, key; by kind, then start).

    A null text counts as empty; null ids pass through; rows that repeat id and text get the same spans. An empty table gives no rows
    and trains on nothing. Other columns, whatever their names, are left out. Texts are read whole, in time in proportion to their length and
    (times a logarithm) their candidates.
    """
    held = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("_t"))
    t = F.col("_t")
    base, weak = F.concat(*[_candidates(t, k) for k in range(BASE)]), F.concat(*[_candidates(t, k) for k in range(BASE, len(KINDS))])
    found = stage_table(held.select("doc_id", F.xxhash64("_t").alias("dig"), base.alias("base"), weak.alias("weak")), "candidates")
    model = stage_table(fitted(stage_table(_patterns(found), "patterns"), least), "reported")
    keys = model.select("keys").scalar()
    rows = found.withColumn("_keys", keys).withColumn("more", F.filter("weak", lambda s: F.array_contains("_keys", s["key"]))).select("doc_id", "dig", "base", "more")
    bare = rows.where(F.size("more") == 0)
    some = rows.where(F.size("more") > 0)
    clear = _disjoint(some)
    same = some["doc_id"].eqNullSafe(clear["_id"]) & (some["dig"] == clear["_dig"])
    held = some.join(clear, same, "left").select("doc_id", "dig", "base", F.coalesce("_more", F.array().cast(f"array<{_SPAN}>")).alias("more"))
    return bare.unionByName(held)


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["no"]), s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans, one row for each row of ``df``; cases as in ``find_personal``."""
    count = lambda no: F.size(F.filter("base", lambda s: s["no"] == no)).cast("long").alias(f"n_{KINDS[no].name}")
    return find_personal(df, least=least).select(
        "doc_id", *[count(k) for k in range(BASE)], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_added"),
    )
