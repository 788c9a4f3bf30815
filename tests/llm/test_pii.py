from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from furrow.llm import pii
from furrow.llm.common import ship
from tests_llm_support import odd_rows

CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
digits = lambda m: re.sub("[^0-9]", "", m)


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0


def day(m: str) -> bool:
    a, b, c = map(int, re.split("[./-]", m))
    year, dm = (lambda y: 1900 <= y <= 2030), (lambda d, m: 1 <= d <= 31 and 1 <= m <= 12)
    return (year(a) and dm(c, b)) or (year(c) and (dm(a, b) or dm(b, a)))


def iban(m: str) -> bool:
    s = m.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


GOOD = {"email": lambda m: True, "ip": lambda m: max(map(int, m.split("."))) <= 255, "card": lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 8 <= len(digits(m)) <= 15}
TESTS = {
    "ip": lambda m: not re.match(r"(?:0|127|2[2-5][0-9])\.", m), "card": GOOD["card"], "phone": lambda m: not re.search(r"[().\x20-]{3,}", m), "phone_local": lambda m: 9 <= len(digits(m)) <= 14,
    "identity": lambda m: m[:3] not in ("000", "666") and m[0] != "9" and m[4:6] != "00" and m[7:] != "0000", "iban": iban, "birth": day,
    "hardware": lambda m: not re.fullmatch(r"(?i)(?:00[:-]){5}00|(?:ff[:-]){5}ff", m),
}
LISTED = {
    "email": lambda m: m.rpartition(".")[2].lower() in pii.DOMAINS, "card": lambda m: m[0] in "23456", "phone": lambda m: m[1:].partition(" ")[0] in pii.CALLING,
    "name": lambda m: regex.sub(f"^(?:{pii.TITLE})", "", m).partition(" ")[0] in pii.GIVEN or bool(regex.match(pii.TITLE, m)), "mail_words": lambda m: bool(re.search(r"(?i)[\[(]\x20?at\x20?[\])]", m)),
    "iban": lambda m: m[:2] in pii.COUNTRIES, "address": lambda m: True,
}


def base_spans(t: str) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, p in CONTRACT.items() for m in re.finditer(p, t) if GOOD[k](m[0])]


def candidates(t: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, key), by kind and start."""
    out = []
    for no, kind in enumerate(pii.KINDS):
        found = list(regex.finditer(CONTRACT.get(kind.name, kind.pattern), t))
        for i, m in enumerate(found):
            if not GOOD.get(kind.name, lambda m: True)(m[0]):
                continue
            left = t[found[i - 1].end() if i else 0 : m.start()][-40:]
            right = t[m.end() : found[i + 1].start() if i + 1 < len(found) else len(t)][:24]
            says = lambda f: (False, False) if f is None else (f(m[0]), not f(m[0]))  # noqa: E731, B023
            cue, other = bool(regex.search(rf"(?i)\b(?:{kind.cues})\b", left)), bool(regex.search(pii._NO, left))
            inline = bool(regex.search(r"[\p{L}\p{N},]\x20\z", left) or regex.search(r"[:=(<\[\"]\x20?\z", left))
            within = bool(regex.search(r"[\p{L}\p{N}_/@.]\z", left) or regex.search(r"^[\p{L}\p{N}_/@]", right))
            votes = [says(lambda m, k=kind: bool(regex.search(k.strict, m))), says(TESTS.get(kind.name)), says(LISTED.get(kind.name)), (cue, other and not cue), (inline and not within, within)]
            shape = [len(m[0]) > 14, len(digits(m[0])) * 2 >= len(m[0]), bool(re.search(r"[\x20./-]", m[0])), bool(re.match(r"[\x20\n]|[.,;)]|\Z", right)), bool(re.search(r"(?:^|\n)[\x20\t]*\Z", left))]
            bits = [v[0] for v in votes] + [v[1] for v in votes] + shape
            out.append((no, m.start(), m.end(), (no << 15) + sum(b << k for k, b in enumerate(bits))))
    return out


def fit(counts: Counter) -> tuple[list[float], list[float], set[int]]:
    """The two folds as loops."""
    sigmoid = lambda z: 1 / (1 + math.exp(-max(min(z, 30), -30)))
    rows = [(key >> 15, key & 32767, n) for key, n in sorted(counts.items())]
    share, yes = [0.9] * 4 + [0.2] * 8, [[0.85, 0.25] for _ in range(5)]
    start = list(share)

    def post(no: int, bits: int) -> float:
        z = math.log(share[no] / (1 - share[no]))
        for j in range(5):
            if bits >> j & 1:
                z += math.log(yes[j][0] / yes[j][1])
            elif bits >> (5 + j) & 1:
                z += math.log((1 - yes[j][0]) / (1 - yes[j][1]))
        return sigmoid(z)

    keep = lambda x: min(max(x, 0.001), 0.999)
    for _ in range(25):
        p = [post(no, bits) * n for no, bits, n in rows]
        share = [keep((sum(t for (no, _, _), t in zip(rows, p, strict=True) if no == k) + 20 * start[k]) / (sum(n for no, _, n in rows if no == k) + 20)) for k in range(12)]
        new = []
        for j in range(5):
            pair = []
            for true, prior in ((True, 0.85), (False, 0.25)):
                w = [t if true else n - t for (_, _, n), t in zip(rows, p, strict=True)]
                said = sum(x for (_, b, _), x in zip(rows, w, strict=True) if b >> j & 1)
                voted = sum(x for (_, b, _), x in zip(rows, w, strict=True) if b >> j & 1 or b >> (5 + j) & 1)
                pair.append(keep((said + 20 * prior) / (voted + 20)))
            new.append(pair)
        yes = new
    label = [post(no, bits) for no, bits, _ in rows]
    active = [[no, *(12 + k for k in range(15) if bits >> k & 1)] for no, bits, _ in rows]
    w = [0.0] * 27
    for _ in range(40):
        g, h = [0.0] * 27, [0.0] * 27
        for (_, _, n), a, y in zip(rows, active, label, strict=True):
            q = sigmoid(sum(w[k] for k in a))
            for k in a:
                g[k] += n * (y - q)
                h[k] += n * q * (1 - q) * len(a)
        w = [x + (gk - x) / (hk + 1) for x, gk, hk in zip(w, g, h, strict=True)]
    keys = set()
    for (no, bits, _), a in zip(rows, active, strict=True):
        sorts = bool(bits & 3) + bool(bits & 4) + bool(bits & 24)
        if no >= 4 and bits & 12 and sorts >= 2 and sigmoid(sum(w[k] for k in a)) >= 0.5:
            keys.add((no << 15) + bits)
    return share + [x for pair in yes for x in pair], w, keys


def scan(texts: list[str]) -> list[tuple]:
    """What the query returns of each text, without its id."""
    found = [candidates(t) for t in texts]
    counts = Counter(c[3] for f in found for c in f)
    keys = fit(counts)[2] if counts else set()
    out = []
    for f in found:
        base = [c for c in f if c[0] < 4]
        more = [c for c in f if c[3] in keys and not any(b[1] < c[2] and c[1] < b[2] for b in base)]
        spell = lambda x: ",".join(f"{pii.KINDS[no].name}:{b}:{e}" for no, b, e, _ in x)
        out.append((*(sum(c[0] == k for c in base) for k in range(4)), hashlib.sha256(spell(base).encode()).hexdigest(), spell(base + more), len(more)))
    return out


def texts() -> list[str]:
    r = random.Random(11)
    people = ["Robert Miller", "Maria Fischer", "Of The", "Great Hall", "Dr. Anna Weber", "Herr Schmidt", "Éva Nagy"]
    things = [
        lambda: f"my name is {r.choice(people)}", lambda: f"signed {r.choice(people)}.", lambda: r.choice(people), lambda: f"phone (555) {r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: f"version {r.randint(0, 9)}.{r.randint(0, 300)}.0.1",
        lambda: f"{r.randint(100, 999)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}", lambda: "SSN 123-45-6789", lambda: "IBAN DE89 3704 0044 0532 0130 00", lambda: "GB00 WEST 1234 5698 7654 32", lambda: f"born {r.randint(1, 40)}.{r.randint(1, 14)}.{r.randint(1890, 2020)}",
        lambda: "lives at 12 Baker Street", lambda: "Hauptstraße 12", lambda: "jane.doe [at] example [dot] com", lambda: "look at example.com now", lambda: "device 00:1A:2B:3C:4D:5E", lambda: "4111 1111 1111 1111", lambda: "4111-1111-1111-1112", lambda: "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7",
        lambda: f"+{r.randint(1, 99)} ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}", lambda: "+1 22", lambda: f"{r.randint(0, 260)}.1.2.{r.randint(0, 255)}", lambda: "1.2.3.4.5.6.7.8", lambda: "000255.1.1.01", lambda: "a@b.co_x@d.org", lambda: "x..y@mail5.example.com", lambda: "%%a@b.c-@d.e@f",
    ]
    return ["".join(r.choice(things)() + r.choice([" ", ", ", ".\n", " the word ", ": "]) for _ in range(r.randint(0, 25))) for _ in range(400)]


def test_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: tuple(r)[1:] for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = dict(zip([i for i, _ in rows], scan([t for _, t in rows]), strict=True))
    assert {i: v[4] for i, v in want.items()} == {i: hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in base_spans(t)).encode()).hexdigest() for i, t in rows}
    assert got == want
    added = Counter(s.partition(":")[0] for v in want.values() for s in v[5].split(","))
    assert all(added[k] for k in ("name", "phone_local", "identity", "iban", "birth", "address", "mail_words", "hardware"))


def test_reliabilities_and_weights_equal_loops(spark):
    counts = Counter(c[3] for t in texts() for c in candidates(t))
    one = pii.fitted(spark.createDataFrame(list(counts.items()), "key int, n long")).first()
    labelers, weights, keys = fit(counts)
    assert one["labelers"] == pytest.approx(labelers, rel=1e-9) and one["weights"] == pytest.approx(weights, rel=1e-9, abs=1e-9) and set(one["keys"]) == keys


def test_plain_prose_with_capitals_has_no_spans(spark):
    r = random.Random(4)
    words = ["Haanth", "Reoush", "hewh", "Ontion", "the", "of", "That", "Ing", "Page 3", "12", "2020-01-01", "7.5", "3-4", "Name", "40 000 000 000"]
    rows = [(i, " ".join(r.choice(words) for _ in range(200))) for i in range(60)]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).select(F.sum("n_added"), F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_phone"))).first()
    assert tuple(got) == (0, 0)


def test_odd_rows(spark, odd, empty):
    got = sorted((tuple(r)[1:] for r in pii.personal_data(odd).collect()), key=str)
    assert got == sorted(scan([t or "" for _, t in odd_rows()]), key=str)
    assert pii.personal_data(empty).count() == 0


def test_very_long_runs_take_linear_time(spark):
    """Digits, letters and separators without an end, and thousands of matches in a text."""
    n = 200_000
    rows = [(1, "1" * n), (2, "1 " * n), (3, "a." * n), (4, "a" * n), (5, "+1" * n), (6, "1." * n), (7, "A b" * n), (8, "x@y.zz +1 234 567 89 10.0.0.1 " * 3000)]
    got = {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got[8] == (3000, 3000, 0, 3000) and got[6] == (0, n // 4, 0, 0) and got[1] == got[4] == (0, 0, 0, 0)
