from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import collocations, filter_audit
from furrow.llm.common import ship
from tests_llm_support import odd_rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


# op12


def audit(rows: list[tuple], labels: dict[int, tuple[int, int]]) -> dict:
    """By applying each order to the documents themselves."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = defaultdict(list)
    for i, t, _, source in rows:
        t = t or ""
        w = WORD.findall(t)
        copy = t in least and (i is None or i > least[t])
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        docs[source or ""].append(({k for k, v in fails.items() if v}, *labels.get(i, (0, 0))))
    out, shapley = {}, Counter()
    for part, all_ in docs.items():
        for order in permutations("ABCDE"):
            left = all_
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                fail = [d for d in all_ if f in d[0]]
                shapley[part, f] += len(gone)
                left = [d for d in left if f not in d[0]]
                out[part, "".join(order), step] = [len(left), len(gone), len(fail) - len(gone), sum(d[0] == {f} for d in all_), sum(d[1] for d in gone), sum(d[2] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_applying_the_orders(spark):
    r = random.Random(5)
    say = lambda n, words: " ".join(r.choice(words) for _ in range(n))
    many, few = [f"w{i}" for i in range(900)], ["a", "b", "C#"]
    rows = [(i, say(r.choice([3, 150, 260]), r.choice([many, few])).upper() if i % 7 == 0 else say(r.choice([150, 260]), r.choice([many, few])) + r.choice(["", " $"]), "en", r.choice(["x", "y", "", None])) for i in range(150)]
    rows += [(r.randrange(-50, 400), t, "en", r.choice(["x", "z"])) for _, t, _, _ in r.sample(rows, 80)] + [(None, None, None, None), (None, rows[3][1], None, "x"), (7, None, None, "x"), (8, "", None, "y"), (8, "", None, "x")]
    labels = {i: (r.randint(0, 1), r.randint(0, 1)) for i in range(-50, 400, 2)}
    lab = spark.createDataFrame([(k, *v) for k, v in labels.items()] + [(2, None, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.filter_audit(spark.createDataFrame(rows, DOCS).repartition(5), lab).collect()
    want = audit(rows, labels)
    assert len(got) == len(want) == 600 * 4
    assert {(g["part"], g["filter_order"], g["step"]): (g["kept"], g["removed"], g["redundant"], g["unique_fails"], g["good_lost"], g["toxic_lost"], g["shapley"]) for g in got} == want


def test_audit_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(i, t, None, "s") for i, t in odd_rows()]
    got = filter_audit.filter_audit(odd, labels.withColumn("mask", F.lit("q"))).collect()
    assert {(g["part"], g["filter_order"], g["step"]): g["kept"] for g in got} == {k: v[0] for k, v in audit(rows, {}).items()}
    assert all(type(g["kept"]) is int and type(g["shapley"]) is int for g in got)
    assert filter_audit.filter_audit(empty, labels).count() == 0
    assert filter_audit.filter_audit(odd, labels.limit(0)).count() == 600


# op13


def mined(rows: list[tuple], least: int, top: int = 2000) -> dict[str, list[tuple]]:
    n, f = Counter(), defaultdict(Counter)
    for _, t, lang, _ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, count in f.items():
        held = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in held.items():
            if any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in held.items() if len(q) > len(p)):
                continue
            score, _, left, right = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out[lang] = [(k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return {k: v for k, v in out.items() if v}


def by_lang(df) -> dict[str, list[tuple]]:
    out = defaultdict(list)
    for x in df.orderBy("lang", "rank").collect():
        out[x["lang"]].append((x["rank"], x["phrase"], x["a"], x["l"], x["r"], x["n"], x["score"]))
    return dict(out)


def prose(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = [f"W{i}" for i in range(12)] + ["the", "of", "ß", "日本", "\x1c", "É"]
    fixed = [["new", "York", "city", "hall"], ["at", "the", "end"], ["run", "out"]]
    rows = []
    for i in range(250):
        w = []
        for _ in range(r.randint(0, 40)):
            w += r.choice(fixed) if r.random() < 0.3 else [r.choice(words)]
        rows.append((i % 90, "".join(x + r.choice([" "] * 8 + ["\t ", ", ", "\n", ".", "!?"]) for x in w), r.choice(["en", "en", "en", "de", None]), "s"))
    return [*rows, (1, None, "en", None), (2, "", None, None), (None, "a a a a a a " * 30, "fr", None)]


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 15])
def test_collocations_equal_brute_force(spark, max_bits):
    """With few bits the filter is cut into ranges, and lets much through; the result is the same."""
    rows = prose(1)
    got = by_lang(collocations.collocations(spark.createDataFrame(rows, DOCS).repartition(4), least=6, top=40, max_bits=max_bits))
    want = mined(rows, 6, 40)
    assert got == want and len(want["en"]) == 40 and any(len(p[1].split()) == 4 for p in want["en"])


def test_collocations_odd_rows(odd, empty):
    rows = [(i, t, None, "s") for i, t in odd_rows()]
    assert by_lang(collocations.collocations(odd)) == mined(rows, 30)
    assert collocations.collocations(empty).count() == 0


def test_shards_are_cut_between_words_and_phrases_across_a_cut_count_once():
    text = ("new york city hall. " + "a b\tc,d e f g h i " * 3 + "longword" * 9 + "\nx y z " * 4).encode()
    whole = collocations.Shard.of(text)
    for most in (5, 17, 40, 1000):
        got = Counter()
        for data, skip in collocations.blocks(text, most):
            shard = collocations.Shard.of(data)
            automaton = collocations.Automaton(shard, skip)
            for k in (2, 3, 4):
                states = automaton.deepen()
                got.update(dict(zip(automaton.phrases(states).to_pylist(), states.count.tolist(), strict=True)))
        automaton, want = collocations.Automaton(whole), Counter()
        for k in (2, 3, 4):
            states = automaton.deepen()
            want.update(dict(zip(automaton.phrases(states).to_pylist(), states.count.tolist(), strict=True)))
        assert got == want


def test_suffix_links_and_endpos_counts():
    words = "a b c a b d a b c b c".split()
    automaton = collocations.Automaton(collocations.Shard.of(" ".join(words).encode()))
    spelt = {1: automaton.shard.known.to_pylist()}
    for k in (2, 3, 4):
        states = automaton.deepen()
        spelt[k] = automaton.phrases(states).to_pylist()
        for s, text in enumerate(spelt[k]):
            want = text.decode().split()
            assert states.count[s] == sum(words[i : i + k] == want for i in range(len(words)))
            assert spelt[k - 1][states.link[s]].decode().split() == want[1:]


def test_shards_hold_all_texts_once():
    r = random.Random(2)
    texts = [(r.choice(["en", "de"]), " ".join(r.choice("abcde") for _ in range(r.choice([0, 5, 900])))) for _ in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1].encode() for x in part])], ["lang", "text"]) for part in (texts[:20], texts[20:])]
    got, want = Counter(), Counter()
    for lang, data, skip in collocations.shards(iter(batches), 1000):
        automaton = collocations.Automaton(collocations.Shard.of(data), skip)
        states = automaton.deepen()
        got.update({(lang, p): n for p, n in zip(automaton.phrases(states).to_pylist(), states.count.tolist(), strict=True)})
    for lang, t in texts:
        w = t.split()
        want.update((lang, f"{a} {b}".encode()) for a, b in zip(w, w[1:], strict=False))
    assert got == want
