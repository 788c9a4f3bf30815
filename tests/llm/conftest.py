from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from tests_llm_support import odd_rows  # noqa: E402

CLASHING = ["key", "did", "sha", "node", "dig", "row", "page", "bits", "rep", "spans", "root", "print", "length", "__furrow_x"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None, "s", None, *["q"] * len(CLASHING)) for i, t in odd_rows()]
    names = ["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{c}` string" for c in CLASHING)]
    return spark.createDataFrame(rows, ", ".join(names))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """600 made documents with copies, near copies and shared passages; and their rows."""
    r = random.Random(3)
    words = [f"{a}{b}" for a in "kstnmrl" for b in ("a", "o", "en", "ing", "er", "ion", "ti")] + ["the", "of", "and"]
    say = lambda n: [r.choice(words) for _ in range(n)]
    shared, texts = say(40), []
    for i in range(600):
        kind = i % 6
        if kind == 0 or i < 6:
            w = say(r.randint(0, 150))
        elif kind == 1:
            w = texts[r.randrange(len(texts))].split(" ")
        elif kind in (2, 3):
            w = list(texts[r.randrange(len(texts))].split(" "))
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(words)
        elif kind == 4:
            w = say(r.randint(5, 60)) + shared[: r.randint(15, 40)] + say(r.randint(0, 60))
        else:
            w = say(r.randint(3, 30)) * 2
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows
