"""A bounded memo of words for the tokenizing operators, and the cheap path for words of common characters."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

# Each Spark task has one core; the library's own threads would only contend for it.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that need no normalisation but lower-casing, and their parts under the word vocabulary's splitting rule.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÿ]+")
#: Something other than plain words and line ends.
ODD = re.compile(r"[^\x21-\x7eÀ-ÿ\n]|<\|")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Memo:
    """Two generations of up to ``most`` entries each: when the young one is full it becomes the old one.

    Entries found in the old generation move to the young one, so words in use stay and rare ones go.
    """

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Keys to learn; all others are in ``young`` afterwards."""
        new, old, young = [], self.old, self.young
        for k in keys.difference(young):
            if (v := old.get(k)) is None:
                new.append(k)
            else:
                young[k] = v
        return new

    def turn(self) -> None:
        """Between groups of texts: start a new generation if the young one is full."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


def groups(texts: list[str], most: int = 1_000_000) -> Iterable[list[str]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held
