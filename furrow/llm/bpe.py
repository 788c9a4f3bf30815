"""BPE encoding and decoding by a priority queue of merge ranks over a doubly linked list of symbols.

White-space words are independent of each other under this vocabulary (white space is dropped before the merges), so
a bounded memo holds the result of each word and the queue runs once for each new word. Text preparation
(normalisation, splitting, byte alphabet) is the library's own; the merges and the decoding are done here.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from furrow.llm.common import released
from furrow.llm.memo import PARTS, PLAIN, Memo, groups

#: Words in each generation of a worker's memo.
MEMO = 150_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in for each byte: bytes that print stand for themselves, the others follow from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.alphabet = byte_alphabet()
        self.memo, self.parts, self.blanks = Memo(MEMO), Memo(2 * MEMO), False

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge until no pair has a rank. The queue holds (rank, place, left, right); an entry whose symbols have changed is stale."""
        n, merges = len(symbols), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = [(merges[p][0], i, *p) for i in range(n - 1) if (p := (symbols[i], symbols[i + 1])) in merges]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue
            symbols[i], symbols[j] = merges[left, right][1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (p := (symbols[i], symbols[k])) in merges:
                    heapq.heappush(queue, (merges[p][0], i, *p))
            if (h := before[i]) >= 0 and (p := (symbols[h], symbols[i])) in merges:
                heapq.heappush(queue, (merges[p][0], h, *p))
        return [s for s in symbols if s >= 0]

    def _part(self, part: str) -> list[int]:
        """Ids of a part in the byte alphabet."""
        return self.merge([self.ids[s] for s in (*part[:-1], part[-1] + self.suffix)])

    def encode_word(self, word: str) -> list[int]:
        found: list[int] = []
        if PLAIN.fullmatch(word) and "<|" not in word:
            for p in PARTS.findall(word.lower()):
                if (ids := self.parts.young.get(p) or self.parts.old.get(p)) is None:
                    ids = self._part("".join(map(self.alphabet.__getitem__, p.encode())))
                self.parts.young[p] = ids
                found += ids
            return found
        for part in self.specials.split(word) if self.specials else [word]:
            if part in self.special:
                found.append(self.special[part])
            elif part:
                for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    found += self._part(p)
        return found

    def encoded(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids in decimal and their strings, each joined by one space."""
        split = [t.encode().split() for t in texts]
        for w in self.memo.missing(set().union(*split)):
            ids = self.encode_word(w.decode())
            self.memo.young[w] = b" ".join([b"%d" % i for i in ids]), self.decode(ids)
            self.blanks |= not ids
        self.parts.turn()
        get = self.memo.young.__getitem__
        for words in split:
            found = [*map(get, words)]
            if self.blanks:
                found = [x for x in found if x[0]]
            yield b" ".join([x[0] for x in found]), " ".join([x[1] for x in found])
        self.memo.turn()

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.encoded([text]) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, joined as the library does where no decoder is set: by one space."""
        return " ".join(self.strings[i] for i in ids)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each worker process."""
    return Codec(path)


def round_trip(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null text counts as empty: no ids, and the digests of an empty string. Repeated rows and null ids pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(public_tokenizers.path(vocabulary))
        for batch in released(batches):
            counts, encoded, decoded = [], [], []
            for group in groups([t or "" for t in batch.column(1).to_pylist()]):
                for ids, text in c.encoded(group):
                    counts.append(ids.count(b" ") + 1 if ids else 0)
                    encoded.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
