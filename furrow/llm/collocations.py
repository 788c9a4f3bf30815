"""Phrase collocation mining with a generalised suffix automaton for each shard.

A shard is some 16 MB of texts of one language. Its automaton, of bounded depth, is built level by level in NumPy: the states of length k
are the classes of ends that agree in their last k words, each made from a state of length k - 1 (its suffix link: the phrase
without its first word) and the word before it. This is the suffix-link tree of a suffix automaton, which is the suffix tree of
the reversed pieces, cut at the depth. A state's count is the size of its endpos set; words are told apart by
their bytes, so counts in a shard are exact.

Two passes over the texts:

1. Automata of depth two give the counts of words and pairs by 64-bit hash. Keys found ``least`` times or more are set in a filter.
   A phrase found that often has only such words and pairs; hashes that collide only let more through.
2. Automata of depth four walk only ends whose pairs are in the filter, and give (language, phrase, count) by the phrase
   itself. These counts are reduced over all shards, and they alone decide.

The filter grows with the number of frequent keys up to ``max_bits``; beyond, it is cut into ranges of keys, and pass 2 reads the texts once for each
range. Cuts, scores and subsumption are joins on phrases: a phrase's extensions by one word have it as suffix link or as the same phrase without its last word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from furrow.llm.common import released, stage_table, text_of
from furrow.llm.windows import mix

DEPTH, SHARD, _PAGE = 4, 16 << 20, 32768
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", *range(10, 14)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Shard(NamedTuple):
    """Words of a shard: number of each, the different words, and how many words its piece has up to each (at most the depth)."""

    words: np.ndarray
    known: pa.Array
    room: np.ndarray

    @staticmethod
    def of(data: bytes) -> Shard:
        a = _LOWER[np.frombuffer(data, np.uint8)]
        kind = _KIND[a]
        letter = np.concatenate([[False], kind == 0, [False]])
        starts, ends = np.flatnonzero(~letter[:-1] & letter[1:]), np.flatnonzero(letter[:-1] & ~letter[1:])
        breaks = np.cumsum(kind == 2, dtype=np.int32)[starts]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        spelt = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(a[kind == 0])]).dictionary_encode()
        new = np.concatenate([[True], breaks[1:] != breaks[:-1]])[: len(starts)]
        first = np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
        return Shard(spelt.indices.to_numpy(zero_copy_only=False).astype(np.int64), spelt.dictionary, np.minimum(np.arange(len(starts)) - first + 1, DEPTH).astype(np.int8))

    def hashes(self, lang: str) -> np.ndarray:
        """Of each different word, with its language."""
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.known.to_pylist()], np.uint64)


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))


class States(NamedTuple):
    """States of one length: an end of each, the size of its endpos set, and its suffix link (a state one word shorter)."""

    end: np.ndarray
    count: np.ndarray
    link: np.ndarray


class Automaton:
    """The generalised suffix automaton of a shard, made one length at a time; ends before ``skip`` are context and don't count."""

    def __init__(self, shard: Shard, skip: int = 0) -> None:
        self.shard, self.length = shard, 1
        self.ends = np.arange(skip, len(shard.words))
        self.state = shard.words[skip:]

    def words(self) -> np.ndarray:
        """How often each different word ends; their numbers are the states of length 1."""
        return np.bincount(self.state, minlength=len(self.shard.known))

    def deepen(self, where: np.ndarray | None = None) -> States:
        """States one word longer, of the ends that have room and for which ``where`` holds."""
        self.length += 1
        on = self.shard.room[self.ends] >= self.length
        if where is not None:
            on &= where
        self.ends, below = self.ends[on], self.state[on]
        code = below * len(self.shard.known) + self.shard.words[self.ends - self.length + 1]
        _, first, self.state, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        return States(self.ends[first], count, below[first])

    def phrases(self, states: States) -> pa.Array:
        spelt = [self.shard.known.take(pa.array(self.shard.words[states.end - k])) for k in range(self.length - 1, -1, -1)]
        return pc.binary_join_element_wise(*spelt, pa.scalar(b" ", pa.large_binary()))


def blocks(text: bytes, most: int = SHARD) -> Iterator[tuple[bytes, int]]:
    """A long text in blocks, cut between words; each begins with the last words of its piece so far, whose number comes with it."""
    at, carry = 0, b""
    while at < len(text):
        cut = min(at + most, len(text))
        while cut < len(text) and _KIND[text[cut]] == 0:
            cut += 1
        block = carry + b" " + text[at:cut]
        yield block, len(carry.split())
        last = max(block.rfind(c) for c in (b".", b",", b";", b":", b"!", b"?", b"\n", b"\x0b", b"\x0c", b"\r"))
        carry = b" ".join(block[last + 1 :].rsplit(None, DEPTH - 1)[-(DEPTH - 1) :])
        at = cut


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD) -> Iterator[tuple[str, bytes, int]]:
    """(language, texts one behind another, words of context): up to ``most`` bytes of all languages are held at a time."""
    held, size = {}, 0
    for batch in released(batches):
        for lang, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(data) > most:
                yield from ((lang, b, n) for b, n in blocks(data, most))
                continue
            held.setdefault(lang, []).append(data)
            size += len(data) + 64
            if size > most:
                yield from ((k, b"\n".join(v), 0) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, b"\n".join(v), 0) for k, v in held.items())


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass 1: counts of words and pairs by hash."""
    for lang, data, skip in shards(batches):
        shard = Shard.of(data)
        automaton, spelt = Automaton(shard, skip), shard.hashes(lang)
        words = automaton.words()
        pairs = automaton.deepen()
        keys = np.concatenate([spelt, pair_keys(spelt[shard.words[pairs.end - 1]], spelt[shard.words[pairs.end]])])
        n = np.concatenate([words, pairs.count])
        yield pa.RecordBatch.from_arrays([pa.array(keys[n > 0].view(np.int64)), pa.array(n[n > 0])], ["key", "n"])


class Filter(NamedTuple):
    """Two bits for each key, of the keys of one range; keys of others pass."""

    bits: bytes
    width: int
    ranges: int
    range: int

    def mine(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(28)) % np.uint64(256) % np.uint64(self.ranges) == np.uint64(self.range)

    def has(self, keys: np.ndarray) -> np.ndarray:
        table, hit = np.frombuffer(self.bits, np.uint8), np.ones(len(keys), bool)
        for slot in (keys & np.uint64((1 << self.width) - 1), keys >> np.uint64(64 - self.width)):
            slot = slot.astype(np.int64)
            hit &= (table[slot >> 3] >> (slot & 7)) & 1 > 0
        return hit


def filters(frequent: DataFrame, max_bits: int = 1 << 28) -> Iterator[Filter]:
    """A filter for each range of keys. Of 16 bits a key it gets at most ``max_bits`` (32 MB), which is what comes to the driver and goes to the tasks at a time."""
    wanted = max(16, (16 * max(frequent.count(), 1) - 1).bit_length())
    width = max(15, min(wanted, max_bits.bit_length() - 1, 28))
    ranges = min(256, 1 << (wanted - width))
    low, high = F.col("key").bitwiseAND(F.lit((1 << width) - 1)), F.shiftrightunsigned("key", 64 - width)
    for k in range(ranges):
        part = frequent.where(F.shiftrightunsigned("key", 28).bitwiseAND(F.lit(255)) % ranges == k)
        slots = part.select(F.explode(F.array(low, high)).alias("slot"))
        pages = slots.groupBy(F.floor(F.col("slot") / _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % _PAGE).alias("bits"))
        table = np.zeros((1 << width) // 8, np.uint8)
        for row in pages.toLocalIterator():
            table[row["page"] * (_PAGE // 8) : (row["page"] + 1) * (_PAGE // 8)] = np.frombuffer(row["bits"], np.uint8)
        yield Filter(table.tobytes(), width, ranges, k)


def _counts(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pass 2: counts of phrases, of a filter's range, and of all words as those of the phrase without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = Filter(*shared.value)
        out = lambda lang, phrases, k, n: pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), phrases.cast(pa.binary()), pa.array(np.full(len(n), k, np.int32)), pa.array(n.astype(np.int64))], ["lang", "phrase", "k", "n"])
        for lang, data, skip in shards(batches):
            shard = Shard.of(data)
            automaton, spelt = Automaton(shard, skip), shard.hashes(lang)
            if keep.range == 0:
                yield out(lang, pa.array([b""], pa.large_binary()), 0, np.array([len(automaton.ends)]))
            n = automaton.words()
            use = np.flatnonzero((n > 0) & keep.mine(spelt) & keep.has(spelt))
            yield out(lang, shard.known.take(pa.array(use)), 1, n[use])
            # of each end: whether the pair that ends there may be frequent, and whether it is of this range
            keys = np.zeros(len(shard.words), np.uint64)
            keys[1:] = pair_keys(spelt[shard.words[:-1]], spelt[shard.words[1:]])
            mine = keep.mine(keys)
            may = keep.has(keys) | ~mine
            where = (mine & may)[automaton.ends]
            for k in range(2, DEPTH + 1):
                states = automaton.deepen(where)
                yield out(lang, automaton.phrases(states), k, states.count)
                where = may[np.maximum(automaton.ends - k + 1, 0)]

    return run


def counts(docs: DataFrame, least: int = 30, max_bits: int = 1 << 28) -> DataFrame:
    """(lang, phrase, k, n): all phrases of one to four words found ``least`` times or more in a language, and with k = 0 and the phrase '' its number of words."""
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_of().cast("binary").alias("text"))
    frequent = stage_table(texts.mapInArrow(_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), "frequent")
    sc, found = docs.sparkSession.sparkContext, []
    for f in filters(frequent, max_bits):
        rows = texts.mapInArrow(_counts(sc.broadcast(tuple(f))), "lang string, phrase binary, k int, n long")
        rows = rows.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0))
        found.append(stage_table(rows.withColumn("phrase", F.col("phrase").cast("string")), "phrases"))
    return reduce(DataFrame.unionByName, found)


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, length), " ")


def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates: their lowest-scoring cut."""
    parts = found.where("k between 1 and 3").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), "n")
    cuts = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"_first": _part(F.lit(1), F.col("cut")), "_rest": _part(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    for side, name in (("_first", "l"), ("_rest", "r")):
        other = parts.withColumnRenamed("n", name)
        cuts = cuts.join(other, (cuts["lang"] == other["_lang"]) & (cuts[side] == other["_part"])).drop("_lang", "_part", side)
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (l + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "cut", "a", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.score")


def unsubsumed(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Without the candidates that a longer one nearly always holds.

    One word longer is enough to look at: a longer phrase that holds a candidate that often has one of these within, as often at least.
    """
    longer = found.where("k > 2").select(
        F.col("lang").alias("_lang"), F.col("n").alias("_n"), F.explode(F.array(_part(F.lit(1), F.col("k") - 1), _part(F.lit(2), F.col("k") - 1))).alias("_phrase")
    )
    longer = longer.groupBy("_lang", "_phrase").agg(F.max("_n").alias("_n"))
    held = candidates.join(longer, (candidates["lang"] == longer["_lang"]) & (candidates["phrase"] == longer["_phrase"]), "left")
    return held.where(F.col("_n").isNull() | (F.col("_n") * 5 < F.col("a") * 4)).drop("_lang", "_phrase", "_n")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, max_bits: int = 1 << 28) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A null text has no words; a null language is ``und``; doc_id isn't read, so null and repeated ids don't matter, and each
    row counts. Ties in score and count go by the phrase's bytes. A language without candidates, and an empty table, give no rows.
    """
    found = counts(docs, least, max_bits)
    ranked = unsubsumed(scored(found), found)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # a large language is ranked in parts first
    ranked = ranked.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    ranked = ranked.withColumn("_place", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = found.where("k = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
