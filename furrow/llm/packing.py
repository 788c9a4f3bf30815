"""Best-fit-decreasing packing of token pieces into sequences of a fixed size.

Pieces of one length are alike, so the plan is made over the histogram of lengths, which has ``size`` entries at most
however large the corpus. A segment tree over remaining capacities finds the tightest open bin in logarithmic time; bins with the
same capacity left are held as runs of numbers, so a whole run takes pieces in one step. The order of placements is that of
best-fit decreasing, piece by piece. Executors then give each piece its rank among those of its length
(counted by salted groups, so a common length is no hot key) and look up its place in the plan.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

from furrow.llm.bpe import byte_alphabet
from furrow.llm.common import released, stage_table
from furrow.llm.memo import ODD, PLAIN, Memo, groups

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
MEMO = 200_000
_BATCH = 20_000
_SEPARATOR, _MARK = "\x01", b"\xff\xff\xff\xff"
_PARTS = re.compile(_SEPARATOR + r"|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\x01]+")


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Words are independent under the vocabulary, and so are their parts; both are memoised."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.words, self.parts = Memo(MEMO), Memo(MEMO)
        #: The bare model over ready parts in the byte alphabet: a part ends with an id whose string has the word's end.
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.table = {b: c for b, c in byte_alphabet().items() if b != 32}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for s, i in vocabulary.items() if s.endswith(self.library.model.end_of_word_suffix)]] = True

    def _learn_parts(self, parts: list[str]) -> None:
        young = self.parts.young
        for at in range(0, len(parts), _BATCH):
            some = parts[at : at + _BATCH]
            ready = " ".join(some).encode().decode("latin-1").translate(self.table)
            ids = np.array(self.bare.encode(ready, add_special_tokens=False).ids, "<u4")
            data, first = ids.tobytes(), 0
            for p, last in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                young[p] = data[first:last]
                first = last

    def _learn(self, words: list[bytes]) -> None:
        odd, young = [], self.words.young
        if ODD.search(b"\n".join(words).decode()):
            split = [(w, w.decode()) for w in words]
            odd = [w for w, word in split if not PLAIN.fullmatch(word) or "<|" in word]
            words = [w for w, word in split if PLAIN.fullmatch(word) and "<|" not in word]
        flat = _PARTS.findall(_SEPARATOR.encode().join(words).decode().lower())
        self._learn_parts(self.parts.missing({*flat} - {_SEPARATOR}))
        self.parts.young[_SEPARATOR] = _MARK
        data = b"".join(map(self.parts.young.__getitem__, flat))
        cuts, first = np.flatnonzero(np.frombuffer(data, "<u4") == 0xFFFFFFFF), 0
        for w, last in zip(words, [*(4 * cuts).tolist(), len(data)], strict=False):
            young[w] = data[first:last]
            first = last + 4
        self.parts.turn()
        for w, e in zip(odd, self.library.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False), strict=True):
            young[w] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        split = [t.encode().split() for t in texts]
        if new := self.words.missing(set().union(*split)):
            self._learn(new)
        get = self.words.young.__getitem__
        for words in split:
            yield b"".join(map(get, words))
        self.words.turn()


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", size: int = 4096, end: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids with ``end`` behind them, cut after every ``size`` ids. Null texts give the one id ``end``.

    Null ids pass through; each row gives its pieces, also if it repeats another; very long texts are encoded whole; an empty table gives no pieces; other columns are left out.
    """
    last, step = np.array([end], "<u4").tobytes(), 4 * size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(public_tokenizers.path(vocabulary))
        for batch in released(batches):
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            encoded = (x for group in groups(texts) for x in e.encode(group))
            rows = []
            for doc, data in zip(ids, encoded, strict=True):
                data += last
                rows += [(doc, k // step, k // 4, min(step, len(data) - k) // 4, zlib.crc32(data[k : k + step])) for k in range(0, len(data), step)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class Capacities:
    """Segment tree over 0..size: which remaining capacities have open bins."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, at: int, value: bool) -> None:
        i = at + self.leaves
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def at_least(self, least: int) -> int:
        """The smallest capacity with open bins that isn't below ``least``; -1 if there is none."""
        i = least + self.leaves
        if self.any[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def plan(counts: dict[int, int], size: int = 4096) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over the histogram.

    Rows (length, first rank, first bin, pieces a bin, offset): the rank-th piece of that length is in bin
    first + (rank - first rank) // pieces, behind offset + length * remainder. Then the number of bins.
    """
    tree, bins = Capacities(size), defaultdict(list)
    rows, opened = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            if not bins[left]:
                tree.set(left, True)
            bins[left].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = tree.at_least(length)
            if left < 0:
                left, fits = size, size // length
                first, n = opened, -(-rest // fits)
                opened += n
            else:
                fits = left // length
                first, n = bins[left].pop()
                if not bins[left]:
                    tree.set(left, False)
            full = min(n, rest // fits)
            each, used = (fits, full) if full else (rest, 1)
            rows.append((length, rank, first, each, size - left))
            put(left - each * length, first, used)
            if left < size:
                put(left, first + used, n - used)
            else:
                opened = first + used
            rank += each * used
            rest -= each * used
    return rows, opened


def pack(cut: DataFrame, size: int = 4096, rows_per_salt: int = 200_000) -> DataFrame:
    """Give each piece a sequence and its offset there. Repeated rows are packed each; an empty table gives no rows."""
    spark = cut.sparkSession
    cut = stage_table(cut, "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``size`` rows
    rows, _ = plan(histogram, size)
    table = np.array(sorted(rows) or [(0, 0, 0, 1, 0)], np.int64).T
    known = spark.sparkContext.broadcast((table[0] << 44 | table[1], *table[1:]))
    salts = 16 + sum(histogram.values()) // rows_per_salt
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_rank", local - 1)
    ranked = ranked.join(counts, (ranked["length"] == counts["_l"]) & (ranked["_salt"] == counts["_s"]))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first_rank, first_bin, each, offset = known.value
        for batch in released(batches):
            length, rank = batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            on = rank - first_rank[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(first_bin[at] + on // each[at]), pa.array(offset[at] + on % each[at] * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(run, PACKED)
