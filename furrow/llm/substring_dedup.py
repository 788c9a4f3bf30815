"""Substring dedup by level-wise doubling.

The ladder doubles: 5, 10 and 20 words for the contract's windows of 20. At each lower level, of the short windows inside a
full window only the one with the smallest hash (the leftmost of equals) stands for it: equal full windows choose equal
ones, so an eighth (5 words) or a sixth (10) of all places suffices. Short windows found once in the corpus end there; the
full windows for which a repeated one stands go on to the next level, at twice the length. At the top the full windows
are hashed (95 bits) and all occurrences but the earliest are marked. The ladder ends there, as a repeat of any greater
length is covered by its repeated full windows.

Before a level's rows shuffle, each group of texts (about 1 MB) settles its own repeats and sends one row for each
key. A task also remembers, in a table of fixed size, the keys it has sent: what it knows to be repeated is settled without
another row. So a passage that a third of the corpus shares comes to a key's task about twice from each task, and not once from
each document. Texts shuffle once, by document; the joins of all levels read that exchange, in an order of documents, so that a task that
runs again settles the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from furrow.llm.common import released, stage_table, text_of
from furrow.llm.windows import OVER_WORDS_2, groups, inside, windows, word_hashes

_ROW = "key long, did long, at long"
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each place the place of the smallest of the next ``width`` values."""
    v, p, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(v) - step
        later = v[step:] < v[:n]
        v, p = np.where(later, v[step:], v[:n]), np.where(later, p[step:], p[:n])
        have += step
    return p


class Level:
    """A group's windows: which are whole, and which short windows stand for them."""

    def __init__(self, texts: list[bytes], length: int) -> None:
        self.length = length
        self.hashes, self.counts = word_hashes(texts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.whole = np.flatnonzero(inside(self.counts, length))

    def short(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``part`` words, and for each whole window the place of the one that stands for it."""
        hashes = windows(self.hashes, part)
        return hashes, _leftmost_smallest(hashes, self.length - part + 1)[self.whole] if len(self.whole) else self.whole

    def candidates(self, part: int, places: pa.Array) -> None:
        """Keep the whole windows for which one of the places (word numbers, listed by text) stands."""
        sizes = np.array([len(x) for x in places])
        flat = np.asarray(places.flatten()).astype(np.int64) + np.repeat(self.first, sizes)
        marked = np.zeros(len(self.hashes), bool)
        marked[flat[flat < len(marked)]] = True
        self.whole = self.whole[marked[self.short(part)[1]]]

    def place(self, at: np.ndarray) -> np.ndarray:
        """Word numbers in the text of word numbers in the group."""
        return at - self.first[self.text[at]]


class Sent:
    """What a task has sent of a key: how often (up to 2), or the earliest place. Newer keys overwrite older ones; a key that is lost is sent again."""

    SIZE = 1 << 18

    def __init__(self, placed: bool = False) -> None:
        self.keys, self.times = np.zeros(self.SIZE, np.uint64), np.zeros(self.SIZE, np.int8)
        if placed:
            self.seconds, self.did, self.at = np.zeros(self.SIZE, np.uint64), np.zeros(self.SIZE, np.int64), np.zeros(self.SIZE, np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys % np.uint64(self.SIZE)).astype(np.int64)

    def times_of(self, keys: np.ndarray) -> np.ndarray:
        slots = self._slots(keys)
        return np.where(self.keys[slots] == keys, self.times[slots], 0)

    def put(self, keys: np.ndarray, times: np.ndarray) -> None:
        slots = self._slots(keys)
        self.keys[slots] = keys
        own = self.keys[slots] == keys
        self.times[slots[own]] = times[own]

    def earlier(self, keys: np.ndarray, seconds: np.ndarray, did: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether an earlier place than the given one was sent; the others' places are kept."""
        slots = self._slots(keys)
        same = (self.times[slots] > 0) & (self.keys[slots] == keys) & (self.seconds[slots] == seconds)
        known = same & ((self.did[slots] < did) | ((self.did[slots] == did) & (self.at[slots] < at)))
        new = np.flatnonzero(~known)
        last = np.full(self.SIZE, -1)
        last[slots[new]] = new
        new = last[last >= 0]  # one key for each slot
        slots = slots[new]
        self.keys[slots], self.seconds[slots], self.did[slots], self.at[slots], self.times[slots] = keys[new], seconds[new], did[new], at[new], 1
        return known


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode() for t in batch.column(column).to_pylist()]


def _rows(key: np.ndarray, did: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(did), pa.array(at.astype(np.int64))], ["key", "did", "at"])


def _settled(did: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Settled values as rows with a negative ``at``, did as key: a document's rows stay together."""
    return _rows(did.view(np.uint64), did, ~at.astype(np.int64))


def _runs(did: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Settled places as rows of first << 31 | last of places in a row."""
    order = np.lexsort((at, did))
    did, at = did[order], at[order]
    breaks = np.flatnonzero((did[1:] != did[:-1]) | (at[1:] > at[:-1] + 1)) + 1
    first, last = np.concatenate([[0], breaks]), np.concatenate([breaks - 1, [len(did) - 1]])
    return _settled(did[first], at[first] << 31 | at[last])


def _levels(batches: Iterator[pa.RecordBatch], length: int, before: int | None) -> Iterator[tuple[Level, np.ndarray]]:
    """Groups of texts with their ids; with ``before``, only the windows that survived that level."""
    for batch in released(batches):
        dids, texts = batch.column(0).to_numpy(), _texts(batch, 2)
        for g in groups(texts):
            level = Level(texts[g.start : g.stop], length)
            if before and len(level.whole):
                level.candidates(before, batch.column(3).slice(g.start, len(g)))
            if len(level.whole):
                yield level, dids[g.start : g.stop]


def _shorter(length: int, part: int, before: int | None):
    """A lower level: rows of short windows; those known to be repeated are settled, but for a row or two of each, which tell others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for level, dids in _levels(batches, length, before):
            hashes, stands = level.short(part)
            at = stands[np.concatenate([[True], stands[1:] != stands[:-1]])]
            key, did, place = hashes[at], dids[level.text[at]], level.place(at)
            keys, first, group, size = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            times = sent.times_of(keys)
            again = (size > 1) | (times > 0)
            sent.put(keys, np.where(again, 2, 1))
            first = np.sort(first[times < 2])  # a text's rows behind one another compress better in the shuffle
            yield _rows(key[first], did[first], place[first])
            if len(settled := np.flatnonzero(again[group])):
                yield _settled(did[settled], place[settled])

    return run


def _full(length: int, before: int):
    """The top level: rows of the full windows; those known to be later ones are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent(placed=True)
        for level, dids in _levels(batches, length, before):
            at = level.whole
            key = windows(level.hashes, length)[at]
            second = windows(level.hashes, length, OVER_WORDS_2)[at] >> np.uint64(33)
            did, place = dids[level.text[at]], level.place(at)
            order = np.lexsort((place, did, second, key))
            a, b = key[order], second[order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            first = order[new]
            known = sent.earlier(key[first], second[first], did[first], place[first])
            first = np.sort(first[~known])  # a text's rows behind one another compress better in the shuffle
            yield _rows(key[first], did[first], ((second << np.uint64(32)) | place.astype(np.uint64))[first].view(np.int64))
            run_of = np.cumsum(new) - 1
            earliest = order[np.flatnonzero(new)[run_of]]
            later = (did[order] != did[earliest]) | (place[order] != place[earliest]) | known[run_of]
            if later.any():
                yield _runs(did[order][later], place[order][later])

    return run


def _kept(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            rows = []
            for doc, text, ranges in zip(batch.column(1).to_pylist(), _texts(batch, 2), batch.column(3).to_pylist(), strict=True):
                words, gone = text.split(), 0
                n = len(words)
                if ranges:
                    step = np.zeros(n + 1, np.int32)
                    for r in ranges:
                        if (at := r >> 32) < n:
                            step[at] += 1
                            step[min(n, (r & 0xFFFFFFFF) + length)] -= 1
                    covered = np.cumsum(step[:n]) > 0
                    gone = int(covered.sum())
                    words = [words[i] for i in np.flatnonzero(~covered)]
                rows.append((doc, n, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_ranges(texts: DataFrame, dealt: DataFrame, length: int = 20, lowest: int = 5) -> DataFrame:
    """(did, doc_id, text), as read and dealt out by did, to (did, ranges): first start << 32 | last start of windows whose words also start earlier."""
    ladder = [length]
    while ladder[0] // 2 >= lowest:
        ladder.insert(0, ladder[0] // 2)
    if len(ladder) == 1:
        ladder.insert(0, max(1, length // 2))
    source, before = texts, None
    for part in ladder[:-1]:
        rows = source.mapInArrow(_shorter(length, part, before), _ROW)
        twice = F.count(F.lit(1)).over(W.partitionBy("key")) > 1
        places = rows.withColumn("twice", twice).where(F.col("twice") | (F.col("at") < 0))
        place = F.when(F.col("at") < 0, F.bitwise_not("at")).otherwise(F.col("at")).cast("int")
        places = places.groupBy("did").agg(F.collect_set(place).alias("places"))
        source, before = dealt.join(places.hint("shuffle_hash"), "did").select("did", "doc_id", "text", "places").sortWithinPartitions("did", "text"), part
    rows = source.mapInArrow(_full(length, before), _ROW)
    own, place = F.col("at") >= 0, F.col("at").bitwiseAND(0xFFFFFFFF)
    rows = rows.select("key", "did", "at", F.when(own, F.shiftright("at", 32)).otherwise(F.lit(-1)).alias("second"))
    later = F.rank().over(W.partitionBy("key", "second").orderBy("did", "at")) > 1
    marked = rows.withColumn("later", later).where(F.col("later") | ~own)
    run = F.bitwise_not("at")
    span = F.when(own, F.shiftleft(place, 32).bitwiseOR(place)).otherwise(F.shiftleft(F.shiftright(run, 31), 32).bitwiseOR(run.bitwiseAND(0x7FFFFFFF)))
    return marked.groupBy("did").agg(F.collect_list(span).alias("ranges"))


def _documents(texts: DataFrame, n: int) -> DataFrame:
    """Add ``did``, which orders documents as doc_id does and differs between different texts.

    That is doc_id itself, unless some rows have none or share one without sharing the text, which a pass over ids and hashes tells. Then documents
    are numbered in the order of (doc_id, digest), in ranges, and the texts take their numbers by a join.
    """
    print_ = F.xxhash64("text")
    if texts.groupBy("doc_id").agg(F.min(print_).alias("a"), F.max(print_).alias("b")).where("doc_id is null or a <> b").isEmpty():
        # not null, so that no join filters its side by it and all joins read one exchange of the texts
        return texts.select(F.coalesce("doc_id", F.lit(0)).alias("did"), "doc_id", "text")
    digest = F.unhex(F.sha2("text", 256))
    order = [F.col("_id").asc_nulls_first(), F.col("_digest")]
    numbers = texts.select(F.col("doc_id").alias("_id"), digest.alias("_digest")).distinct().repartitionByRange(n, *order).sortWithinPartitions(*order)
    numbers = stage_table(numbers.withColumn("did", F.monotonically_increasing_id()), "numbers")
    held = texts.withColumn("_own", digest)
    held = held.join(numbers, held["doc_id"].eqNullSafe(numbers["_id"]) & (held["_own"] == numbers["_digest"]))
    return stage_table(held.select("did", "doc_id", "text"), "numbered").withColumn("did", F.coalesce("did", F.lit(0)))


def substring_dedup(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    A null text has no words. A document is a doc_id and a text: rows that repeat both get equal results; of rows that share only the doc_id, and of
    those without one, which count as the smallest, each text is a document of its own, in the order of their digests. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _documents(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), n)
    dealt = texts.repartition(n, "did")
    ranges = repeated_ranges(texts, dealt, length)
    held = dealt.join(ranges.hint("shuffle_hash"), "did", "left").select("did", "doc_id", "text", "ranges")
    return held.mapInArrow(_kept(length), _RESULT)
