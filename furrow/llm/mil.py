"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Each passage is encoded from its byte classes and their
successions by a learned layer; gated attention, a softmax of w . (tanh(V h) * sigmoid(U h)), weights the passages, and the
weighted sum is scored. Only document labels are known; the weights are learned from them.

The model is fitted on a bounded sample of labelled rows (``sample`` documents, chosen by a hash of doc_id), on all their
passages. These are encoded by the executors, written as blocks and read by the driver in mini-batches of whole documents: blocks of
all together up to ``CACHE`` bytes are kept, more are read again in each epoch, and a document of more than ``BAG`` passages is worked on
block by block. Scoring reads every passage of every document in one pass without a shuffle. Texts are encoded in blocks of ``BLOCK`` bytes, so that
memory doesn't grow with their length (a word at a block's border counts as two).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import released, ship, stage_table, text_of
from furrow.llm.windows import word_hashes_at

PASSAGE = 512
BLOCK = 512 * PASSAGE
BAG = 1 << 16
CACHE = 64 << 20
BATCH = 256
STEPS, EPOCHS = 300, 20
_MARKS = b"#*$%&|<>!?.,;:-_/\\\"'()[]{}@+=~^`"


def _classes() -> tuple[np.ndarray, np.ndarray, int]:
    """Fine and coarse class of each byte, and the number of fine ones."""
    fine, coarse = np.zeros(256, np.int64), np.zeros(256, np.int64)
    kinds = [(range(97, 123), 1, 1), (range(65, 91), 2, 2), (range(48, 58), 3, 3), ((32,), 4, 4), (range(9, 14), 5, 5), (range(128, 256), 6, 6)]
    for members, f, c in kinds:
        for b in members:
            fine[b], coarse[b] = f, c
    for i, b in enumerate(_MARKS):
        fine[b], coarse[b] = 7 + i, 7 if i < 8 else 0
    return fine, coarse, 7 + len(_MARKS)


_FINE, _COARSE, N_FINE = _classes()
N_FEATURES = N_FINE + 64 + 1


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shares of byte classes, of their successions and of words that echo the one before, for each passage, and the passage's text number. An empty text has one passage of zeros."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n = np.maximum(1, -(-sizes // PASSAGE))
    base = np.cumsum(n) - n
    a = np.frombuffer(b"".join(texts), np.uint8)
    inner = np.arange(len(a)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(base, sizes) + inner // PASSAGE
    total = int(n.sum())
    ones = np.bincount(passage * N_FINE + _FINE[a], minlength=total * N_FINE).reshape(total, N_FINE)
    c = _COARSE[a]
    same = passage[1:] == passage[:-1]
    twos = np.bincount((passage[1:] * 64 + c[:-1] * 8 + c[1:])[same], minlength=total * 64).reshape(total, 64)
    length = np.maximum(1, np.bincount(passage, minlength=total))[:, None]
    words, text, at = word_hashes_at(texts)
    place = base[text] + at // PASSAGE
    echo = np.zeros(len(words))
    echo[1:] = (words[1:] == words[:-1]) & (text[1:] == text[:-1])
    echoes = np.bincount(place, weights=echo, minlength=total) / np.maximum(1, np.bincount(place, minlength=total))
    return np.hstack([ones / length, twos / length, echoes[:, None]]).astype(np.float32), np.repeat(np.arange(len(texts)), n)


def blocks_of(text: bytes) -> Iterator[bytes]:
    """The text in blocks; an empty one has one."""
    for at in range(0, max(1, len(text)), BLOCK):
        yield text[at : at + BLOCK]


Blocks = Callable[[], Iterator[tuple[np.ndarray, np.ndarray]]]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each passage: standardised features, encoding, both gates and the attention before the softmax."""
        p = self.parts
        x = ((x - self.mean) / self.scale).astype(np.float32)
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return x, h, t, s, (t * s) @ p["w"]

    def pooled(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]], bags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each bag: the largest attention, the sum of exponentials below it, and the weighted mean of the encodings.

        A block is (features, bag of each passage, in order); a bag may go on in the next block.
        """
        top, total, z = np.full(bags, -np.inf), np.zeros(bags), np.zeros((bags, len(self.parts["c"])))
        for x, bag in blocks:
            _, h, _, _, e = self.encoded(x)
            first = np.flatnonzero(np.concatenate([[True], bag[1:] != bag[:-1]]))
            own = bag[first]
            new = np.maximum(top[own], np.maximum.reduceat(e, first))
            weight = np.exp(e - np.repeat(new, np.diff([*first, len(bag)])))
            kept = np.exp(top[own] - new)
            z[own] = z[own] * kept[:, None] + np.add.reduceat(weight[:, None] * h, first, axis=0)
            total[own] = total[own] * kept + np.add.reduceat(weight, first)
            top[own] = new
        return top, total, z / total[:, None]

    def judged(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.parts["c"] + self.parts["d"], -30, 30)))

    def slopes(self, blocks: Blocks, label: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean logistic loss; each block is read twice."""
        p, bags = self.parts, len(label)
        top, total, z = self.pooled(blocks(), bags)
        dy = (self.judged(z) - label) / bags
        dz = dy[:, None] * p["c"]
        base = np.einsum("ij,ij->i", z, dz)
        out = {k: np.zeros(v.shape) for k, v in p.items()} | {"c": z.T @ dy, "d": dy.sum(keepdims=True)}
        for x, bag in blocks():
            x, h, t, s, e = self.encoded(x)
            a = np.exp(e - top[bag]) / total[bag]
            de = a * (np.einsum("ij,ij->i", h, dz[bag]) - base[bag])
            gate = de[:, None] * p["w"]
            dt, ds = gate * s * (1 - t**2), gate * t * s * (1 - s)
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
            for k, g in (("W", x.T @ dh), ("b", dh.sum(0)), ("V", h.T @ dt), ("U", h.T @ ds), ("w", (t * s).T @ de)):
                out[k] += g
        return out

    def scores(self, texts: list[bytes], most: int = 1 << 20) -> np.ndarray:
        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, owner, size = [], [], 0
            for i, t in enumerate(texts):
                for part in blocks_of(t):
                    if held and size + len(part) > most:
                        x, at = features(held)
                        yield x, np.array(owner)[at]
                        held, owner, size = [], [], 0
                    held.append(part)
                    owner.append(i)
                    size += len(part)
            if held:
                x, at = features(held)
                yield x, np.array(owner)[at]

        return self.judged(self.pooled(blocks(), len(texts))[2]) if texts else np.zeros(0)


def fit(epoch: Callable[[], Iterator[tuple[Blocks, np.ndarray]]], batches: int, mean: np.ndarray, scale: np.ndarray, width: int = 24, steps: int = STEPS, seed: int = 5) -> Model:
    """Adam on the logistic loss with a falling rate; ``epoch`` gives the mini-batches, of which there are ``batches``."""
    n = len(mean)
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"W": draw(n, width), "b": np.zeros(width, np.float32), "V": draw(width, 12), "U": draw(width, 12), "w": draw(12), "c": draw(width), "d": np.zeros(1, np.float32)}
    model, first_moment, second_moment = Model(mean, scale, p), {k: np.zeros(v.shape) for k, v in p.items()}, {k: np.zeros(v.shape) for k, v in p.items()}
    rounds, step = max(EPOCHS, -(-steps // batches)), 0
    for _ in range(rounds):
        for blocks, label in epoch():
            step += 1
            rate = 0.02 * 0.5 * (1 + np.cos(np.pi * (step - 1) / (rounds * batches)))
            for k, g in model.slopes(blocks, label).items():
                g = g + 1e-4 * p[k]
                first_moment[k] += 0.1 * (g - first_moment[k])
                second_moment[k] += 0.001 * (g * g - second_moment[k])
                p[k] -= (rate * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


class Sample:
    """The sample's blocks (h, doc_id, quality, block, x), in order: mini-batches of whole documents, read again or kept."""

    def __init__(self, table: DataFrame, cache: int = CACHE, bag: int = BAG, batch: int = BATCH) -> None:
        self.bag, self.batch, self.table = bag, batch, table
        self.sizes = {(r["h"], r["doc_id"]): r["n"] for r in table.groupBy("h", "doc_id").agg(F.sum(F.length("x") / (4 * N_FEATURES)).cast("long").alias("n")).collect()}
        size = 4 * N_FEATURES * sum(self.sizes.values())
        order = ["h", "doc_id", "block"]
        self.ordered = table.repartitionByRange(max(1, size >> 24), *order).sortWithinPartitions(*order)
        self.kept = [*self._read()] if size <= cache else None

    def _read(self) -> Iterator[tuple[tuple, int, np.ndarray]]:
        for r in self.ordered.toLocalIterator():
            yield (r["h"], r["doc_id"]), r["quality"], np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES)

    def rows(self) -> Iterator[tuple[tuple, int, np.ndarray]]:
        return iter(self.kept) if self.kept is not None else self._read()

    def _long(self, key: tuple) -> Blocks:
        one = self.table.where((F.col("h") == key[0]) & (F.col("doc_id") == key[1]))
        return lambda: ((x, np.zeros(len(x), int)) for x in (np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in one.toLocalIterator()))

    def epoch(self) -> Iterator[tuple[Blocks, np.ndarray]]:
        held, labels, n = [], [], 0
        for key, rows in itertools.groupby(self.rows(), lambda r: r[0]):
            if held and (len(labels) >= self.batch or n + self.sizes[key] > self.bag):
                yield self._batch(held), np.array(labels, np.float64)
                held, labels, n = [], [], 0
            if self.sizes[key] > self.bag:
                quality = next(rows)[1]
                yield self._long(key), np.array([quality], np.float64)
                continue
            for _, quality, x in rows:
                held.append((x, len(labels)))
            labels.append(quality)
            n += self.sizes[key]
        if held:
            yield self._batch(held), np.array(labels, np.float64)

    @staticmethod
    def _batch(held: list) -> Blocks:
        x, bag = np.vstack([x for x, _ in held]), np.repeat([i for _, i in held], [len(x) for x, _ in held])
        return lambda: iter([(x, bag)])


def train(docs: DataFrame, labels: DataFrame, sample: int = 3000, text_col: str = "text") -> Model:
    """Fit on up to ``sample`` labelled documents that aren't held out. Without any, the model scores 0.5 throughout.

    Rows of ``docs`` that repeat a doc_id are one document here; of a doc_id's labels the largest counts.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    known = known.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample)  # at most ``sample`` rows of three numbers, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text_col).alias("text")).join(F.broadcast(known), "doc_id").select("h", "doc_id", F.col("quality").cast("int").alias("quality"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for i, text in enumerate(batch.column(3)):
                for k, part in enumerate(blocks_of(text.as_py().encode())):
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([k], pa.int32()), pa.array([features([part])[0].tobytes()], pa.binary())], ["h", "doc_id", "quality", "block", "x"])

    got = Sample(stage_table(rows.mapInArrow(run, "h long, doc_id long, quality int, block int, x binary"), "passages"))
    if not got.sizes:
        zeros = {"W": np.zeros((N_FEATURES, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1), "d": np.zeros(1)}
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), zeros)
    n, total, squares = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for _, _, x in got.rows():
        x = x.astype(np.float64)
        n, total, squares = n + len(x), total + x.sum(0), squares + (x * x).sum(0)
    mean = total / n
    return fit(got.epoch, sum(1 for _ in got.epoch()), mean, np.sqrt(np.maximum(squares / n - mean**2, 0)) + 0.01)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 3000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    A null text counts as empty; empty texts are scored as one passage of zeros. Repeated rows and null ids pass through.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            score = model.value.scores([(t or "").encode() for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 3000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more.

    A null text is scored as an empty one, a very long one in blocks, whole; rows that repeat are scored alike, null ids pass through; without labels all rows stay; an empty table stays empty.
    """
    ship(docs.sparkSession)
    model, at = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample)), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            score = model.value.scores([(t or "").encode() for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
