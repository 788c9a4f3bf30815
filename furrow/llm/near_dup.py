"""Near-duplicate groups by a chosen-path set similarity join.

Documents with equal shingle sets form a class, and one of each class goes on. In each of several independent trees a document
follows the path of its minwise tokens at chosen coordinates of its sketch; two documents of similarity J take the same
branch with probability J. The first two levels are taken by all. A node with more than ``limit`` documents
branches on, by several coordinates that its path chooses. The other nodes are compared exhaustively on full sets.

Nodes that are still large at the last level, that branching hardly divides, or whose sets are too long to be held at once, are settled in two
steps. First they are cut into blocks, dealt anew in each tree, and each block is compared by itself: a group of copies becomes one component, as its documents meet in
several blocks. Documents of nodes that then hold more than one component are compared across components by their rarest shared shingles: two sets of similarity t have one in
common among the first (1 - t) of the longer set and the first (1 - t) / (1 + t) of the shorter one, in any order of all shingles. Shingles of one component only
can't be shared across, so they come first and are never sent; pages of one template that fall short of the threshold have nothing else there and meet nobody. This step is exact.

The number of trees follows from the target recall for a pair at the threshold exactly whose nodes are over the limit at
every level (``recall_of``), so it holds for any input; more similar pairs, pairs in large nodes, and groups with more than one link, are found with a higher one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import hot_join, released, stage_table, text_of
from furrow.llm.components import connected_components
from furrow.llm.windows import groups, mix, windows, word_hashes

_LEAST = -(2**63)
COORDINATES = 64
#: Shingles of a node that one task compares at once (8 bytes each, about four times that in memory).
HEAVY = 4_000_000
_MULTIPLIERS = np.random.default_rng(7_919).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def branches_for(threshold: float) -> int:
    """Coordinates that a node over the limit branches on: at the threshold 1.6 shared ones or more on average, so that pairs don't die out."""
    return max(2, math.ceil(round(1.6 / threshold, 6)))


def recall_of(threshold: float, trees: int, branchings: int) -> float:
    """Probability that a pair at the threshold shares a node after ``branchings`` in some tree. The trees share the deeper coordinates,
    of which a pair has equal a binomial number."""
    deeper, branches, missed = COORDINATES - 2 * trees, branches_for(threshold), 0.0
    for equal in range(deeper + 1):
        t, lost = equal / deeper, 0.0
        for _ in range(branchings):
            lost = (1 - t + t * lost) ** branches
        missed += math.comb(deeper, equal) * threshold**equal * (1 - threshold) ** (deeper - equal) * (1 - threshold**2 * (1 - lost)) ** trees
    return 1 - missed


def trees_for(threshold: float, recall: float, depth: int) -> tuple[int, int]:
    """The least number of trees, and their depth: ``depth``, or less where the coordinates don't suffice (larger nodes end in blocks)."""
    for levels in range(depth, 1, -1):
        for trees in range(1, COORDINATES // 2 - 4):
            if recall_of(threshold, trees, levels - 2) >= recall:
                return trees, levels
    raise ValueError(f"{COORDINATES} coordinates are too few for a recall of {recall} at a threshold of {threshold}")


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; one for the whole sequence if it has fewer words, none without words."""
    for g in groups(texts):
        part = [texts[i].lower() for i in g]
        hashes, counts = word_hashes(part)
        grams, first = windows(hashes, words), np.concatenate([[0], np.cumsum(counts)])
        for i, n in enumerate(counts):
            at = first[i]
            if n >= words:
                yield np.unique(grams[at : at + n - words + 1])
            elif n:
                yield mix(windows(hashes[at : at + n], int(n)) + np.uint64(n))
            else:
                yield np.zeros(0, np.uint64)


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sizes, prints, sketches = [], [], []
            for s in shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], words):
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    least = np.array([(s * m).min() for m in _MULTIPLIERS]) if len(s) > 2000 else (s[None, :] * _MULTIPLIERS[:, None]).min(axis=1)
                    sketches.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
                else:
                    sketches.append(np.zeros(COORDINATES, np.int32))
            flat = pa.array(np.concatenate(sketches) if sketches else np.zeros(0, np.int32))
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * COORDINATES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                ["did", "n_shingles", "print", "sketch"],
            )

    return run


def _sets(words: int):
    """(did, text, nodes) to one row with the full set for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            dids, places = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows, size = [], 0
            for did, nodes, s in zip(dids, places, shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], words), strict=True):
                data = s.tobytes()
                rows += [(node, did, data) for node in nodes]
                size += len(data) * len(nodes)
                if size > 8_000_000:
                    yield _set_rows(rows)
                    rows, size = [], 0
            yield _set_rows(rows)

    return run


def _postings(words: int):
    """(did, text, root) to (did, row, root, size, shingles); ``row`` tells texts under one did apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            dids, roots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            rows, size = [], 0
            for did, root, s in zip(dids, roots, shingle_sets([(t or "").encode() for t in batch.column(1).to_pylist()], words), strict=True):
                row = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                rows.append((did, row, root, len(s), s.view(np.int64)))
                size += len(s)
                if size > 1_000_000:
                    yield _posting_rows(rows)
                    rows, size = [], 0
            yield _posting_rows(rows)

    return run


def _posting_rows(rows: list) -> pa.RecordBatch:
    *cols, sets = list(zip(*rows, strict=True)) or [[]] * 5
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
    flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.ListArray.from_arrays(offsets, flat)], ["did", "row", "root", "size", "shingles"])


def _set_rows(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["node", "did", "shingles"])


def links_within(dids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the node's documents into its groups. Pairs already in one group are left out; all others are compared."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(dids[0], dids[1])] if dids[0] != dids[1] and 100 * both >= percent * (sizes.sum() - both) else []
    first = np.concatenate([[0], np.cumsum(sizes)])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark, group, found = np.zeros(len(values), bool), np.arange(n), []
    for v in range(n - 1):
        fits = (group[v + 1 :] != group[v]) & (100 * np.minimum(sizes[v + 1 :], sizes[v]) >= percent * np.maximum(sizes[v + 1 :], sizes[v]))
        others = np.flatnonzero(fits) + v + 1
        if not len(others):
            continue
        own = codes[first[v] : first[v + 1]]
        mark[own] = True
        if len(others) > 16:
            both = np.add.reduceat(mark[codes[first[v + 1] :]], first[v + 1 : n] - first[v + 1], dtype=np.int64)[others - v - 1]
        else:
            both = np.array([np.count_nonzero(mark[codes[first[u] : first[u + 1]]]) for u in others])
        mark[own] = False
        for u in others[100 * both >= percent * (sizes[v] + sizes[others] - both)]:
            if group[u] != group[v]:
                found.append((dids[v], dids[u]))
                group[group == group[u]] = group[v]
    return found


def _compare(percent: int):
    """Rows sorted by node to links; a node's rows may lie in several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray]] = []
        at, found = None, []

        def close() -> None:
            if len(held) > 1:
                held.sort(key=lambda x: x[0])
                found.extend(links_within([d for d, _ in held], [s for _, s in held], percent))
            held.clear()

        for batch in released(batches):
            for node, did, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if node != at:
                    close()
                    at = node
                held.append((did, np.frombuffer(data, np.uint64)))
            yield _links(found)
            found.clear()
        close()
        yield _links(found)

    return run


def _links(found: list) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _blocks(limit: int, heavy: int) -> Column:
    """Blocks of about limit / 2 documents and heavy / 2 shingles for a node of ``n`` documents and ``weight`` shingles."""
    whole = (F.col("n") <= limit) & (F.col("weight") <= heavy)
    return F.when(whole, F.lit(1)).otherwise(F.greatest(F.ceil(F.col("n") / (limit // 2)), F.ceil(F.col("weight") / (heavy // 2)))).cast("long")


def _nodes(reps: DataFrame, threshold: float, trees: int, depth: int, limit: int, heavy: int = HEAVY) -> DataFrame:
    """(did, n_shingles, sketch) to (did, node, large, blocks): the nodes of two to ``limit`` documents and up to ``heavy`` shingles, and the large ones, with the
    number of blocks that hold half of that."""
    path = lambda t: F.xxhash64(F.lit(t), F.col("sketch")[2 * t], F.col("sketch")[2 * t + 1])
    rows = reps.select("did", "n_shingles", F.explode(F.array(*[path(t) for t in range(trees)])).alias("node"), F.lit(None).cast("long").alias("parent_n"))
    deeper, branches, done, large = COORDINATES - 2 * trees, branches_for(threshold), [], []
    for level in range(2, depth + 1):
        rows = stage_table(rows, "paths")
        sizes = stage_table(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1"), "node-sizes")
        rows = stage_table(hot_join(rows, sizes, "node", "n"), "nodes")
        small = F.col("n") <= limit
        done.append(rows.where(small & (F.col("weight") <= heavy)).select("did", "node", F.lit(False).alias("large"), F.lit(1).cast("long").alias("blocks")))
        large.append(rows.where(small & (F.col("weight") > heavy)).select("did", "node", "n", "weight"))
        rows = rows.where(~small)
        if level == depth or rows.isEmpty():
            large.append(rows.select("did", "node", "n", "weight"))
            break
        # branching on pays only if the squares of the branches are less than that of the node
        size = F.col("n").cast("double")
        dense = F.coalesce(size * size * branches > F.col("parent_n").cast("double") * F.col("parent_n"), F.lit(False))
        large.append(rows.where(dense).select("did", "node", "n", "weight"))
        held = rows.where(~dense).drop("n_shingles").join(reps, "did")
        start = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(deeper))
        stride = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(deeper // branches)) + 1  # distinct coordinates
        chosen = lambda k: F.get("sketch", (F.pmod(start + stride * k, F.lit(deeper)) + 2 * trees).cast("int"))  # noqa: E731,B023
        rows = held.select("did", "n_shingles", F.explode(F.array(*[F.xxhash64("node", F.lit(k), chosen(k)) for k in range(branches)])).alias("node"), F.col("n").alias("parent_n"))
    done += [rows.select("did", "node", F.lit(True).alias("large"), _blocks(limit, heavy).alias("blocks")) for rows in large]
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _node_links(texts: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(did, text) and (did, node) to links (a, b) of documents in one node, by their full sets."""
    member = stage_table(nodes.groupBy("did").agg(F.collect_set("node").alias("nodes")), "membership")
    sets = texts.join(member.hint("shuffle_hash"), "did").select("did", "text", "nodes").mapInArrow(_sets(words), "node long, did long, shingles binary")
    dealt = sets.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "node").sortWithinPartitions("node")
    return dealt.mapInArrow(_compare(percent), "a long, b long")


def _unsettled(large: DataFrame, roots: DataFrame) -> DataFrame:
    """(did, root) of the documents in large nodes with more than one component."""
    rows = large.join(roots, F.col("did") == F.col("id"), "left").select("did", "node", F.coalesce("root", "did").alias("root"))
    rows = stage_table(rows, "large")
    mixed = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    held = hot_join(rows, stage_table(mixed.select("node", "n"), "mixed"), "node", "n")
    return stage_table(held.select("did", "root").distinct(), "unsettled")


def _prefix_nodes(texts: DataFrame, unsettled: DataFrame, words: int, percent: int, limit: int, heavy: int) -> DataFrame:
    """(did, node) so that each pair over the threshold from different components shares a node, exactly.

    A node is a shingle, rare in both sets, and a class of sizes: a set meets those of its own class and the next. Nodes with the same documents become one. Nodes over
    the limits, which need many components that differ little from one another, are cut into blocks that meet pairwise.
    """
    sets = texts.join(unsettled.hint("shuffle_hash"), "did").select("did", "text", "root").mapInArrow(_postings(words), "did long, row long, root long, size long, shingles array<long>")
    posts = stage_table(sets, "postings").select("did", "row", "root", "size", F.explode("shingles").alias("shingle"))
    across = posts.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle", "n")
    held = hot_join(posts, stage_table(across, "shared-shingles"), "shingle", "n")
    # shingles from this one on in the common order, rarest first; those of one component come before all others
    left = F.row_number().over(Window.partitionBy("did", "row").orderBy(F.desc("n"), F.desc("shingle")))
    held = held.withColumn("left", left).where(100 * F.col("left") >= percent * F.col("size"))
    place = F.log(F.col("size")) / math.log(100 / percent)
    own = F.floor(place)
    classes = F.array_distinct(F.array(own, own - 1, F.floor(place - 1 - 1e-9)))  # the last one for rounding
    shorter = ((100 + percent) * F.col("left") >= 2 * percent * F.col("size")) & (F.col("class") == own)
    rows = held.select("did", "row", "root", "size", "shingle", "left", F.explode(classes).alias("class"))
    rows = rows.select("did", "row", "root", "size", F.xxhash64(F.lit("prefix"), "shingle", "class").alias("node"), shorter.alias("shorter"))
    rows = stage_table(rows, "prefixes")
    met = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("weight"), F.max("shorter").alias("any"), F.min("root").alias("lo"), F.max("root").alias("hi"),
        F.bit_xor(F.xxhash64("did", "row")).alias("members"),
    ).where("any and lo <> hi").select("node", "n", "weight", F.xxhash64(F.lit("members"), "n", "members").alias("members"))
    found = hot_join(rows, stage_table(met, "prefix-nodes"), "node", "n").select("did", F.col("members").alias("node"), _blocks(limit, heavy).alias("blocks")).distinct()
    mine = F.pmod(F.xxhash64("did", "node"), F.col("blocks"))
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.xxhash64("node", F.least(mine, k), F.greatest(mine, k)))
    return found.select("did", F.explode(meet).alias("node"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, recall: float = 0.9999, limit: int = 1000, depth: int = 8, heavy: int = HEAVY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    A null text, or one without words, has the empty set and is linked with nothing. A null doc_id counts as the smallest and
    comes back as null. Rows that repeat a doc_id are taken as that document. Of a group the smallest id names it, so there are no ties. An empty table gives no
    rows; other columns, whatever their names, are left out; very long texts are read whole.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    did = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    texts = docs.select(did.alias("did"), text_of(text_col).alias("text"))
    narrow = stage_table(texts.mapInArrow(_sketches(words), "did long, n_shingles long, print binary, sketch array<int>"), "sketches")
    some = narrow.where("n_shingles > 0")
    classes = stage_table(some.groupBy("print").agg(F.min("did").alias("rep"), F.count(F.lit(1)).alias("size")), "classes")
    least = math.ceil(percent / (100 - percent))  # smaller sets can't link with a different one
    reps = some.where(F.col("n_shingles") >= least).join(classes.select("rep", F.col("print").alias("_print")), (F.col("did") == F.col("rep")) & (F.col("print") == F.col("_print")), "left_semi")
    reps = stage_table(reps.select("did", "n_shingles", "sketch"), "representatives")
    nodes = _nodes(reps, threshold, *trees_for(threshold, recall, depth), limit, heavy)
    block = F.xxhash64(F.lit("block"), "node", F.pmod(F.xxhash64("did", "node"), F.col("blocks")))
    roots = connected_components(_node_links(texts, nodes.select("did", F.when(F.col("large"), block).otherwise(F.col("node")).alias("node")), words, percent))
    unsettled = _unsettled(nodes.where("large").select("did", "node"), roots)
    if not unsettled.isEmpty():
        links = _node_links(texts, _prefix_nodes(texts, unsettled, words, percent, limit, heavy), words, percent)
        roots = connected_components(links.unionByName(roots.select(F.col("id").alias("a"), F.col("root").alias("b"))))
    rooted = classes.join(roots, classes["rep"] == roots["id"], "left").select("print", "size", F.coalesce("root", "rep").alias("root"))
    full = hot_join(some.select("did", "n_shingles", "print"), stage_table(rooted, "rooted"), "print", "size")
    empty = narrow.where("n_shingles = 0").select("did", "n_shingles", F.col("did").alias("root"))
    back = lambda c: F.when(F.col(c) != _LEAST, F.col(c))
    return full.select("did", "n_shingles", "root").unionByName(empty).select(
        back("did").alias("doc_id"), "n_shingles", back("root").alias("component_id"), (F.col("did") == F.col("root")).alias("kept")
    )


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those whose group has a smaller doc_id. Rows that repeat a kept doc_id stay."""
    found = near_duplicates(docs, words, percent, id_col=id_col, text_col=text_col)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("__furrow_id")).distinct()
    gone = stage_table(gone, "near-copies")
    return docs.join(gone, F.col(id_col).eqNullSafe(F.col("__furrow_id")), "left_anti")
