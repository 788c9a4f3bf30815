"""Token counts with a digest cache: only texts whose digest the cache lacks are encoded, each once.

The cache is a Parquet table (digest, tokenizer, n_tokens), where ``tokenizer`` is the digest of the vocabulary file, so a new
version never meets old counts. Missing digests are encoded from one representative document and appended; the result is a
join of the documents' digests with the cache. Texts aren't normalised beyond null to empty, as the
tokenizer has no normaliser: any other change could change the count.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from tokenizers import Tokenizer

from furrow.llm.common import hot_join, released, scratch_root, stage_table, text_of
from furrow.llm.memo import Memo, groups

CACHE = "dig binary, tokenizer string, n_tokens long"
MEMO = 200_000
_BATCH = 20_000
#: The memo's count of a unit that can't be counted alone: below any sum of counts.
_WHOLE = -(1 << 60)


class Counter:
    """Counts the tokens of whole texts.

    A run of white space before other characters is split before its last place only. So a token never crosses the place before
    a single space that starts or ends such a run, and a text is counted by its space-led units, which a bounded memo
    holds. Where a unit has more white space after its space (NBSP and line ends included), and with runs of spaces, a
    space at the end, or special strings, the library gets the whole text.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.memo = Memo(MEMO)

    def _library(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        memo, whole, units = self.memo.young, {}, {}
        for i, text in enumerate(texts):
            data = text.encode()
            if b"  " in data or b"\0" in data or data[-1:] == b" " or any(s in data for s in self.special):
                whole[i] = text
            else:
                units[i] = data.replace(b" ", b"\0 ").split(b"\0")
        new = self.memo.missing(set().union(*units.values()))
        for at in range(0, len(new), _BATCH):
            part = new[at : at + _BATCH]
            held = [u.decode() for u in part]
            counts = self._library(held)
            memo.update((b, _WHOLE if u[:1] == " " and u[1:2].isspace() else n) for b, u, n in zip(part, held, counts, strict=True))
        sums = {i: sum(map(memo.__getitem__, us)) for i, us in units.items()}
        whole |= {i: texts[i] for i, n in sums.items() if n < 0}
        found = sums | dict(zip(whole, (self._library([t])[0] for t in whole.values()), strict=True))
        self.memo.turn()
        return [found[i] for i in range(len(texts))]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def encode_counts(texts: DataFrame, vocabulary: str, tokenizer: str) -> DataFrame:
    """(dig, text) to rows of the cache."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(public_tokenizers.path(vocabulary))
        for batch in released(batches):
            counts = [n for group in groups(batch.column(1).to_pylist()) for n in c.count(group)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["dig", "tokenizer", "n_tokens"])

    return texts.mapInArrow(run, CACHE)


def read_cache(spark, path: str, tokenizer: str) -> DataFrame:
    """One row for each digest; an absent cache is an empty one. Digests that two writers appended count once."""
    try:
        held = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        held = spark.createDataFrame([], CACHE)
    return held.where(F.col("tokenizer") == tokenizer).groupBy("dig").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty (0 tokens). Repeated rows and null ids each give their row. ``cache`` is the path of
    a cache to use and extend; without one, a cache of this call's own.
    """
    spark = docs.sparkSession
    cache = cache or f"{scratch_root(spark)}/furrow/{uuid.uuid4().hex}-token-counts"
    tokenizer = version(public_tokenizers.path(vocabulary))
    full = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("dig", F.unhex(F.sha2("text", 256)))
    narrow = stage_table(full.select("doc_id", "dig", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    sizes = stage_table(narrow.groupBy("dig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    missing = sizes.join(read_cache(spark, cache, tokenizer), "dig", "left_anti").select(F.col("rep"), F.col("dig").alias("_dig"))
    one = full["doc_id"].eqNullSafe(missing["rep"]) & (full["dig"] == missing["_dig"])
    encode_counts(full.join(missing, one, "left_semi").select("dig", "text"), vocabulary, tokenizer).write.mode("append").option("compression", "zstd").parquet(cache)
    counted = sizes.drop("rep").join(read_cache(spark, cache, tokenizer), "dig")
    return hot_join(narrow, stage_table(counted, "counted"), "dig", "group_size").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
