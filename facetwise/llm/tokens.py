"""Token counts as an exact length histogram.

Documents are aggregated by encoded length before anything is shuffled; suffix sums over the histogram then answer
totals, quantiles and truncated totals for every context limit. The suffix sums are two-level (within blocks of BLOCK
lengths, then over blocks), so no task sees more than BLOCK lengths or the list of blocks.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetwise.llm.common import Scratch, Shared

#: The published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 256
VOCABULARY_BYTES = 64_000_000


def ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a vocabulary file on the driver: base64 and a number a line."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path}: give the path of a .tiktoken file (base64 and rank a line)")
    with open(path, "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{path} has over {VOCABULARY_BYTES} bytes: too large to broadcast")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def encoding(vocabulary: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})


def lengths(docs: DataFrame, spark: SparkSession, *, path: str) -> DataFrame:
    """(doc_id, n_tokens) per row of docs. Null and empty texts have 0 tokens; special tokens in a text are plain text."""
    shared = Shared(spark, ranks(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encode = encoding(shared.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def histogram(docs: DataFrame, spark: SparkSession, *, path: str) -> DataFrame:
    """(n_tokens, n_docs): documents by encoded length; counted inside each partition before the shuffle.

    Null and empty texts have length 0; texts of any length are encoded whole; repeated rows count each; no documents
    give no rows; other columns are not read.
    """
    shared = Shared(spark, ranks(path))

    def run(batches):
        encode, seen = encoding(shared.value).encode_ordinary, {}
        for b in batches:
            n = np.array([len(encode(t)) if t else 0 for t in b.column(0).to_pylist()], np.int64)
            for k, v in zip(*np.unique(n, return_counts=True), strict=True):
                seen[int(k)] = seen.get(int(k), 0) + int(v)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n"])

    parts = docs.select(F.col("text").cast("string")).mapInArrow(run, "n_tokens long, n long")
    # Written, as it is small and read more than once: the texts are encoded once.
    return Scratch(spark).cut(parts.groupBy("n_tokens").agg(F.sum("n").alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """One row a length L that occurs: n_tokens = L, n_docs, and over all documents

    docs_ge, tokens_ge: documents at least L long and their tokens; total_at: tokens left if texts are cut at L;
    docs_le_share: share of documents at most L long (quantiles); total_docs, total_tokens. An empty histogram gives no rows.
    """
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("t", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bn"), F.sum("t").alias("bt"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bn").over(above), zero).alias("bn"),
        F.coalesce(F.sum("bt").over(above), zero).alias("bt"),
        F.sum("bn").over(whole).alias("total_docs"),
        F.sum("bt").over(whole).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.withColumn("sn", F.sum("n_docs").over(inside)).withColumn("st", F.sum("t").over(inside)).join(blocks, "block")
    docs_ge, tokens_ge = F.col("sn") + F.col("bn"), F.col("st") + F.col("bt")
    return out.select(
        "n_tokens",
        "n_docs",
        docs_ge.alias("docs_ge"),
        tokens_ge.alias("tokens_ge"),
        (F.col("total_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("total_at"),
        ((F.col("total_docs") - docs_ge + F.col("n_docs")) / F.col("total_docs")).alias("docs_le_share"),
        "total_docs",
        "total_tokens",
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens of all documents cut at any limit, from the suffix sums alone."""
    row = sums.where(F.col("n_tokens") >= limit).orderBy("n_tokens").select("docs_ge", "tokens_ge", "total_tokens").first()
    if row is None:
        row = sums.select("total_tokens").first()
        return row["total_tokens"] if row else 0
    return row["total_tokens"] - row["tokens_ge"] + limit * row["docs_ge"]


def quantile(sums: DataFrame, q: float) -> int | None:
    """Least length that at least a share q of the documents does not exceed; None without documents."""
    row = sums.where(F.col("docs_le_share") >= q).orderBy("n_tokens").select("n_tokens").first()
    return row["n_tokens"] if row else None
