"""Exact length histogram of encoded documents, with suffix sums.

The histogram has a row per distinct encoded length. Suffix sums over it answer, for every context limit: how many
documents reach it, how many tokens stay when each document is truncated there, and how many are lost. There are at
most sqrt(2 * tokens) distinct lengths, so the histogram of 10**13 tokens has a few million rows at most; sums run in
two levels (blocks of BLOCK lengths, then inside a block) so that no single task sorts all of it. Texts are encoded once:
their histogram is written to the shared folder before sums are taken over it.

A null text has length 0. Rows that repeat count each. Other columns, of any name, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fjordframe.llm.common import mapped, written
from fjordframe.llm.textbytes import pieces
from fjordframe.llm.tokens import default_path, encoder

BLOCK = 128


def length_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(length, n_docs) of the texts' encoded lengths; each task counts its own before the shuffle."""
    tokenizer = tokenizer or default_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for whole in batches:
            sizes = np.concatenate([np.zeros(0, np.int64), *(own.sizes_of(b["text"]) for b in pieces(whole, "text", 2 << 20))])
            length, n = np.unique(sizes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n)], names=["length", "n_docs"])

    return docs.select("text").transform(mapped, count, "length long, n_docs long").groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Each length with totals over lengths at least as long, and what a context limit of that length keeps.

    docs_at_least and tokens_at_least are suffix sums; docs_share is the share of documents no longer (the quantile of
    this length); truncated_tokens is the sum of min(length, limit) and lost_tokens the rest.
    """
    rows = counts.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = blocks.select("block", (F.sum("bd").over(later) - F.col("bd")).alias("ad"), (F.sum("bt").over(later) - F.col("bt")).alias("at"))
    totals = counts.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("length") * F.col("n_docs")).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.join(above, "block").select(
        "length", "n_docs",
        (F.sum("n_docs").over(inside) + F.col("ad")).alias("docs_at_least"),
        (F.sum("tokens").over(inside) + F.col("at")).alias("tokens_at_least"),
    )
    truncated = F.col("all_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")
    return summed.join(F.broadcast(totals)).select(
        "length", "n_docs", "docs_at_least", "tokens_at_least",
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("docs_share"),
        truncated.alias("truncated_tokens"), (F.col("all_tokens") - truncated).alias("lost_tokens"),
    )


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The histogram of encoded lengths with its suffix sums."""
    return suffix_sums(written(length_counts(docs, tokenizer), "lengths"))


def truncated_total(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens): the tokens that stay at each of a list of context limits, from the suffix sums.

    The sums at the first length that reaches a limit give it: all tokens, less those of documents that long, plus the
    limit for each of these. No other row of the histogram counts. Without documents every total is 0.
    """
    first = [F.min(F.when(F.col("length") >= n, F.struct("length", "docs_at_least", "tokens_at_least"))).alias(f"l{k}") for k, n in enumerate(limits)]
    sums = histogram.agg(F.max("tokens_at_least").alias("all"), *first)
    each = F.array(*(F.struct(F.lit(n).alias("limit"), (F.coalesce("all", F.lit(0)) - F.coalesce(F.col(f"l{k}.tokens_at_least"), F.lit(0)) + n * F.coalesce(F.col(f"l{k}.docs_at_least"), F.lit(0))).cast("long").alias("tokens")) for k, n in enumerate(limits)))
    return sums.select(F.explode(each).alias("e")).select("e.limit", "e.tokens")


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least such a share of documents does not exceed; null without documents."""
    least = [F.min(F.when(F.col("docs_share") >= q, F.col("length"))).alias(f"q{k}") for k, q in enumerate(shares)]
    each = F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{k}").alias("length")) for k, q in enumerate(shares)))
    return histogram.agg(*least).select(F.explode(each).alias("e")).select("e.share", "e.length")
