"""Token counts from an exact histogram of encoded lengths.

Documents are counted per encoded length; the histogram has one row per length that occurs, however many documents there
are. Running sums over it answer, for every context limit, how many tokens there are in all, how many are left after
truncation to the limit, and which length a given share of the documents reaches. Between two lengths that occur all
answers are linear in the limit, so the rows of the histogram say everything.

The histogram is written once, so every document is encoded once. Running sums are taken per block of lengths and over the
block totals, never over the whole histogram in one task; there is one total per ``BLOCK`` lengths up to the longest text.

Rules: null text counts as empty, length 0. Repeated rows count each. An empty table gives an empty histogram. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.bpe import DEFAULT_FILE, tokenizer_of
from tablewright.llm.common import pieces, stored, text_column

#: Lengths in one block of the running sums.
BLOCK = 4096


def encoded_lengths(docs: DataFrame, text: str = "text", path: str = DEFAULT_FILE) -> DataFrame:
    """n_tokens of every row, with no special tokens added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in pieces(batches, "text"):
            counts = [len(tokenizer.encode(x)) for x in text_column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """Per encoded length (= context limit): documents, documents that are longer or as long, tokens in all and truncated.

    ``total_tokens`` is the same in every row; ``truncated_tokens`` is what is left when every document is cut to
    ``n_tokens``; ``share_at_most`` is the share of documents no longer than it.
    """
    counted = lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))
    counted = counted.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    counted = stored(counted.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")), "token-counts")
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_docs").over(before), zero).alias("docs_before"),
        F.coalesce(F.sum("block_tokens").over(before), zero).alias("tokens_before"),
        F.sum("block_docs").over(Window.partitionBy(F.lit(0))).alias("all_docs"),
        F.sum("block_tokens").over(Window.partitionBy(F.lit(0))).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy("n_tokens")
    summed = counted.withColumns({"docs_upto": F.sum("n_docs").over(within), "tokens_upto": F.sum("tokens").over(within)})
    found = summed.join(blocks, "block").withColumns(
        {"docs_upto": F.col("docs_before") + F.col("docs_upto"), "tokens_upto": F.col("tokens_before") + F.col("tokens_upto")}
    )
    longer = F.col("all_docs") - F.col("docs_upto")
    return found.select(
        "n_tokens",
        "n_docs",
        (longer + F.col("n_docs")).alias("docs_at_least"),
        (F.col("total_tokens") - F.col("tokens_upto") + F.col("tokens")).alias("tokens_at_least"),
        "total_tokens",
        (F.col("tokens_upto") + longer * F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("docs_upto") / F.col("all_docs")).alias("share_at_most"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit and the tokens left for any limits, from the histogram alone."""
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    sums = [
        F.sum(F.least(F.col("n_tokens"), F.lit(int(x))) * F.col("n_docs")).alias(f"limit_{i}") for i, x in enumerate(limits)
    ]
    totals = histogram.agg(*sums)
    pairs = F.explode(F.array(*(F.struct(F.lit(int(x)).alias("context_limit"), F.col(f"limit_{i}").alias("tokens")) for i, x in enumerate(limits))))
    totals = totals.select(pairs.alias("x")).select(F.col("x.context_limit").cast("long").alias("context_limit"), F.coalesce("x.tokens", F.lit(0)).alias("tokens"))
    return asked.join(totals, "context_limit")


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share and the smallest length that at least this share of the documents does not exceed."""
    least = [F.min(F.when(F.col("share_at_most") >= float(q), F.col("n_tokens"))).alias(f"q_{i}") for i, q in enumerate(shares)]
    row = histogram.agg(*least)
    pairs = F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q_{i}").alias("n_tokens")) for i, q in enumerate(shares))))
    return row.select(pairs.alias("x")).select("x.share", "x.n_tokens")
