"""Exact histogram of encoded document lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read, text_slices
from .encoding import cut_of, encoder

#: Lengths that share one window partition of the suffix sums.
BLOCK = 1024


def _lengths(path: str, cut: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches):
            yield pa.RecordBatch.from_pydict({"length": pa.array([len(x) // 4 for x in encoder(path, cut).encode(texts)], pa.int64())})

    return run


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Documents of each encoded length (length, n_docs). Null text has length 0; other columns are not read."""
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_lengths(tokenizer, cut_of(tokenizer)), "length long").groupBy("length").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens of that length, of at least it (docs_from, tokens_from) and in all documents
    cut to L tokens (truncated_tokens); docs_to counts documents of at most L.

    Two levels: sums within blocks of BLOCK lengths, and sums of the few block totals; no task sees the whole histogram.
    The histogram is written and read again, as it is used twice. An empty table gives no rows.
    """
    per = materialize(histogram.groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "lengths").withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    totals = per.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after, before = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    totals = totals.select("block", zero("d", after).alias("docs_after"), zero("t", after).alias("tokens_after"), zero("d", before).alias("docs_before"), zero("t", before).alias("tokens_before"))
    up = Window.partitionBy("block").orderBy("length")
    down = Window.partitionBy("block").orderBy(F.col("length").desc())
    out = per.join(totals, "block").select(
        "length", "n_docs", "n_tokens",
        (F.col("docs_after") + F.sum("n_docs").over(down)).alias("docs_from"),
        (F.col("tokens_after") + F.sum("n_tokens").over(down)).alias("tokens_from"),
        (F.col("docs_before") + F.sum("n_docs").over(up)).alias("docs_to"),
        (F.col("tokens_before") + F.sum("n_tokens").over(up)).alias("tokens_to"),
    )
    return out.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from", "docs_to", (F.col("tokens_to") + F.col("length") * (F.col("docs_from") - F.col("n_docs"))).alias("truncated_tokens"))


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents do not exceed; None for no documents."""
    total = F.max(F.col("docs_to"))
    n = sums.agg(total.alias("n")).first()["n"]
    return None if n is None else sums.where(F.col("docs_to") >= F.lit(q) * n).agg(F.min("length")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens in all documents if each is cut to `limit` tokens; 0 for no documents."""
    below = F.coalesce(F.sum(F.when(F.col("length") <= limit, F.col("n_tokens"))), F.lit(0))
    over = F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0))
    return sums.agg((below + over * limit).alias("n")).first()["n"]


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return suffix_sums(length_histogram(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
