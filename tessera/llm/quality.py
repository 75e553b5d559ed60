"""Quality rules and a hashed n-gram log-likelihood ratio of a trusted target against the raw corpus."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc32_of_id, materialize, read, text_slices

#: Hash buckets of the two multinomials.
BUCKETS = 1 << 16

SPACE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words of a slice of texts: numbers of distinct words (ids) over all texts, and where each text's words begin."""

    def __init__(self, texts: list[str]):
        self.number = defaultdict(count().__next__)
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.n = np.fromiter(map(len, split), np.int64, len(split))
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.ids = np.fromiter((i for words in split for i in map(self.number.__getitem__, words)), np.int64, int(self.start[-1]))
        self.doc = np.repeat(np.arange(len(split)), self.n)

    def ngrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words and pairs of neighbours, and the text of each."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number))[self.ids]
        pair = self.doc[1:] == self.doc[:-1]
        two = (h[:-1] * _MIX + h[1:])[pair] * _MIX
        return np.concatenate([(h * _MIX) >> np.uint64(48), two >> np.uint64(48)]).astype(np.int64) % BUCKETS, np.concatenate([self.doc, self.doc[1:][pair]])

    def repeated(self) -> np.ndarray:
        """For each text, its words inside WINDOW-word windows that are found at least twice in it."""
        ids = self.ids.astype(np.uint64) + np.uint64(1)
        n = len(ids) - WINDOW + 1
        out = np.zeros(len(self.n), np.int64)
        if n <= 0:
            return out
        key = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            key = (key ^ (key >> np.uint64(29))) * _MIX + ids[k : k + n]
        ok = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])
        key = (key[ok] ^ (key[ok] >> np.uint64(31))) * _MIX + self.doc[ok].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(ok) + 1, bool)
        twice[1:-1] |= same
        twice[:-2] |= same
        at = ok[order[twice[:-1]]]
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        return np.bincount(self.doc, np.cumsum(edge[:-1]) > 0, len(self.n)).astype(np.int64)


def rules(texts: list[str], words: Words) -> dict[str, np.ndarray]:
    dup = []
    for t in texts:
        seen: set[str] = set()
        lines = [x for x in t.split("\n") if x.strip(SPACE)]
        seen.update(lines)
        dup.append(len(lines) - len(seen))
    return {
        "n_words": words.n,
        "word_chars": np.array([len(t) - sum(map(t.count, SPACE)) for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": words.repeated(),
    }


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bucket counts of all texts, and of the trusted ones, once for each task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch, texts in text_slices(batches):
        buckets, doc = Words(texts).ngrams()
        raw += np.bincount(buckets, minlength=BUCKETS)
        trusted = np.array(batch.column("trusted").to_pylist(), bool)
        target += np.bincount(buckets[trusted[doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_pydict({"bucket": at, "raw": raw[at], "target": target[at]})


def _ratio(words: Words, weights: np.ndarray) -> np.ndarray:
    """Mean log-likelihood ratio of each text's n-grams; 0 for none."""
    buckets, doc = words.ngrams()
    n = np.bincount(doc, minlength=len(words.n))
    return np.bincount(doc, weights[buckets], len(words.n)) / np.maximum(n, 1)


RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double"


def _judge(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            words = Words(texts)
            r = rules(texts, words)
            failed = (r["n_words"] < 20) | (100 * r["n_repeat_words"] > 30 * r["n_words"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **r, "base_failed": failed, "ratio": _ratio(words, weights)})

    return run


def best_threshold(ratio: np.ndarray, good: np.ndarray) -> float:
    """The cut with the highest sum of shares of good texts at or above it and of others below it; of equal ones the lowest.

    Halfway to the next lower ratio. Without both classes it keeps everything.
    """
    if not good.any() or good.all():
        return -np.inf
    order = np.argsort(ratio, kind="stable")
    ratio, good = ratio[order], good[order]
    below = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum() - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    below[1:-1][ratio[1:] == ratio[:-1]] = -1
    k = int(np.argmax(below))
    return -np.inf if k == 0 else np.inf if k == len(ratio) else float((ratio[k - 1] + ratio[k]) / 2)


def threshold_of(scored: DataFrame) -> float:
    """best_threshold of a table (ratio, quality) of any size: prefix sums over ranges of ratios, of which only totals meet."""
    good, bad = F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")
    ranged = materialize(scored.groupBy("ratio").agg(good, bad).repartitionByRange("ratio").withColumn("range", F.spark_partition_id()), "ratios")
    totals = ranged.groupBy("range").agg(F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"))
    n_good, n_bad = totals.agg(F.sum("all_good"), F.sum("all_bad")).first()
    if not n_good or not n_bad:
        return -np.inf
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("range", *(F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"base_{c}") for c in ("good", "bad")))
    lower = Window.partitionBy("range").orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    below = lambda c: F.col(f"base_{c}") + F.coalesce(F.sum(c).over(lower), F.lit(0))
    # Whole numbers: the shares' difference times both totals.
    gain = below("bad") * F.lit(n_good) - below("good") * F.lit(n_bad)
    best = ranged.join(base, "range").select("ratio", gain.alias("gain")).orderBy(F.desc("gain"), "ratio").first()
    if best.gain <= 0:
        return -np.inf
    return (ranged.where(F.col("ratio") < best.ratio).agg(F.max("ratio")).first()[0] + best.ratio) / 2


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rules and verdict for every document: the columns of RESULT, and kept.

    The target multinomial comes from all trusted documents (labels.quality 1) with an even crc32 of their id; the raw one
    counts every document. Both have one added to each bucket. A document is kept if no rule fails it and its mean ratio
    reaches the threshold that best parts all labelled documents with an odd crc32, which the target has not seen.
    Null text: no words, and so failed. Null or unlabelled ids teach nothing. Repeated rows are judged alike, each in a
    row of its own; contradicting labels of an id count as 0. No documents: no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    clean = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = clean.where("quality in (0, 1)").withColumn("fold", F.pmod(crc32_of_id(), F.lit(2)))
    teach = known.where("quality = 1 and fold = 0").select("doc_id", F.lit(True).alias("trusted"))
    # Labels grow with the documents, so they are merged and not broadcast. Rows without an id have no label, and would meet in one task of the join.
    taught = docs.where("doc_id is not null").join(teach.hint("merge"), "doc_id", "left").select("text", F.coalesce("trusted", F.lit(False)).alias("trusted"))
    told = taught.unionByName(docs.where("doc_id is null").select("text", F.lit(False).alias("trusted")))
    counts = told.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, a, b in counts:
        raw[bucket] += a
        target[bucket] += b
    weights = np.log(target / target.sum()) - np.log(raw / raw.sum())
    judged = materialize(docs.mapInArrow(_judge(weights), RESULT), "judged")
    threshold = threshold_of(judged.select("doc_id", "ratio").join(known.where("fold = 1"), "doc_id").select("ratio", "quality"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= threshold))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
