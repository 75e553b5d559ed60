"""Phrase and proximity search in documents by a positional inverted index that is kept in shards.

The index has a row for each slice of documents: the posting lists (term, ascending positions) of its words, document after
document, with one unused position between two documents so that no phrase runs over an end. A search takes a phrase's
rarest term in the shard first and intersects the other terms' lists, shifted by their offset in the phrase, in order of
their length. The benchmark is taken in blocks of bounded size; each block meets every shard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, read, text_slices

#: Bytes outside words become spaces: words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Bytes of benchmark texts that are searched for at once; more texts make more blocks.
BLOCK_BYTES = 8 << 20

INDEX = "shard long, doc_ids array<long>, starts array<int>, terms array<int>, counts array<int>, positions array<int>"
HITS = "shard long, doc int, doc_id long, n_words long, hit array<int>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Phrases:
    """The distinct windows of a block of benchmark texts, as term numbers."""

    def __init__(self, items: Iterable[tuple[str, str | None]], width: int):
        self.terms: dict[bytes, int] = {}
        found: dict[tuple, set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found[tuple(ids[i : i + width])].add(item)
        self.by_length = defaultdict(list)
        for window, names in found.items():
            self.by_length[len(window)].append((window, sorted(names)))


def _index(terms: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch, texts in text_slices(batches):
            ids, starts = [], [0]
            for text in texts:
                ids += map(terms.get, words_of(text), repeat(-1))
                ids.append(-1)
                starts.append(len(ids))
            ids = np.array(ids, np.int32)
            at = np.flatnonzero(ids >= 0)
            own = ids[at]
            order = np.argsort(own.astype(np.uint16) if len(terms) < 1 << 16 else own, kind="stable")
            found, counts = np.unique(own, return_counts=True)
            lists = [batch.column("doc_id").to_pylist(), starts, found, counts.astype(np.int32), at[order].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([lists[0]], pa.list_(pa.int64())), *(pa.array([x], pa.list_(pa.int32())) for x in lists[1:])], names=[f.split()[0] for f in INDEX.split(", ")])
            shard += 1

    return run


def build_index(docs: DataFrame, terms: dict[bytes, int]) -> DataFrame:
    """The stored index of all documents' words that are in `terms` (a search needs no others)."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(source.mapInArrow(_index(terms), INDEX), "postings")


class Shard:
    """Posting lists of one row of the index: keys are term * span + position, ascending."""

    def __init__(self, row: dict):
        self.doc_ids, self.starts = row["doc_ids"], np.asarray(row["starts"])
        self.span = int(self.starts[-1]) + 1
        self.terms, self.counts = np.asarray(row["terms"], np.int64), np.asarray(row["counts"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = np.asarray(row["positions"], np.int64)
        self.keys = np.repeat(self.terms, self.counts) * self.span + self.positions

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's list begins and how long it is (0: the term is not here)."""
        if not len(self.terms):
            return np.zeros_like(terms), np.zeros_like(terms)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.first[i], np.where(self.terms[i] == terms, self.counts[i], 0)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, start) at which a row of `windows` occurs."""
        first, count = self.lists(windows)
        live = np.flatnonzero(count.min(axis=1) > 0)
        rarest = np.argsort(count[live], axis=1, kind="stable")
        lead = rarest[:, 0]
        n = count[live, lead]
        window = np.repeat(live, n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[np.repeat(first[live, lead], n) + inside] - np.repeat(lead, n)
        ranked = np.repeat(rarest, n, axis=0)
        keep = start >= 0
        window, start, ranked = window[keep], start[keep], ranked[keep]
        for k in range(1, windows.shape[1]):
            if not len(window):
                break
            offset = ranked[:, k]
            key = windows[window, offset] * self.span + start + offset
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            keep = (self.keys[i] == key) & (start + offset < self.span)
            window, start, ranked = window[keep], start[keep], ranked[keep]
        return window, start

    def near(self, terms: list[int], within: int) -> list[tuple[int, int]]:
        """The shortest spans (start, end) that hold every one of the terms within so many words of one document."""
        first, count = self.lists(np.array(sorted(set(terms)), np.int64))
        if not count.min():
            return []
        at = np.concatenate([self.positions[f : f + c] for f, c in zip(first, count)])
        which = np.repeat(np.arange(len(count)), count)
        order = np.argsort(at, kind="stable")
        seen, out = {}, []
        for p, t in zip(at[order].tolist(), which[order].tolist()):
            seen.pop(t, None)
            seen[t] = p  # insertion order is the order of the last places
            start = next(iter(seen.values()))
            doc = np.searchsorted(self.starts, start, side="right")
            if len(seen) == len(count) and p - start < within and p < self.starts[doc]:
                out.append((start, p + 1))
        return out


def _search(phrases: Phrases, every: bool):
    tables = {n: (np.array([w for w, _ in found], np.int64).reshape(-1, n), [names for _, names in found]) for n, found in phrases.by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].values.to_numpy(zero_copy_only=False) if k not in ("shard", "doc_ids") else batch.column(k)[i].as_py() for k in batch.schema.names}
                s = Shard(row)
                covered, items = np.zeros(s.span + 1, np.int64), defaultdict(set)
                for n, (windows, names) in tables.items():
                    window, start = s.phrases(windows)
                    np.add.at(covered, start, 1)
                    np.add.at(covered, start + n, -1)
                    docs = np.searchsorted(s.starts, start, side="right") - 1
                    for w, d in np.unique(np.stack([window, docs], axis=1), axis=0).tolist() if len(window) else []:
                        items[d].update(names[w])
                hit = np.flatnonzero(np.cumsum(covered) > 0)
                of = np.searchsorted(s.starts, hit, side="right") - 1
                take = range(len(s.doc_ids)) if every else sorted(items)
                bounds = np.searchsorted(of, [[d, d + 1] for d in take]) if len(take) else []
                rows = [(row["shard"], d, s.doc_ids[d], int(s.starts[d + 1] - s.starts[d] - 1), hit[a:b] - s.starts[d], sorted(items.get(d, ()))) for d, (a, b) in zip(take, bounds)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))], names=[f.split()[0] for f in HITS.split(", ")])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """Benchmark texts, a bounded number of bytes at a time (never fewer than one text)."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        if block and size + len(text or "") > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item or "", text))
        size += len(text or "")
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """For each document the words inside any occurrence of a benchmark window, and the items with occurring windows.

    A window is `width` consecutive words of an item, or a shorter item's words. Columns: doc_id, n_words, hit (word
    positions from 0, ascending), items (ids as strings, sorted as strings). Null texts have no words; an item without an
    id counts as the empty string, items of one id count once. Each row of docs is a document of its own, whatever its id.
    No documents: no rows; no items: no hits. Other columns are not read.
    """
    found = None
    for k, block in enumerate(_blocks(benchmark)):
        phrases = Phrases(block, width)
        hits = build_index(docs, phrases.terms).mapInArrow(_search(phrases, k == 0), HITS)
        found = hits if found is None else found.unionByName(hits)
        if k:
            found = materialize(found, "hits")
    if k:
        merged = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
        found = found.groupBy("shard", "doc").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), merged("hit"), merged("items"))
    return found.select("doc_id", "n_words", "hit", "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """docs without rows in which a benchmark window occurs; all columns stay as they are.

    Equal rows fare alike; rows that share a doc_id are told apart by their text. A row goes only if its text is that of a
    row in which a window occurs, whatever hashes say.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    marked = docs.select(F.struct("*").alias("row"), key.alias("key"), F.col("text").cast("string").alias("body"))
    found = contamination(docs.select(key.alias("doc_id"), "text"), benchmark, width).where(F.size("hit") > 0).select(F.col("doc_id").alias("key")).distinct()
    bad = docs.select(key.alias("key"), F.col("text").cast("string").alias("found")).join(found, "key", "left_semi").distinct()
    return marked.join(bad, (marked.key == bad.key) & (marked.body == bad.found), "left_anti").select("row.*")


def near(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """Proximity matches: (doc_id, start, end) in words, the shortest spans of at most `within` words that hold all terms."""
    words = [w for t in terms for w in words_of(t)]
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Shard(row)
                spans = s.near(list(numbers.values()), within) if numbers else []
                of = [int(np.searchsorted(s.starts, a, side="right")) - 1 for a, _ in spans]
                yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[d] for d in of], pa.int64()), *(pa.array([int(x[k] - s.starts[d]) for x, d in zip(spans, of)], pa.int64()) for k in (0, 1))], names=["doc_id", "start", "end"])

    return build_index(docs, numbers).mapInArrow(run, "doc_id long, start long, end long")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
