"""Compression-distance classification of toxic text with zstandard dictionaries.

Labelled texts are first parted by their letters (k-means on pairs of bytes: languages and scripts fall apart), copies left
out. Each part has two dictionaries: one trained on its ordinary texts, one on the stretches of words that its toxic texts have
significantly more often. A window (a word) is compressed with neither, and with each: what the toxic dictionary saves is its
distance, unless the ordinary one does clearly better. A document's score comes from how many of its windows reach each of
several thresholds, and how large a share they are, by a logistic regression on labelled documents that the dictionaries have
not seen; the cut that those documents call for lies at PREDICT.

Text is spread before it is compressed: after each letter come two bytes made from it and the letter before. Equal
stretches stay equal, and a match of few letters then saves more than the cost of a match, so short words tell too.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, read, text_slices

#: Labelled documents that are learnt from, at most so many of each kind, the first by a hash of their id.
TOXIC, ORDINARY = 1000, 2400
#: Sizes of the two dictionaries in bytes.
TOXIC_BYTES, ORDINARY_BYTES = 12_000, 112 << 10
#: Letters in a stretch; how much commoner than in ordinary text it is; the least likelihood ratio statistic (a chance of one
#: in 300,000) of its documents.
GRAM, RATIO, SIGNIFICANT = 6, 8, 22.0
#: Bytes saved by a window, from which on it is counted; bytes by which the ordinary dictionary may do better.
THRESHOLDS, WORSE = (6, 9, 12, 15, 18, 24), 14
#: Parts that texts fall into; documents of each kind that a part needs for dictionaries of its own.
PARTS, LEAST = 6, 8
#: Share of ordinary documents above the cut.
FLAGGED = 0.004
PREDICT = 0.7

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_pair = np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.stack([(_pair >> np.uint64(56)).astype(np.uint8), ((_pair >> np.uint64(40)) & np.uint64(255)).astype(np.uint8)], axis=1)
_PARAMETERS = {"window_log": 19, "chain_log": 17, "hash_log": 16, "search_log": 5, "min_match": 5, "target_length": 32, "strategy": zstandard.STRATEGY_BTOPT, "write_checksum": False, "write_content_size": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def spread(words: list[bytes]) -> bytes:
    u = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    out = np.empty((len(u), 3), np.uint8)
    out[:, 0] = u
    out[:, 1:] = _SPREAD[np.r_[np.uint8(32), u[:-1]].astype(np.int64) * 256 + u]
    return out.tobytes()


def letters_of(words: list[bytes]) -> np.ndarray:
    """A text by its pairs of neighbouring bytes, hashed: square roots of their shares."""
    u = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.int64)
    pairs = (u[:-1] * 31 + u[1:] * 17) % 251
    return np.sqrt(np.bincount(pairs, minlength=251) / len(pairs))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)


def parted(x: np.ndarray, parts: int = PARTS, rounds: int = 15) -> np.ndarray:
    """Centres by k-means; each seed is far from those before it, but no outlier."""
    if not len(x):
        return np.zeros((1, 251))
    centres = x.mean(0)[None]
    for _ in range(parts - 1):
        away = ((x[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.r_[centres, x[np.argsort(away, kind="stable")[int(len(x) * 0.98)]][None]]
    for _ in range(rounds):
        at = nearest(x, centres)
        centres = np.array([x[at == k].mean(0) if (at == k).any() else centres[k] for k in range(len(centres))])
    return centres


def spread_each(words: list[bytes]) -> list[bytes]:
    """spread([w]) for each word, in one pass."""
    u = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    out = np.empty((len(u), 3), np.uint8)
    out[:, 0] = u
    before = np.r_[np.uint8(32), u[:-1]]
    before[u == 32] = 32  # as if no word came before
    ends = np.cumsum([len(w) + 1 for w in words])
    own = _SPREAD[before.astype(np.int64) * 256 + u]
    out[:, 1:] = own
    whole = out.tobytes()
    last = _SPREAD[np.array([w[-1] if w else 32 for w in words], np.int64) * 256 + 32].tobytes()
    return [whole[3 * (e - len(w) - 1) : 3 * e] + b" " + last[2 * k : 2 * k + 2] for k, (w, e) in enumerate(zip(words, ends.tolist()))]


class Distance:
    """Bytes that the toxic dictionary saves on a word; 0 where the ordinary one does better by more than WORSE."""

    def __init__(self, ordinary: bytes, toxic: bytes, keep: int = 250_000):
        self.none, self.ordinary, self.toxic = (self._compressor(x) for x in (b"", ordinary, toxic))
        self.known, self.keep, self.empty = {}, keep, not toxic

    @staticmethod
    def _compressor(content: bytes):
        p = zstandard.ZstdCompressionParameters(**_PARAMETERS)
        if not content:
            return zstandard.ZstdCompressor(compression_params=p)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def of(self, x: bytes) -> int:
        """x: a spread word."""
        if self.empty:
            return 0
        own = len(self.toxic.compress(x))
        if len(x) + 16 - own < THRESHOLDS[0]:  # a frame adds less than 16 bytes
            return 0
        saved = len(self.none.compress(x)) - own
        return saved if saved >= THRESHOLDS[0] and own - len(self.ordinary.compress(x)) <= WORSE else 0

    def features(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known = {}
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        self.known.update(zip(new, map(self.of, spread_each(new))) if new else ())
        found = list(map(self.known.__getitem__, words))
        for w in new:
            if len(w) > 64:  # long ones are not kept
                del self.known[w]
        v = np.array(found or [0])
        n = np.array([(v >= t).sum() for t in THRESHOLDS], float)
        return np.r_[np.log1p(n), np.log1p(100 * n / len(v))]


def _grams(text: str) -> np.ndarray:
    x = np.frombuffer(b" " + b" ".join(words_of(text)) + b" ", np.uint8).astype(np.uint64)
    g = np.zeros(max(0, len(x) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        g = g * np.uint64(256) + x[k : k + len(g)]
    return g


def _tally(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct stretches, documents with each, occurrences (at most 8 a document), and all occurrences."""
    per = [np.unique(_grams(t), return_counts=True) for t in texts]
    if not per:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 1
    found, at = np.unique(np.concatenate([u for u, _ in per]), return_inverse=True)
    return found, np.bincount(at, minlength=len(found)), np.bincount(at, np.concatenate([np.minimum(n, 8) for _, n in per]), len(found)), max(1, sum(int(n.sum()) for _, n in per))


def toxic_stretches(toxic: list[str], ordinary: list[str]) -> list[list[bytes]]:
    """What toxic texts have of stretches, within a word or at its ends, that are much and significantly commoner in them."""
    a, docs, often, all_a = _tally(toxic)
    b, others, usual, all_b = _tally(ordinary)
    at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
    same = b[at] == a if len(b) else np.zeros(len(a), bool)
    there, elsewhere = (np.where(same, x[at], 0) if len(b) else np.zeros(len(a)) for x in (usual, others))
    share = max(1, len(toxic)) / max(1, len(toxic) + len(ordinary))
    both = docs + elsewhere
    ratio = 2 * (docs * np.log(docs / (both * share)) + np.where(elsewhere > 0, elsewhere * np.log(np.maximum(elsewhere, 1) / (both * max(1e-9, 1 - share))), 0))
    letters = np.stack([(a >> np.uint64(8 * k)) & np.uint64(255) for k in range(GRAM)]) != 32
    one_word = letters[1:-1].all(0) & (letters[0] | letters[-1])
    typical = a[one_word & (docs >= 3) & (often / all_a > RATIO * (there + 0.5) / all_b) & (ratio >= SIGNIFICANT)]
    out = []
    for t in toxic:
        text = b" " + b" ".join(words_of(t)) + b" "
        edge = np.zeros(len(text) + 1, np.int64)
        p = np.flatnonzero(np.isin(_grams(t), typical))
        np.add.at(edge, p, 1)
        np.add.at(edge, p + GRAM, -1)
        turns = np.flatnonzero(np.diff(np.r_[0, np.cumsum(edge[:-1]) > 0, 0]))
        out += [text[i:j].split() for i, j in zip(turns[::2], turns[1::2])]
    return [x for x in out if x]


def _dictionary(size: int, samples: list[bytes], segment: int) -> bytes:
    """A dictionary by zstandard's training; from too few samples it is the samples themselves, the last `size` bytes."""
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8, steps=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary; the second may be empty."""
    windows = [spread(w[i : i + 8]) for t in ordinary for w in [words_of(t)] for i in range(0, len(w), 8)]
    stretches = [spread(x) for x in toxic_stretches(toxic, ordinary)]
    return _dictionary(ORDINARY_BYTES, windows, 192) if windows else b"", _dictionary(TOXIC_BYTES, stretches, 48) if stretches else b""


def without_copies(rows: list[tuple[int, str | None, int]]) -> list[tuple[int, str | None, int]]:
    """The rows but for those of whose runs of five words more than three tenths stood in earlier ones; all of them if fewer
    than LEAST of a kind would be left."""
    seen: set[int] = set()
    out = []
    for row in rows:
        w = words_of(row[1])
        runs = {zlib.crc32(b" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))}
        if len(runs & seen) <= 0.3 * len(runs):
            out.append(row)
            seen |= runs
    return out if min(sum(r[2] == y for r in out) for y in (0, 1)) >= LEAST else rows


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, the constant first, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), ridge * np.r_[1e-3, np.ones(x.shape[1] - 1)]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Centres of parts, two dictionaries for each, and weights; scores are probabilities."""

    def __init__(self, centres: np.ndarray, pairs: list[tuple[bytes, bytes]], weights: np.ndarray):
        self.centres, self.pairs, self.weights, self.distances = centres, pairs, weights, {}

    def __reduce__(self):
        return Model, (self.centres, self.pairs, self.weights)

    def features(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        part = int(nearest(letters_of(words)[None], self.centres)[0])
        if part not in self.distances:
            same = next((k for k in self.distances if self.pairs[k] is self.pairs[part]), None)
            self.distances[part] = self.distances[same] if same is not None else Distance(*self.pairs[part])
        return self.distances[part].features(words)

    def score(self, texts: list[str | None]) -> list[float]:
        z = [float(self.weights[0] + self.weights[1:] @ self.features(t)) for t in texts]
        return [float(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for v in z]


def learn(rows: list[tuple[int, str | None, int]]) -> Model:
    """rows: id, text, label. Three fifths make the dictionaries, the rest the weights and the cut.

    Parts with fewer than LEAST documents of a kind share dictionaries made from all. The cut is moved to PREDICT from where
    FLAGGED of the ordinary documents are above it, but never from below one half or above PREDICT.
    """
    rows = without_copies(sorted(rows, key=lambda r: (r[0], r[1] or "", r[2])))
    x = np.array([letters_of(words_of(t)) for _, t, _ in rows]).reshape(-1, 251)
    centres = parted(x)
    part = nearest(x, centres) if len(rows) else np.zeros(0, int)
    first = np.array([zlib.crc32(str(d).encode()) % 5 < 3 for d, _, _ in rows], bool)
    label = np.array([y for _, _, y in rows], int)
    made = lambda at: dictionaries(*([rows[i][1] or "" for i in np.flatnonzero(at & (label == y))] for y in (1, 0)))
    whole = made(first)
    own = [first & (part == k) for k in range(len(centres))]
    model = Model(centres, [made(at) if min((label[at] == y).sum() for y in (0, 1)) >= LEAST else whole for at in own], np.zeros(1 + 2 * len(THRESHOLDS)))
    y = label[~first].astype(float)
    if 0 < y.sum() < len(y):
        found = np.array([model.features(rows[i][1]) for i in np.flatnonzero(~first)])
        model.weights = logistic(found, y)
        z = model.weights[0] + found @ model.weights[1:]
        top = np.log(PREDICT / (1 - PREDICT))
        model.weights[0] += top - min(max(float(np.quantile(z[y == 0], 1 - FLAGGED)), 0.0), top)
    else:  # nothing to calibrate with: all documents alike, by the share of toxic labels
        model.weights[0] = np.log((label.sum() + 0.5) / ((1 - label).sum() + 0.5))
    return model


def train(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    """A model from at most `toxic` and `ordinary` labelled documents whose crc32 of the id, mod 3, is not 1."""
    clean = labels.where("doc_id is not null and toxic is not null").where(F.pmod(crc32_of_id(), F.lit(3)) != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    part = lambda y, n: clean.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    known = part(1, toxic).unionByName(part(0, ordinary)).collect()
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in known], "chosen long, label int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen")).select("doc_id", "text", "label").distinct()
    return learn([tuple(r) for r in found.toLocalIterator()])


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(texts), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document, from its text alone; null and empty texts score as texts without windows.

    Repeated rows score alike, each in a row of its own. No documents: no rows. Other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_score(model), "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that score at least PREDICT; all columns stay as they are."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd

        return pd.Series(model.score(list(texts)), dtype=float)

    row = docs.select(F.struct("*").alias("row"), scored(F.col("text").cast("string")).alias("score"))
    return row.where(F.col("score") < PREDICT).select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; a null doc_id is not held out."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(F.pmod(crc32_of_id(), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
