"""Removal of long byte strings that occur more than once, by suffix arrays of shards.

Most text repeats nothing, so shards get only text that may. Each window (of `size` bytes) names one anchor inside it: the
place with the least hash of ANCHOR bytes, of equal ones the last. Equal windows have their anchor at the same place, so all
occurrences of a window meet where the anchors' hashes meet. Neighbouring windows with one anchor form a region; equal
regions are counted once. A shard holds the regions of some anchors; those of one with very many are dealt over several.

A shard's suffix array comes from prefix doubling that sorts only what is still tied (Larsson and Sadakane), its common
prefixes from Kasai's walk over all regions side by side. Windows that shards of one anchor have in common are found by
their hashes, sorted and merged; comparing the shards by pairs would grow with the square of their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_slices

SIZE, ANCHOR = 400, 128
#: Regions of one anchor in a shard at most; bytes of text that a task takes up before it builds an array.
REGIONS, SHARD_BYTES = 4000, 1 << 20

_BASE = 0x9E3779B97F4A7C15
_LOW = (1 << 28) - 1
REGION = "fp long, r1 long, r2 long"


def _windows(data: np.ndarray, size: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash at each place of data, and for each window the place of its anchor."""
    n, width = len(data), size - anchor + 1
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
    inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - anchor, pow(_BASE, -1, 1 << 64), np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n])]
    h = (total[anchor:] - total[:-anchor]) * inverse
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    m = len(h)
    value = (h & ~np.uint64(_LOW)) | (np.uint64(_LOW) - np.arange(m, dtype=np.uint64))
    blocks = np.r_[value, np.full(-m % width, ~np.uint64(0))].reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: m - width + 1], left[width - 1 : m])
    return h, _LOW - (least & np.uint64(_LOW)).astype(np.int64)


def _anchors(size: int, anchor: int):
    """A row for each run of windows with one anchor: where it starts, how many, the anchor's hash and the region's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            docs = [t.encode("utf-8", "surrogatepass") for t in texts]
            joined = b"".join(docs)
            if len(joined) < size:
                continue
            h, at = _windows(np.frombuffer(joined, np.uint8), size, anchor)
            begin, out = 0, []
            for i, doc in enumerate(docs):
                if len(doc) >= size:
                    own = at[begin : begin + len(doc) - size + 1]
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    n = np.diff(np.r_[first, len(own)])
                    place = own[first]
                    digest = b"".join([xxhash.xxh3_128_digest(doc[a : a + k + size - 1], p) for a, k, p in zip(first.tolist(), n.tolist(), (place - begin - first).tolist())])
                    r = np.frombuffer(digest, "<i8").reshape(-1, 2)
                    out.append((np.full(len(n), i), first, n, h[place].view(np.int64), r[:, 0], r[:, 1]))
                begin += len(doc)
            if out:
                of, start, n, fp, r1, r2 = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(pa.array(of)), batch.column("k2").take(pa.array(of)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(fp), pa.array(r1), pa.array(r2)], names=["k1", "k2", "start", "n", "fp", "r1", "r2"])

    return run


def _bodies(size: int):
    """The bytes of the regions that a document is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            rows = []
            for text, wanted in zip(texts, batch.column("wanted").to_pylist()):
                doc = text.encode("utf-8", "surrogatepass")
                rows += [(x["fp"], x["r1"], x["r2"], x["sub"], x["subs"], x["copies"], doc[x["start"] : x["start"] + x["n"] + size - 1]) for x in wanted]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 6, pa.binary()))], names=["fp", "r1", "r2", "sub", "subs", "copies", "body"])

    return run


def suffix_array(text: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array and ranks of several texts in one array; a suffix stops at its text's end, which sorts by text.

    end: for each place the end of its text; owner: its text. Also returns the first seven bytes at each place as a number.
    """
    n = len(text)
    seven = np.zeros(n, np.int64)
    padded = np.r_[text, np.zeros(7, np.uint8)].astype(np.int64) + 1
    here = np.arange(n)
    for k in range(7):
        seven = (seven << 9) | np.where(here + k < end, padded[k : k + n], 0)
    order = np.argsort(seven, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(places: np.ndarray, slots: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Give places (in the slots of the array, in order) the slot of their group as rank; which are still tied."""
        head = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[places] = head
        return ~(fresh & np.r_[fresh[1:], True])

    e = seven[order]
    tied = regroup(order, here, np.r_[True, e[1:] != e[:-1]])
    slots = here[tied]
    h = 7
    while len(slots):
        places = order[slots]
        after = places + h
        second = np.where(after < end[places], rank[np.minimum(after, n - 1)] + n, owner[places])
        key = rank[places] * (2 * n + 1) + second
        by = np.argsort(key, kind="stable")
        places, key = places[by], key[by]
        order[slots] = places
        tied = regroup(places, slots, np.r_[True, key[1:] != key[:-1]])
        slots = slots[tied]
        h *= 2
    return order, rank, seven


def common_prefixes(text: np.ndarray, begin: np.ndarray, end: np.ndarray, order: np.ndarray, rank: np.ndarray, seven: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Kasai's common prefix of each suffix with the one before it in the array, for the first `steps` places of each text.

    All texts take a step at the same time: the prefix at the next place is at most one byte shorter.
    """
    stop = np.repeat(end, end - begin)
    out = np.zeros(len(text), np.int64)
    lanes, length = np.arange(len(begin)), np.zeros(len(begin), np.int64)
    for t in range(int(steps.max())):
        go = steps[lanes] > t
        lanes, length = lanes[go], length[go]
        i = begin[lanes] + t
        j = order[np.maximum(rank[i] - 1, 0)]
        room = np.where(rank[i] > 0, np.minimum(stop[i] - i, stop[j] - j), 0)
        length = np.minimum(np.maximum(length - 1, 0), room)
        live = np.flatnonzero(length < room)
        while len(live):  # seven bytes at once; the last seven may pass an end
            a, b = i[live] + length[live], j[live] + length[live]
            live = live[seven[a] == seven[b]]
            length[live] = np.minimum(length[live] + 7, room[live])
            live = live[length[live] < room[live]]
        live = np.flatnonzero(length < room)
        while len(live):
            live = live[text[i[live] + length[live]] == text[j[live] + length[live]]]
            length[live] += 1
            live = live[length[live] < room[live]]
        out[i] = length
    return out


def repeated_starts(bodies: list[bytes], copies: list[int], size: int) -> tuple[list[np.ndarray], list[list[tuple[int, bytes]]]]:
    """For each region a mask of its windows that occur again, and one (start, hash) for each window that is unlike others here."""
    lengths = np.array([len(b) for b in bodies])
    end = np.cumsum(lengths)
    begin = end - lengths
    text = np.frombuffer(b"".join(bodies), np.uint8)
    owner = np.repeat(np.arange(len(bodies)), lengths)
    order, rank, seven = suffix_array(text, end[owner], owner)
    steps = lengths - size + 1
    prefix = common_prefixes(text, begin, end, order, rank, seven, steps)
    following = np.r_[prefix[order[1:]], 0][rank]  # with the suffix after it in the array
    again = (prefix >= size) | (following >= size)
    masks = [again[b : b + k] | (c > 1) for b, k, c in zip(begin.tolist(), steps.tolist(), copies)]
    firsts = [[(t, xxhash.xxh3_128_digest(body[t : t + size])) for t in np.flatnonzero(prefix[b : b + k] < size).tolist()] for body, b, k in zip(bodies, begin.tolist(), steps.tolist())]
    return masks, firsts


def _runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    turns = np.flatnonzero(np.diff(np.r_[0, mask, 0]))
    return turns[::2].tolist(), turns[1::2].tolist()


_FOUND = f"{REGION}, starts array<int>, ends array<int>, single array<struct<t: int, w: binary>>, sub long"
_FOUND_TYPES = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.struct([("t", pa.int32()), ("w", pa.binary())])), pa.int64()]


def _shards(size: int):
    """Rows come in order of anchor and shard, and those of one shard stay together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_bytes = 0

        def flush() -> pa.RecordBatch:
            masks, firsts = _repeated(held, size)
            rows = [(*x[:3], *_runs(m), [{"t": t, "w": w} for t, w in f], x[3]) for x, m, f in zip(held, masks, firsts)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FOUND_TYPES)], names=[*"fp r1 r2 starts ends single sub".split()])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("fp", "r1", "r2", "sub", "subs", "copies", "body"))):
                if held and held[-1][:3] == row[:3]:
                    continue  # a repeated row of the table gives its regions again
                if held_bytes > SHARD_BYTES and (held[-1][0], held[-1][3]) != (row[0], row[3]):
                    yield flush()
                    held, held_bytes = [], 0
                held.append(row)
                held_bytes += len(row[6])
        if held:
            yield flush()

    return run


def _repeated(rows: list[tuple], size: int) -> tuple[list[np.ndarray], list[list[tuple[int, bytes]]]]:
    masks, firsts = repeated_starts([r[6] for r in rows], [r[5] for r in rows], size)
    return masks, [f if r[4] > 1 else [] for r, f in zip(rows, firsts)]


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            rows = []
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), texts, batch.column("spans").to_pylist()):
                doc = text.encode("utf-8", "surrogatepass")
                edge = np.zeros(len(doc) + 1, np.int64)
                if spans:
                    np.add.at(edge, [s["a"] for s in spans], 1)
                    np.add.at(edge, [s["b"] + size - 1 for s in spans], -1)
                a, b = _runs(np.cumsum(edge[:-1]) > 0)
                at = [0, *(x for pair in zip(a, b) for x in pair), len(doc)]
                kept = b"".join(doc[i:j] for i, j in zip(at[::2], at[1::2]))
                rows.append((doc_id, len(doc), len(doc) - len(kept), len(a), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.binary()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR) -> DataFrame:
    """For each document its bytes (UTF-8) without those covered by a `size`-byte string that also starts anywhere else.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary). Strings are judged on the input and
    do not cross documents. Null text: no bytes. Every row is a document of its own: repeated rows repeat each other's
    bytes, and rows that share a doc_id are told apart by their text. No documents: no rows. Other columns are not read.
    """
    text, doc = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    rows = docs.select(doc.alias("doc_id"), text.alias("text"), F.xxhash64(doc, text).alias("k1"), F.xxhash64(F.lit(7), text, doc).alias("k2"))
    anchors = materialize(rows.select("k1", "k2", "text").mapInArrow(_anchors(size, anchor), f"k1 long, k2 long, start int, n int, {REGION}"), "anchors")
    regions = anchors.groupBy("fp", "r1", "r2").agg(F.count("*").alias("copies"), F.min(F.struct("k1", "k2", "start", "n")).alias("place"))
    regions = materialize(regions, "regions")
    groups = regions.groupBy("fp").agg(F.sum("copies").alias("total"), F.count("*").alias("alike")).where("total > 1")
    live = materialize(regions.join(groups, "fp"), "regions")
    subs = F.ceil(F.col("alike") / REGIONS)
    wanted = live.where("alike > 1").select("place", F.struct("fp", "r1", "r2", "copies", F.pmod("r1", subs).alias("sub"), subs.alias("subs"), "place.start", "place.n").alias("x")).groupBy("place.k1", "place.k2").agg(F.collect_list("x").alias("wanted"))
    bodies = rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).select("text", "wanted").mapInArrow(_bodies(size), f"{REGION}, sub long, subs long, copies long, body binary")
    shards = materialize(bodies.repartition("fp", "sub").sortWithinPartitions("fp", "sub", "r1", "r2").mapInArrow(_shards(size), _FOUND), "shards")
    single = shards.where(F.size("single") > 0).select("fp", "r1", "r2", "sub", F.explode("single").alias("s")).select("fp", "r1", "r2", "sub", "s.t", "s.w")
    common = single.groupBy("fp", "w").agg(F.countDistinct("sub").alias("n")).where("n > 1")
    across = single.join(common, ["fp", "w"]).groupBy("fp", "r1", "r2").agg(F.collect_list("t").alias("starts")).select("fp", "r1", "r2", "starts", F.transform("starts", lambda t: t + 1).alias("ends"))
    # Each shard names one window of those alike in it; where another shard has it too and here it is alone, it counts now.
    whole = live.where("alike = 1").select("fp", "r1", "r2", F.array(F.lit(0)).alias("starts"), F.array("place.n").alias("ends"))
    found = shards.where(F.size("starts") > 0).select("fp", "r1", "r2", "starts", "ends").unionByName(across).unionByName(whole)
    spans = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct((F.col("start") + x["starts"]).alias("a"), (F.col("start") + x["ends"]).alias("b")))
    marks = anchors.join(found, ["fp", "r1", "r2"]).select("k1", "k2", spans.alias("spans")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return rows.join(marks, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_remove(size), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
