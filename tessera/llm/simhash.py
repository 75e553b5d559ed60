"""SimHash fingerprints and their links by a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, materialize, read

#: Children of a node of the index, and rows of the search that are held at once.
FAN, ROWS = 8, 1 << 18


def fingerprint_of(texts: list[str], shingle: int = 4) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set if more than half the XXH64 of its word shingles, repeats included, set it."""
    hashes, counts = [], []
    for text in texts:
        words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
        n = max(1, len(words) - shingle + 1) if words else 0
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: n - 1].tolist()] if n else []
        stops = (ends[-n:] - 1).tolist() if n else []
        hashes += map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts, stops)], repeat(42))
        counts.append(n)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if full := np.flatnonzero(n).tolist():
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * sums > n[full][:, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprint(text, shingle: int = 4):
    """The column of fingerprints of a text column, as a signed long."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t or "")
            if size > 1 << 20:
                out.append(fingerprint_of(part, shingle))
                part, size = [], 0
        return pd.Series(np.concatenate([*out, fingerprint_of(part, shingle)]).view(np.int64))

    return run(text)


def gray_rank(f: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        f = f ^ (f >> np.uint64(s))
    return f


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def linked_pairs(group: np.ndarray, f: np.ndarray, distance: int, whole: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i < j) of one group at most `distance` bits apart; rows are in order of group and Gray rank.

    whole: not every pair, but pairs enough to connect the same sets: where all rows of a node are surely near, one of them
    stands for all.

    Neighbours in Gray order share bits. A node stands for up to FAN rows or nodes side by side; its mask has the bits in
    which all agree. A descent adds, at each node, the query's differences in the bits that the node shares and its parent
    does not, and drops the whole node once the sum is over `distance`.
    """
    value, mask, lo, hi = [f], [np.full(len(f), ~np.uint64(0))], [np.arange(len(f))], [np.arange(len(f)) + 1]
    owner, kids = group, []
    while len(owner):
        change = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[change, len(owner)])
        if sizes.max() == 1:
            break
        within = np.arange(len(owner)) - np.repeat(change, sizes)
        first = np.flatnonzero(within % FAN == 0)
        kids.append(np.r_[first, len(owner)])
        spread = np.bitwise_or.reduceat(value[-1] ^ np.repeat(value[-1][first], np.diff(kids[-1])), first)
        mask.append(np.bitwise_and.reduceat(mask[-1], first) & ~spread)
        value.append(value[-1][first])
        lo.append(lo[-1][first])
        hi.append(hi[-1][kids[-1][1:] - 1])
        owner = owner[first]
    free = [64 - popcount(m) for m in mask]  # bits that a node leaves open
    if whole:
        for level in range(1, len(value)):
            tight = np.flatnonzero(free[level] <= distance)
            n = hi[level][tight] - lo[level][tight]
            rows = np.repeat(lo[level][tight] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(lo[level][tight], n), rows
    top = len(value) - 1
    root_of = np.repeat(np.arange(len(owner)), hi[top] - lo[top]) if len(f) else np.zeros(0, np.int64)
    todo = [(top, np.arange(a, min(a + ROWS, len(f))), root_of[a : a + ROWS], None) for a in range(0, len(f), ROWS)]
    while todo:
        level, query, node, spent = todo.pop()
        if spent is None:
            spent = popcount((f[query] ^ value[level][node]) & mask[level][node])
        keep = (spent <= distance) & (hi[level][node] > query + (level == 0) * 1) & (hi[level][node] - 1 > query)
        query, node, spent = query[keep], node[keep], spent[keep]
        if not len(query):
            continue
        if level == 0:
            yield query, node
            continue
        if whole:
            sure = spent + free[level][node] <= distance
            yield query[sure], lo[level][node[sure]]
            query, node, spent = query[~sure], node[~sure], spent[~sure]
            if not len(query):
                continue
        n = kids[level - 1][node + 1] - kids[level - 1][node]
        if n.sum() > 4 * ROWS and len(query) > 1:
            half = len(query) // 2
            todo += [(level, query[a], node[a], spent[a]) for a in (slice(None, half), slice(half, None))]
            continue
        parent = np.repeat(node, n)
        child = np.repeat(kids[level - 1][node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        query = np.repeat(query, n)
        more = popcount((f[query] ^ value[level - 1][child]) & mask[level - 1][child] & ~mask[level][parent])
        todo.append((level - 1, query, child, np.repeat(spent, n) + more))


def connect(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of sets (the smallest place of each) after the sets of a[i] and b[i] have become one."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def _links(distance: int):
    """Links within the groups of a partition, as links to one fingerprint of each connected set: fewer than its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            f = fp.view(np.uint64)
            order = np.lexsort((gray_rank(f), key))
            key, f, fp = key[order], f[order], fp[order]
            root = np.arange(len(f))
            for a, b in linked_pairs(key, f, distance, whole=True):
                root = connect(root, a, b)
            own = np.flatnonzero(root != np.arange(len(f)))
            return pa.RecordBatch.from_pydict({"a": fp[own], "b": fp[root[own]]})

        for batch in batches:  # rows come in order of key; a key's rows stay together
            held_k, held_f = np.r_[held_k, batch.column("key").to_numpy()], np.r_[held_f, batch.column("f").to_numpy()]
            if len(held_k) > 4 * ROWS:
                cut = int(np.searchsorted(held_k, held_k[-1]))
                if cut:
                    yield found(held_k[:cut], held_f[:cut])
                    held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k):
            yield found(held_k, held_f)

    return run


def _keys(n: int, distance: int) -> list[list[tuple[int, int]]]:
    """Block choices such that fingerprints within `distance` bits agree on all blocks of at least one choice.

    With distance + m blocks at least m agree; m grows with the number of fingerprints, so groups stay small: the agreeing
    blocks have about as many bits as n, less 15.
    """
    m = 1
    while 64 * m // (distance + m) < min(n.bit_length() - 15, 30):
        m += 1
    b = distance + m
    edges = [64 * i // b for i in range(b + 1)]
    return [list(c) for c in combinations(list(zip(edges, edges[1:])), m)]


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) whose connected sets are those of all fingerprints (column f, distinct) within `distance` bits."""
    choices = _keys(prints.count(), distance)
    keys = []
    for number, blocks in enumerate(choices):
        key = F.lit(number).cast("long")
        for lo, hi in blocks:
            key = key * F.lit(1 << (hi - lo)) + F.shiftrightunsigned("f", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        keys.append(key)
    return prints.select("f", F.explode(F.array(*keys)).alias("key")).repartition("key").sortWithinPartitions("key").mapInArrow(_links(distance), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest node that each node of the edges (a, b) is connected to: (node, root), for nodes that have links.

    Large-star and small-star steps in turn until nothing changes; each step halves paths, so the number of steps follows
    the logarithm of the longest path.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.expr("xxhash64(a, b) % 1000003"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        edges = materialize(small, "links")


def classes(prints: DataFrame, distance: int = 4) -> DataFrame:
    """prints: f and an id. Per distinct f: component_id, the smallest id of all rows whose fingerprints are connected."""
    least = materialize(prints.groupBy("f").agg(F.min("id").alias("least")), "prints")
    roots = components(links(least.select("f"), distance))
    named = least.join(roots, least.f == roots.node, "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    whole = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return named.join(whole, "root").select("f", "component_id")


def near_groups(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """Each document's fingerprint (16 hex digits) and the smallest doc_id that its links reach (component_id).

    Texts without words have fingerprint zero, which links like any other; null texts are such texts. Equal texts and
    repeated rows share a fingerprint and so a group. Null ids never name a group with other ids; a group without any id
    has a null component_id. No documents: no rows. Other columns are not read.
    """
    prints = materialize(docs.select(F.col("doc_id").cast("long").alias("id"), fingerprint(F.col("text").cast("string"), shingle).alias("f")), "fingerprints")
    return prints.join(classes(prints, distance), "f").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id; of equal ids that of the smallest text hash, one of equal rows.

    Null ids come last: such a row stays only if its group has no id. All columns stay as they are.
    """
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("body"))
    marked = materialize(row.select("row", F.struct(F.col("doc").isNull().alias("n"), "doc", F.xxhash64("body").alias("h"), F.monotonically_increasing_id().alias("k")).alias("id"), fingerprint("body", shingle).alias("f")), "fingerprints")
    kept = classes(marked.select("id", "f"), distance).select(F.col("component_id.k").alias("k")).distinct()
    return marked.join(kept, F.col("id.k") == F.col("k"), "left_semi").select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read(spark, sf_dir, "documents"))
