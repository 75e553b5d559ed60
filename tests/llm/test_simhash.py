from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.common import read


def brute_print(text):
    w = (text or "").encode().translate(simhash.LOWER_AZ).split()
    sh = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Forest:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def brute_groups(rows, distance=4):
    f = np.array([x for _, x in rows], np.uint64)
    forest = Forest(len(f))
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance).tolist():
            forest.join(i, j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[forest.find(i)].append(d)
    return sorted(((d, f"{x:016x}", min(ids[forest.find(i)], default=None)) for i, (d, x) in enumerate(rows)), key=str)


def test_odd_documents(spark, odd_docs):
    docs = odd_docs.withColumn("f", odd_docs.doc_id).withColumn("component_id", odd_docs.text)
    want = brute_groups([(r.doc_id, brute_print(r.text)) for r in odd_docs.collect()])
    assert sorted(map(tuple, simhash.near_groups(docs).collect()), key=str) == want
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    # 3 has two rows with different texts; the group without words has 0, 2 and a row of 3
    assert len({(w[2], ) for w in want if w[2] is not None}) <= kept.count() <= len(want)


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, brute_print(r.text)) for r in read(spark, sf, "documents").collect()]
    assert sorted(map(tuple, simhash.op10_simhash(spark, sf).collect()), key=str) == brute_groups(rows)
    kept = [r.doc_id for r in simhash.drop_near_copies(read(spark, sf, "documents")).collect()]
    assert sorted(kept) == sorted({c for _, _, c in brute_groups(rows)})


def test_few_pairs_connect_dense_sets():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 62, 5, dtype=np.uint64)
    f = np.unique(np.concatenate([b ^ np.array([sum(1 << int(x) for x in rng.choice(5, 3, replace=False) * 7) for _ in range(300)], np.uint64) for b in base]))
    f = np.unique(np.r_[f, rng.integers(0, 1 << 62, 300, dtype=np.uint64)])
    f = f[np.argsort(simhash.gray_rank(f))]
    group, roots = np.zeros(len(f), np.int64), []
    for whole in (False, True):
        root = np.arange(len(f))
        for a, b in simhash.linked_pairs(group, f, 4, whole):
            assert (np.bitwise_count(f[a] ^ f[b]) <= 4).all()
            root = simhash.connect(root, a, b)
        roots.append(root)
    assert (roots[0] == roots[1]).all()


@pytest.mark.parametrize("m", [1, 2, 3])
def test_clusters_and_chains(spark, monkeypatch, m):
    rng = np.random.default_rng(m)
    own = simhash._keys
    monkeypatch.setattr(simhash, "_keys", lambda n, d: own({1: 0, 2: 1 << 25, 3: 1 << 33}[m], d))
    f = [int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.int64)]
    for c in f[:5]:
        for _ in range(40):  # a walk: long chains and dense clusters
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                c ^= 1 << int(b)
            f.append(c)
    f = list(dict.fromkeys(f))
    prints = spark.createDataFrame([(i, int(np.uint64(x).view(np.int64))) for i, x in enumerate(f)], "id long, f long").repartition(3)
    got = {int(np.int64(r.f).view(np.uint64)): r.component_id for r in simhash.classes(prints).collect()}
    assert sorted(((i, f"{x:016x}", got[x]) for i, x in enumerate(f)), key=str) == brute_groups(list(enumerate(f)))


def test_index_finds_every_pair(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(simhash, "ROWS", 64)
    f = rng.integers(0, 1 << 12, 700, dtype=np.uint64)
    group = rng.integers(0, 4, 700).astype(np.int64)
    order = np.lexsort((simhash.gray_rank(f), group))
    f, group = f[order], group[order]
    got = {(i, j) for a, b in simhash.linked_pairs(group, f, 2) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(700) for j in range(i + 1, 700) if group[i] == group[j] and (int(f[i]) ^ int(f[j])).bit_count() <= 2}


def test_no_documents(spark, no_docs):
    assert simhash.near_groups(no_docs).collect() == []
    assert simhash.drop_near_copies(no_docs).collect() == []
