import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import repeats
from tessera.llm.common import read


def brute(rows, size):
    docs = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + size] for _, b in docs for i in range(len(b) - size + 1))
    out = []
    for d, b in docs:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum()), kept))
    return sorted(out, key=str)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    bodies = [rng.integers(97, 99, int(n), dtype=np.uint8).tobytes() for n in rng.integers(1, 60, 30)] + [b"a" * 50, b"ab" * 30, b"\0\0\0", b"\0\0"]
    n = np.array([len(b) for b in bodies])
    end = np.cumsum(n)
    owner = np.repeat(np.arange(len(bodies)), n)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    order, rank, seven = repeats.suffix_array(text, end[owner], owner)
    suffix = [text[i : end[owner[i]]].tobytes() for i in range(len(text))]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: ([x + 10_000 for x in suffix[i]] + [owner[i]]))
    assert (rank[order] == np.arange(len(text))).all()
    got = repeats.common_prefixes(text, end - n, end, order, rank, seven, n)
    for a, b in zip(order[:-1], order[1:]):
        k = 0
        while k < min(len(suffix[a]), len(suffix[b])) and suffix[a][k] == suffix[b][k]:
            k += 1
        assert got[b] == k


@pytest.mark.parametrize("regions", [4000, 2])
def test_against_brute_force(spark, odd_docs, monkeypatch, regions):
    monkeypatch.setattr(repeats, "REGIONS", regions)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 2000)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    passage, texts = word(400), []
    for i in range(60):
        p = list(passage)
        for k in rng.integers(0, 400, i % 4):
            p[k] = "é"
        texts.append(word(int(rng.integers(0, 80))) + "".join(p[int(rng.integers(0, 50)) :]) + word(20))
    texts += ["ab" * 200, "xy" * 45 + word(9) + "xy" * 45, texts[5], texts[5], word(100), word(39) + "ü"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)] + [(1000 + 64, texts[64]), (None, texts[7])], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more).withColumn("spans", odd_docs.doc_id).withColumn("k1", odd_docs.doc_id)
    got = sorted(map(tuple, repeats.remove_repeats(docs, 100, 30).collect()), key=str)
    assert [(*x[:4], bytes(x[4])) for x in got] == brute([(r.doc_id, r.text) for r in docs.collect()], 100)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in read(spark, sf, "documents").collect()]
    want = [(*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in brute(docs, 400)]
    got = [tuple(r) for r in repeats.op9_suffix_arrays(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in got)


def test_no_documents(spark, no_docs):
    assert repeats.remove_repeats(no_docs).collect() == []
