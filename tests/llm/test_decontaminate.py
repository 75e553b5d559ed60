import hashlib
import re

import pytest

from tessera.llm import decontaminate
from tessera.llm.common import read

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc_id, len(w), sorted(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [8 << 20, 40])
def test_against_brute_force(spark, odd_docs, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, "a b c d e f g h i j k l"), (2, "word"), (10, "A B C"), (None, "two spaces"), (4, None), (5, "..."), (2, "word"), (6, "It's we'll"), (7, "h i j k l m n o p q r"), (8, "über naïve")]
    long = [(100, "x a b c d e f g h i j k l m n o p q r y"), (101, "c d e f g h i j k l, m"), (102, "j k l a b c d e f g h i"), (103, "a b c d e f g h i j a b c d e f g h i j")]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(long, "doc_id long, text string")).withColumn("hit", odd_docs.doc_id * 0)
    got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.hit, r["items"]) for r in got), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], items, 10)


def test_query(spark):
    got = sorted(map(tuple, decontaminate.op8_decontamination(spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))
    docs = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    want = sorted((d, n, len(h), len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), bool(h)) for d, n, h, i in brute(docs, items, 10))
    assert got == want
    assert any(x[-1] for x in got) and not all(x[-1] for x in got)


def test_empty_tables(spark, no_docs, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, none).collect() == []
    assert {(len(r.hit), len(r["items"])) for r in decontaminate.contamination(odd_docs, none).collect()} == {(0, 0)}


def test_near(spark):
    docs = spark.createDataFrame([(1, "a x x b c"), (2, "a x x x x b"), (3, "b a"), (4, "a"), (5, "b")], "doc_id long, text string").coalesce(1)
    got = {tuple(r) for r in decontaminate.near(docs, ["b", "a"], 4).collect()}
    assert got == {(1, 0, 4), (3, 0, 2)}
