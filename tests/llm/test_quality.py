import re
import zlib
from collections import Counter

import numpy as np

from tessera.llm import quality
from tessera.llm.common import read

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def columns(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed


def test_rules_and_verdicts(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (999, None, 0)], "doc_id long, quality int, toxic int")
    texts = [(500, "a b c d e f g h i " * 3, "x"), (501, "p q r s t u v w\nx\np q r s t u v w\nx\n \n \n", "x"), (502, "a b c d e f g h", "x"), (None, "z" * 10, None)]
    docs = odd_docs.select("doc_id", "text", "lang").union(spark.createDataFrame(texts, "doc_id long, text string, lang string")).withColumn("kept", odd_docs.doc_id)
    got = sorted((r.doc_id or 0, *columns(r)) for r in quality.judge(docs, labels).collect())
    assert got == sorted((r.doc_id or 0, *brute(r.text)) for r in docs.collect())


def test_empty_tables(spark, no_docs, odd_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(no_docs, labels).collect() == []
    assert all(r.kept != r.base_failed for r in quality.judge(odd_docs, labels).collect())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in quality.op5_quality(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in read(spark, sf, "documents").limit(300).collect()}
    assert all(columns(got[d]) == brute(t) for d, t in docs.items())
    labels = {r.doc_id: r.quality for r in read(spark, sf, "labels").collect() if r.doc_id in got and not got[r.doc_id].base_failed}
    good = np.array([got[d].kept for d, q in labels.items() if q == 1])
    bad = np.array([got[d].kept for d, q in labels.items() if q == 0])
    print(good.mean(), bad.mean(), len(good), len(bad))
    assert good.mean() > 0.95 and bad.mean() < 0.1


def test_threshold():
    t = quality.best_threshold(np.array([0.0, 1.0, 2.0, 3.0]), np.array([False, False, True, True]))
    assert t == 1.5
    assert quality.best_threshold(np.array([0.0, 1.0]), np.array([True, True])) == -np.inf


def test_all_labelled_documents_teach(spark):
    """Far more labelled documents than a sample of 5,000 a class: counts and threshold as a plain version has them over all."""
    word = lambda i, q: f"{'good' if q else 'bad'}{i * 7919 % 4001} w{i % 53} x{i * 31 % 97}"
    rows = [(i, i % 2, word(i, i % 2) if i % 11 else word(i, 1 - i % 2)) for i in range(24_000)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, q) for i, q, _ in rows], "doc_id long, quality int")
    fold = [zlib.crc32(str(i).encode()) % 2 for i, _, _ in rows]
    words = quality.Words([t for _, _, t in rows])
    buckets, doc = words.ngrams()
    raw = 1.0 + np.bincount(buckets, minlength=quality.BUCKETS)
    trusted = np.array([q == 1 and f == 0 for (_, q, _), f in zip(rows, fold)])
    target = 1.0 + np.bincount(buckets[trusted[doc]], minlength=quality.BUCKETS)
    ratio = quality._ratio(words, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    held = np.array(fold) == 1
    threshold = quality.best_threshold(ratio[held], np.array([q for _, q, _ in rows])[held] == 1)
    got = {r.doc_id: r.ratio for r in quality.judge(docs, labels).collect()}
    assert np.allclose([got[i] for i, _, _ in rows], ratio, rtol=0, atol=1e-9)
    scored = spark.createDataFrame([(float(r), q) for (_, q, _), r, h in zip(rows, ratio, held) if h], "ratio double, quality int")
    assert quality.threshold_of(scored) == threshold


def test_threshold_of_a_table(spark):
    of = lambda rows: quality.threshold_of(spark.createDataFrame(rows, "ratio double, quality int").repartition(3))
    assert of([(0.0, 0), (1.0, 0), (2.0, 1), (3.0, 1)]) == 1.5
    assert of([(0.0, 1), (1.0, 1)]) == of([]) == of([(0.0, 1), (1.0, 0)]) == -np.inf
