import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts, token_files
from tessera.llm.common import new_path
from tessera.llm.encoding import PieceEncoder, cut_of

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,cut", [(BYTES, "space"), (WORDS, "word")])
def test_pieces_give_the_ids_of_the_whole_text(spark, path, cut):
    from tests.llm.conftest import ODD_TEXTS

    texts = [x or "" for x in ODD_TEXTS] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert cut_of(path) == cut
    for keep in (700_000, 50):
        e = PieceEncoder(path, cut, keep)
        for _ in range(2):
            got = [x for i in range(0, len(texts), 7) for x in e.encode(texts[i : i + 7])]
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == list(map(plain(path), texts))


def check_pieces(rows, docs, size, ids_of):
    left = Counter()
    by_window = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_window[r.sequence_id].append((r.offset, r.length))
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
    for parts in by_window.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    for d in docs:
        ids = np.array(ids_of(d.text) + [2], "<u4")
        for start in range(0, len(ids), size):
            part = ids[start : start + size]
            left[(d.doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert left == Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    return by_window


@pytest.mark.parametrize("size,windows", [(4096, 64), (300, 2)])
def test_packing(spark, odd_docs, size, windows, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    docs = odd_docs.withColumn("sequence_id", odd_docs.doc_id).withColumn("offset", odd_docs.doc_id)
    check_pieces(packing.pack(docs, WORDS, size, windows).collect(), odd_docs.collect(), size, plain(WORDS))


def test_packing_pads_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    windows = check_pieces(packing.pack(docs, WORDS).collect(), docs.collect(), 4096, plain(WORDS))
    used = sum(n for parts in windows.values() for _, n in parts)
    assert used > 0.97 * 4096 * len(windows)


def test_best_fit_and_fullest():
    w = packing.OpenWindows(10, 2, 0)
    piece = lambda n: (n, 0, n, 0, n)
    assert w.add(piece(6)) == [] and w.add(piece(5)) == []
    assert w.add(piece(3)) == []  # fits both: goes to the window of 6
    assert [(x[0], x[5], x[6]) for x in w.add(piece(7))] == [(6, 0, 0), (3, 0, 6)]  # fits none: the fullest goes
    assert [(x[0], x[5], x[6]) for x in w.add(piece(5))] == [(5, 1, 0), (5, 1, 5)]  # full


def test_no_documents(spark, no_docs):
    assert packing.pack(no_docs, WORDS).collect() == []
    folder = new_path(spark, "t")
    token_files.write_tokens(no_docs, BYTES, folder)
    assert token_files.read_tokens(spark, folder).collect() == []
    assert token_counts.suffix_sums(token_counts.length_histogram(no_docs, BYTES)).collect() == []


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_files_round_trip(spark, odd_docs, path):
    folder = new_path(spark, "t")
    docs = odd_docs.withColumn("start", odd_docs.doc_id)
    shards = token_files.write_tokens(docs, path, folder).collect()
    rows = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    key = lambda d: (d.doc_id is not None, d.doc_id or 0, d.text is not None, (d.text or "").encode())
    at, want = 0, []
    for d in sorted(odd_docs.collect(), key=key):
        ids = np.array(plain(path)(d.text) + [2], "<u4")
        want.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in rows] == want
    assert sum(s.n_tokens for s in shards) == at


def test_length_histogram(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 4)
    sums = token_counts.suffix_sums(token_counts.length_histogram(odd_docs, BYTES)).cache()
    lengths = [len(plain(BYTES)(d.text)) for d in odd_docs.collect()]
    got = {r.length: r for r in sums.collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert (r.n_docs, r.n_tokens) == (lengths.count(n), n * lengths.count(n))
        assert (r.docs_from, r.tokens_from) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_to, r.truncated_tokens) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths))
    assert token_counts.truncated_total(sums, 7) == sum(min(x, 7) for x in lengths)
    assert token_counts.quantile(sums, 0.5) == sorted(lengths)[-(-len(lengths) // 2) - 1]
