import math
import re
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing as M

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens_of(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "surrogatepass").translate(LOWER)), None]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_base(rows, docs):
    known = Counter(t for d in docs if not is_held(d.doc_id) for t in tokens_of(d.text))
    n, v = sum(known.values()), len(known)
    want = sorted((str(d.doc_id), is_held(d.doc_id), len(x := tokens_of(d.text)), sum(t in known for t in x), n, round(sum(math.log10((known[t] + 1) / (n + v + 1)) for t in x), 6)) for d in docs)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)
    assert got == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def hash_of(word):
    if word is None:
        return int(M.END)
    data = np.frombuffer(word, np.uint8)
    return int(M.hashes(data, np.array([0]), np.array([len(data)]))[0])


def squash(x):
    return 1 / (1 + math.exp(-max(-11, min(11, x))))


def logit(p):
    p = max(1e-5, min(1 - 1e-5, p))
    return math.log(p / (1 - p))


def bits(h):
    return [h >> (63 - i) & 1 for i in range(M.PATH)]


def contexts_at(words, hashed, i):
    """Commonest short word so far (of equal ones the last to reach its count), word before."""
    seen, often = Counter(), 0
    top = 0
    for w, h in zip(words[:i], hashed[:i]):
        if w is not None and len(w) <= M.SHORT:
            seen[h] += 1
            if seen[h] >= top:
                top, often = seen[h], h
    return [often, hashed[i - 1] if i else 0]


def slots(context, h):
    return M.slots_of(np.array([context], np.uint64), M.path_of(np.array([h], np.uint64)))[0].tolist()


def phrase_hash(words):
    """Of two phrases that follow as often the one of the greater hash counts (as a signed number)."""
    s = sum(((h ^ (h >> 29)) * int(M._MIX2)) % (1 << 64) * (2 * i + 1) for i, h in enumerate(words)) % (1 << 64)
    out = ((s ^ (s >> 32)) * int(M._MIX) + len(words)) % (1 << 64)
    return out - (1 << 64) if out >> 63 else out


def slow_scores(docs):
    """The same score, a token and a bit after the other. Phrases are compared by their words."""
    texts = [tokens_of(d.text) for d in docs]
    hashed = [[hash_of(w) for w in t] for t in texts]
    held = [is_held(d.doc_id) for d in docs]
    count = Counter(h for t, o in zip(hashed, held) if not o for h in t)
    total, once = sum(count.values()), sum(c == 1 for c in count.values())
    table, tree, spelled = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), Counter()
    follow = defaultdict(Counter)

    def chosen(h):
        out = []
        for i in range(M.ORDER, len(h)):
            c = 0
            for x in h[i - M.ORDER : i]:
                c = ((c ^ (c >> 31)) * int(M._MIX) + x) % (1 << 64)
            c = ((c ^ (c >> 31)) * int(M._MIX2)) % (1 << 64)
            if (c >> 33) % M.EVERY == 0:
                out.append((i, c))
        return [(i, j, c, tuple(h[i:j])) for (i, c), j in zip(out, [i for i, _ in out[1:]] + [len(h)])]

    for w, h, o in zip(texts, hashed, held):
        if o:
            continue
        for _, _, c, phrase in chosen(h):
            follow[c][phrase] += 1
        spelled.update(x for x in w if x is not None)
        for i, x in enumerate(h):
            node = 1
            at = [slots(c, x) for c in contexts_at(w, h, i)]
            for b, y in enumerate(bits(x)):
                tree[node][y] += 1
                node = 2 * node + y
                for k in range(M.CONTEXTS):
                    table[k, at[k][b]][y] += 1
    ones, zeros = np.zeros((len(M.ORDERS), M.SLOTS)), np.zeros((len(M.ORDERS), M.SLOTS))
    for w in [w for w, n in spelled.items() if n == 1]:
        text, _, near = M._before([w])
        for y, at in zip(*M._bits(text, near)):
            (ones if y else zeros)[np.arange(len(M.ORDERS)), at] += 1
    out = []
    for w, h, o in zip(texts, hashed, held):
        score, free, last, told = 0.0, set(), False, Counter()
        for i, j, c, phrase in chosen(h):
            n = sum(follow[c].values())
            if n <= (0 if o else 1):
                continue
            best = max(follow[c].values())
            hit = phrase == max((k, phrase_hash(p), p) for p, k in follow[c].items())[2]
            chance = (best + 0.2) / (n + 1)
            p = (told[last, True] + 2 * ((1 + chance) / 2 if last else chance)) / (told[last, True] + told[last, False] + 2)
            score += math.log2(p if hit else 1 - p)
            told[last, hit] += 1
            last = hit
            if hit:
                free.update(range(i, j))
        weights = [[float(x) for x in M.START] for _ in range(1 + M.PATH)]
        weights[0] = [1.0, 0, 0, 0]
        own, new, seen_new = defaultdict(lambda: [0, 0]), [], 0
        flag = math.log((total - once + 0.4) / (once + 0.4))
        spell_w = [M.SPELL_START] * len(M.ORDERS)
        todo = [i for i in range(len(h)) if i not in free]
        for a in range(0, len(todo), M.TOGETHER):
            moves, marks = [], []
            for i in todo[a : a + M.TOGETHER]:
                known = count[h[i]] > 0
                steps = [(0, int(known), 0, [flag, 0, 0], squash(flag))]
                if known:
                    node, at = 1, [slots(c, h[i]) for c in contexts_at(w, h, i)]
                    for b, y in enumerate(bits(h[i])):
                        wide = (tree[node][1] + 0.4) / (sum(tree[node]) + 0.8)
                        x = [logit(wide)]
                        for k in range(M.CONTEXTS):
                            n = table[k, at[k][b]]
                            p = (n[1] + float(M.TRUST[k]) * wide) / (sum(n) + float(M.TRUST[k]))
                            x.append(logit(p))
                            wide = p if not k else wide
                        steps.append((1 + b, y, node, x, wide))
                        node = 2 * node + y
                    mass = sum(c for x, c in count.items() if x >> (64 - M.PATH) == h[i] >> (64 - M.PATH))
                    score += math.log2(count[h[i]] / mass)
                for place, y, node, x, prior in steps:
                    n = own[node]
                    x = [*x, logit((n[1] + float(M.OWN_TRUST) * prior) / (sum(n) + float(M.OWN_TRUST)))]
                    p = squash(sum(u * v for u, v in zip(weights[place], x)))
                    score += math.log2(p if y else 1 - p)
                    moves += [(place, k, float(M.RATE) * v * (y - p)) for k, v in enumerate(x)]
                    marks.append((node, y))
                if not known:
                    again = (seen_new - len(new) + 0.5) / (seen_new + 1)
                    if h[i] in new:
                        score += math.log2(again / len(new))
                    else:
                        score += math.log2(1 - again)
                        new.append(h[i])
                        text, _, near = M._before([w[i] or b""])
                        move = [0.0] * len(M.ORDERS)
                        ys, ats = M._bits(text, near)
                        for y, at in zip(ys, ats):
                            x = [math.log((ones[k, s] + 0.4) / (zeros[k, s] + 0.4)) for k, s in enumerate(at)]
                            p = squash(sum(u * v for u, v in zip(spell_w, x)))
                            score += math.log2(p if y else 1 - p)
                            move = [m + M.SPELL_RATE * 8 * v * (int(y) - p) / len(ys) for m, v in zip(move, x)]
                        spell_w = [u + m for u, m in zip(spell_w, move)]
                    seen_new += 1
            for place, k, v in moves:
                weights[place][k] += v
            for node, y in marks:
                own[node][y] += 1
        out.append(score * math.log10(2))
    return out


def test_scores_are_those_of_the_slow_version(spark):
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t[:700]) for i, t in enumerate(base)] + [(100 + i, (t or "")[:300]) for i, t in enumerate(base[:9])] + [(200, None), (201, "zq zq zq xy zq"), (202, "The the THE the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in M.score(docs).collect()}
    kept = docs.collect()
    check_base(list(found.values()), kept)
    for d, want in zip(kept, slow_scores(kept)):
        assert found[d.doc_id].score == pytest.approx(want, rel=2e-3, abs=0.02), d.doc_id


def test_query_and_held_out_gain(spark):
    path = "/root/testdata/sf0.01"
    got = M.op1_context_mixing(spark, path).collect()
    check_base(got, spark.read.parquet(f"{path}/documents.parquet").collect())
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_texts(spark, odd_docs, no_docs):
    check_base(M.score(odd_docs).collect(), odd_docs.collect())
    assert M.score(no_docs).collect() == []
    held = spark.createDataFrame([(i, "a b") for i in range(200) if is_held(i)], "doc_id long, text string")
    rows = M.score(held).collect()
    assert {(r.n_known, r.train_tokens) for r in rows} == {(0, 0)} and all(math.isfinite(r.score) for r in rows)


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    one, three = ({r.doc_id: r.score for r in M.score(d).collect()} for d in (docs.coalesce(1), docs.repartition(3, "doc_id")))
    for k, x in one.items():
        assert three[k] == pytest.approx(x, rel=0.1)  # spelling is learnt from the words that a slice has once


def test_long_words_are_counted_in_stretches(monkeypatch):
    words = [b"abcdefghij" * 50, b"xyz"]
    whole = M.spelling_counts(words)
    monkeypatch.setattr(M, "STRETCH", 64)
    assert (M.spelling_counts(words) == whole).all()


def test_other_rows_at_the_second_reading_fail(spark):
    docs = spark.range(0, 50, 1, 2).select(F.col("id").alias("doc_id"), F.udf(lambda i: uuid.uuid4().hex, "string")("id").alias("text"))
    with pytest.raises(Exception, match="not those of the first reading"):
        M.score(docs).collect()


def test_arrays_are_laid_out_by_predictor():
    """What the limit of CPU time a GB asks for: odds without the chance itself, slots of an order side by side."""
    odds = M.log_odds(np.array([3.0, 1e-9], np.float32), np.array([1.0, 2.0], np.float32))
    assert np.array_equal(odds, np.array([np.log(np.float32(3)), -M.FAR], np.float32))
    text, _, near = M._before([b"abc", b""])
    y, at = M._bits(text, near)
    assert y.tolist() == np.unpackbits(text).tolist() and at.shape == (8 * len(text), len(M.ORDERS)) and at.T.flags.c_contiguous
