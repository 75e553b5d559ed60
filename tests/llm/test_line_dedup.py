import hashlib
from collections import defaultdict

import duckdb

from tessera.llm import line_dedup
from tessera.llm.common import read


def chunks(text):
    lines, out, part, last = text.split("\n"), [], [], 0
    for i, line in enumerate(lines):
        x = int(hashlib.md5(line.encode()).hexdigest()[:7], 16)
        part.append(line)
        r = (last * 31 + x) % 1_000_003
        last = x
        if r % 2 == 0 and len(part) >= 2:
            out.append(part)
            part = []
    if part and len(part) < 2 and out:
        part = out.pop() + part
    return out + [part] if part else out


def test_short_passages_are_found(spark):
    words = [f"line {i} of text {i * 7 % 13}" for i in range(400)]
    rows = [(i, "\n".join([f"own {i} a", f"own {i} b", *words[10 * i : 10 * i + 8], f"own {i} c"])) for i in range(40)]
    rows += [(100 + i, "\n".join([f"other {i} a", *words[10 * i : 10 * i + 8], f"other {i} b", f"other {i} c"])) for i in range(40)]
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    left = sum("line " in x for i in range(40) for x in out[100 + i].split("\n"))
    assert left < 0.75 * 40 * 8
    assert all("other" in out[100 + i] for i in range(40)) and all(out[i] == t for i, t in rows[:40])


def brute(rows):
    rows = [(d, t) for d, t in rows]
    order = sorted({(d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest(), t) for d, t in rows}, key=lambda x: x[:3])
    seen, new = set(), {}
    for none, d, h, t in order:
        kept = []
        for c in chunks(t or ""):
            body = "\n".join(c)
            if len([x for x in c if x.strip(" ")]) >= 2:
                if body in seen:
                    continue
                seen.add(body)
            kept.append(body)
        new[(none, d, h)] = None if t is None else "\n".join(kept)
    return sorted(((d, new[(d is None, d or 0, hashlib.md5((t or "").encode()).hexdigest())]) for d, t in rows), key=str)


def test_against_brute_force_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, sf, "documents")
    got = sorted(map(tuple, line_dedup.op2_line_dedup(spark, sf).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(c.sql(line_dedup.SQL).fetchall(), key=str) == got
    assert sum(len(t) for _, t in got) < docs.selectExpr("sum(length(text))").first()[0]


def test_odd_documents(spark, odd_docs):
    body = "\n".join(f"line {i} of it" for i in range(40))
    more = [(50, "start\n" + body), (51, body + "\nend"), (51, body + "\nend"), (52, "x\n\n\n\n\nx\n\n\n\n\nx"), (None, body), (3, body + "\n" + body), (60, None)]
    docs = odd_docs.select("doc_id", "text", "n_chars").union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "length(text)"))
    docs = docs.selectExpr("*", "'x' as h", "1 as chunks", "2 as lines", "3 as repeated", "4 as row", "5 as new")
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.h, r.chunks, r["lines"], r.repeated, r.row, r.new) for r in rows} == {("x", 1, 2, 3, 4, 5)}
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(r)
    assert len(texts[51]) == 2 and texts[51][0].text == texts[51][1].text
    assert all(r.n_chars == len(r.text) for r in texts[51] + texts[50])


def test_no_documents(spark, no_docs):
    assert line_dedup.dedup_lines(no_docs).collect() == []
