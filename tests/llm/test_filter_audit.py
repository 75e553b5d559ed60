import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np

from tessera.llm import filter_audit
from tessera.llm.common import read

SF = "/root/testdata/sf0.001"


def brute(docs, labels):
    """Apply each order to the documents one by one."""
    least, marks, failed = {}, {}, []
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    for d, q, x in labels:
        good, toxic = marks.get(d, (0, 0))
        marks[d] = (good or int(q == 1), toxic or int(x == 1))
    for d, t, s in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and t in least and d > least[t]}
        failed.append((s or "", {f for f in bad if bad[f]}, *marks.get(d, (0, 0))))
    out, shapley = {}, Counter()
    for part in {f[0] for f in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in failed if f[0] == part]
            whole = left
            for s, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = [x for x in whole if f in x[1]]
                shapley[part, f] += len(gone)
                out[part, order, s + 1] = [len(left), len(gone), len(fails) - len(gone), sum(x[1] == {f} for x in fails), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in df.collect()}


def test_stored_table(spark):
    docs = [(r.doc_id, r.text, r.source) for r in read(spark, SF, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in read(spark, SF, "labels").collect()]
    assert got(filter_audit.op11_filter_audit(spark, SF)) == brute(docs, labels)


def test_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rows = c.sql(filter_audit.SQL)
    assert rows.columns == [x.split()[0] for x in filter_audit.RESULT.split(", ")]
    assert {r[:3]: r[3:] for r in rows.fetchall()} == got(filter_audit.op11_filter_audit(spark, SF))


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()] + [(7, "a", "s"), (7, "a", "s"), (4, "a", None), (None, "a", "s"), (90, "", "t")] + [(100 + n, "the same " * 60, "uv"[n % 2]) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as part", "2 as n", "3 as id", "4 as bits", "'x' as digest")
    marks = [(4, 1, 0), (4, 0, 1), (7, None, 1), (None, 1, 1), (100, 1, 0), (90, 0, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", filter_audit.F.lit("x"))
    assert got(filter_audit.audit(docs, labels)) == brute(rows, [m for m in marks if m[0] is not None])
    assert filter_audit.audit(no_docs, labels).collect() == []
    assert got(filter_audit.audit(docs, labels.limit(0))) == brute(rows, [])


def test_contractions():
    t = np.arange(96).reshape(3, 2, 2, 2, 2, 2)
    c = filter_audit.contracted(t)
    assert (c[:, 2, 2, 2, 2, 2] == t.sum((1, 2, 3, 4, 5))).all()
    assert (c[:, 1, 0, 2, 2, 1] == t[:, 1, 0, :, :, 1].sum((1, 2))).all()
