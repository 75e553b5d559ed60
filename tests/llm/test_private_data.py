import hashlib
import math
import re
from collections import Counter

from tessera.llm import private_data as p
from tessera.llm.common import read

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The patterns as they stand in the contract."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            double = [int(c) if n % 2 == 0 else sum(divmod(2 * int(c), 10)) for n, c in enumerate(d[::-1])] if kind == "card" else []
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and sum(double) % 10 == 0, "phone": 8 <= len(d) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return out


def zero(t):
    return re.sub("[1-9]", "0", t)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(rows, support=p.SUPPORT, bits=p.BITS, residue=p.RESIDUE):
    """Spans of (id, text) rows with counts in dictionaries."""
    near, alone, spread, seen = Counter(), Counter(), Counter(), []
    for _, text in rows:
        text = text or ""
        base = plain(text)
        words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
        free = [w for w in words if not any(a < w[1] and b > w[0] for _, a, b in base)]
        every = {f(lower(text[a:b])) for a, b in words for f in (str, zero)}
        spread.update(every)
        mine, own = set(), set()
        for kind, a, b in base:
            e = kind + ":" + (re.sub("[^0-9]", "", text[a:b]) if kind in ("card", "phone") else text[a:b].lower())
            own.add(e)
            beside = [w for w in free if w[1] <= a][-p.NEAR :] + [w for w in free if w[0] >= b][: p.NEAR]
            mine |= {(e, f(lower(text[x:y]))) for x, y in beside for f in (str, zero)}
        near.update(mine)
        alone.update(own)
        seen.append((text, base, free, own))
    told = {(e, t) for (e, t), n in near.items() if n >= support and math.log2(n / spread[t]) >= -residue and math.log2(n / spread[t]) - math.log2(alone[e] / len(rows)) >= bits}
    out = []
    for text, base, free, own in seen:
        added = {"generalised": [], "removed": []}
        for a, b in free:
            t = lower(text[a:b])
            of = [e for e in own if (e, t) in told]
            if of:
                gone = any(zero(t) == t or (e, zero(t)) in told for e in of)
                added["removed" if gone else "generalised"].append((a, b))
        spans = base + [(k, a, b) for k in p.ADDED for a, b in added[k]]
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
    return out


def check(df, rows, **limits):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in df.collect())
    want = Counter()
    for (i, text), spans in zip(rows, brute(rows, **limits)):
        base = plain(text or "")
        n = Counter(k for k, *_ in base)
        want[i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(p.joined(base).encode()).hexdigest(), spans] += 1
    assert got == want
    return [x[-1] for x in got]


def test_stored_table(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, SF, "documents").collect()]
    check(p.op12_private_data(spark, SF), rows)


def test_patterns():
    odd = "a@b@c.d x..y@h.i. @z.y q@w ü@ä.ö é.x+1@a-b.c..d m@n.o@p.q 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255x 1.2.3 9.9.9.9999 +1 (386) 555-3733 +49..12 +1234567 +12345678+1 2345 6789 (1 4111 1111 1111 1111-1 4111-1111-1111-1111 12 34  56 +1"
    for text in [odd, odd[::-1], odd.replace(" ", ""), "1" * 3000, "a" * 3000 + "@", "1.1" * 900, "+1-" * 900, "@" * 50, "4111 " * 900, "a@b." * 500 + "c"]:
        assert p.find(text) == plain(text)
    for long in ("1" * 400_000, "a" * 400_000, "a.1" * 200_000, "+1" + " " * 400_000, "@a" * 200_000, "1 " * 200_000):
        p.find(long)


def planted():
    common = "the day was long and then it rained on all of us while we walked home to ask in room 5678 or mail"
    rows = [(n, f"{common} {n} times") for n in range(200)]
    for n in range(6):
        rows.append((300 + n, f"ask Zorblax in room 4417 or 93{n}1 mail zed.q@mail.example.com {common}"))
    rows += [(400, f"Zorblax without the address {common}"), (401, "4411 alone 4419 and 5417"), (402, f"in zorblax {common} far from it, zorblax, zed.q@mail.example.com")]
    return rows


def test_disclosing_terms(spark):
    rows = planted()
    schema = "doc_id long, text string"
    check(p.private_spans(spark.createDataFrame(rows, schema).repartition(3).selectExpr("*", "1 as term", "'x' as held", "2 as key_a")), rows)
    spans = brute(rows)
    assert "removed:4:11" in spans[200] and "generalised:20:24" in spans[200] and "removed:28:32" not in spans[200]
    assert not spans[206] and spans[208].count("removed") == 2
    assert p.sanitise(rows[200][1], [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans[200].split(","))]).startswith("ask  in room 0000 or 9301 mail [email] the day")
    assert p.sanitise("ab cd", [("email", 0, 4), ("ip", 3, 5)]) == "[email]"


def test_odd_documents(spark, odd_docs, no_docs):
    extra = [(900, "x" * 30_000 + "@a.b " + "1.2.3.4 Word " * 4000), (None, "write to a@b.cd"), (5, "write to a@b.cd"), (5, "write to a@b.cd"), (6, "")]
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()] + extra
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    check(p.private_spans(docs), rows)
    check(p.private_spans(docs, support=1, bits=1.0), rows, support=1, bits=1.0)
    assert p.private_spans(no_docs).collect() == []


def test_long_list_of_entities():
    text = " ".join(f"user{n}@example.com word{n}" for n in range(3000))
    whole = set().union(*p.near_pairs(text, p.find(text), 7))
    assert whole == set().union(*p.near_pairs(text, p.find(text)))
    assert sum(t is None for _, t in whole) == 3000
