"""Personal data: patterns, and terms that reveal whom they stand for.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the protected entities. An entity taken out of a text
can still be read from the words around it, if these stand nowhere else. So the corpus tells, for each term near an entity,
how many bits it reveals: pmi(e; t) = log2 p(e | t) - log2 p(e), where p(e | t) is the share of the documents with t in which t
stands near e. A term that reveals at least BITS of them, and leaves at most RESIDUE bits of the entity's own information
-log2 p(e), is disclosing: it goes from every document that holds the entity. A term with digits is generalised first
(each digit to 0) and only removed if that form discloses the entity too.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Spans that the method adds.
ADDED = ("generalised", "removed")
#: Words on each side of an entity that count as near.
NEAR = 8
#: Documents in which a term must stand near an entity; bits it must reveal; bits it may leave.
SUPPORT, BITS, RESIDUE = 3, 4.0, 1.0

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_TO_LOWER, _TO_ZERO = str.maketrans(_UPPER, _LOWER), str.maketrans("123456789", "0" * 9)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A failing start must not scan a long run again and again: starts and repetitions are such that each run is read once.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the local characters before it, back to the last match's end, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(done, at + 1))


def luhn(digits: str) -> bool:
    odd, even = (list(map(int, digits[::-1][k::2])) for k in (0, 1))
    return (sum(odd) + sum(2 * d - 9 * (d > 4) for d in even)) % 10 == 0


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all matches in code points, by kind in the order of KINDS, then start."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append(("phone", *m.span()))
    return out


def entity(kind: str, value: str) -> str:
    """One name for an entity's spellings."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _NOT_DIGIT.sub('', value)}"


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def words_beside(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Words that touch no match."""
    cover, out, k = sorted((a, b) for _, a, b in base), [], 0
    for m in _WORD.finditer(text):
        a, b = m.span()
        while k < len(cover) and cover[k][1] <= a:
            k += 1
        if k == len(cover) or cover[k][0] >= b:
            out.append((a, b))
    return out


def near_pairs(text: str, base: list[tuple[str, int, int]], at_once: int = 2000) -> Iterator[set[tuple[str, str | None]]]:
    """(entity, term) for the NEAR words before and after each match, and (entity, None) for each entity; so many matches at
    once. A word with digits is two terms: itself, and with zeros for digits."""
    words = words_beside(text, base)
    starts = [a for a, _ in words]
    for n in range(0, len(base), at_once):
        out: set[tuple[str, str | None]] = set()
        for kind, a, b in base[n : n + at_once]:
            e = entity(kind, text[a:b])
            out.add((e, None))
            before, after = bisect_left(starts, a), bisect_left(starts, b)
            for x, y in words[max(0, before - NEAR) : before] + words[after : after + NEAR]:
                t = text[x:y].translate(_TO_LOWER)
                out.update(((e, t), (e, t.translate(_TO_ZERO))))
        yield out


def mark(text: str, base: list[tuple[str, int, int]], terms: dict[str, str]) -> list[tuple[str, int, int]]:
    """All spans: the matches, and the words that are terms, each with its own kind."""
    if not terms:
        return base
    found = [(kind, a, b) for a, b in words_beside(text, base) if (kind := terms.get(text[a:b].translate(_TO_LOWER)))]
    return base + [x for k in ADDED for x in found if x[0] == k]


def sanitise(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with [kind] for matches, zeros for digits of generalised terms, and without removed ones. Of matches that
    overlap, what is left of the later one is cut away."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], {"generalised": text[a:b].translate(_TO_ZERO), "removed": ""}.get(kind, f"[{kind}]")]
        at = max(at, b)
    return "".join([*out, text[at:]])


# --- the corpus --------------------------------------------------------------------------------------------------------

_KEY = ["key_a", "key_b"]
_COUNTS = [f"n_{k}" for k in KINDS]
_FOUND = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_sha256 string, base string, key_a long, key_b long, held string"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches):
        base = [find(t) for t in texts]
        spans = [joined(b) for b in base]
        counts = {c: pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for c, k in zip(_COUNTS, KINDS)}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **counts, "base_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in spans], "base": spans, **{k: batch.column(k) for k in _KEY}, "held": pa.array([t if b else None for t, b in zip(texts, base)], pa.string())})


def found(docs: DataFrame) -> DataFrame:
    """Matches of every document; `held` has the text of those with any. The key names a row's id and text by 128 bits."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("*", F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64(F.lit("b"), "text", "doc_id").alias("key_b")).mapInArrow(_find, _FOUND)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches, "held"):
        for i, text in enumerate(texts):
            row = [batch.column(k)[i].as_py() for k in _KEY]
            for pairs in near_pairs(text, find(text)):
                names = [list(x) for x in zip(*pairs)]
                yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(pairs), pa.int64()) for k in row), *(pa.array(x, pa.string()) for x in names)], names=[*_KEY, "entity", "term"])


def terms_of(text: Column) -> Column:
    """Distinct terms of a text: its words, A-Z in lower case, and those with digits also with zeros for digits."""
    words = F.array_distinct(F.split(F.translate(text, _UPPER, _LOWER), _APART))
    zeros = F.transform(F.filter(words, lambda w: w.rlike("[1-9]")), lambda w: F.translate(w, "123456789", "0" * 9))
    return F.array_remove(F.array_union(words, zeros), "")


def disclosing(docs: DataFrame, near: DataFrame, documents: int, support: int = SUPPORT, bits: float = BITS, residue: float = RESIDUE) -> DataFrame:
    """(term, entity, kind) of the terms that disclose an entity, with their bits.

    Counts are of documents: with the entity, with the term near it, and with the term anywhere, over the whole corpus.
    """
    counts = near.groupBy("entity", "term").agg(F.count("*").alias("n"))
    alone = counts.where("term is null").select("entity", F.col("n").alias("n_entity"))
    pairs = counts.where((F.col("n") >= support) & F.col("term").isNotNull())
    spread = docs.select(F.explode(terms_of(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    known = pairs.join(alone, "entity").join(spread, "term")
    share = F.least(F.col("n") / F.col("n_term"), F.lit(1.0))
    reveals = F.log2(share) - F.log2(F.col("n_entity") / F.lit(float(max(1, documents))))
    told = known.withColumn("bits", reveals).where((F.col("bits") >= bits) & (F.log2(share) >= -residue)).select("entity", "term", "bits")
    wide = told.select("entity", F.col("term").alias("zeros"), F.lit(True).alias("wide"))
    told = told.withColumn("zeros", F.translate("term", "123456789", "0" * 9)).join(wide, ["entity", "zeros"], "left")
    kind = F.when(F.col("term") == F.col("zeros"), "removed").when(F.col("wide"), "removed").otherwise("generalised")
    return told.select("term", "entity", kind.alias("kind"), "bits")


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches, "held"):
        spans = []
        for text, terms in zip(texts, batch.column("terms").to_pylist()):
            spans.append(joined(mark(text, find(text), {x["term"]: x["kind"] for x in terms or ()})))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(spans, pa.string())], names=[*batch.schema.names[:-2], "spans"])


def private_spans(docs: DataFrame, support: int = SUPPORT, bits: float = BITS, residue: float = RESIDUE) -> DataFrame:
    """doc_id, counts of matches, base_sha256 and spans of every document; see `find` and the head of this module.

    Null text: empty. Null ids and repeated rows stay, rows of one id and text alike. Every row counts as a document. No
    documents: no rows. Other columns are not read. Texts are sent on only if they have matches.
    """
    rows = materialize(found(docs), "private-found")
    held = rows.where("held is not null")
    near = materialize(held.select(*_KEY, "held").mapInArrow(_near, "key_a long, key_b long, entity string, term string").distinct(), "private-near")
    told = disclosing(docs, near, rows.count(), support, bits, residue)
    asked = held.select(*_KEY, F.explode(terms_of(F.col("held"))).alias("term")).join(told, "term").distinct()
    owned = near.where("term is null").select(*_KEY, "entity").distinct()
    # A term goes wherever one of the document's own entities asks for it; removed wins over generalised.
    per_term = asked.join(owned, [*_KEY, "entity"], "left_semi").groupBy(*_KEY, "term").agg(F.max("kind").alias("kind"))
    terms = per_term.groupBy(*_KEY).agg(F.collect_list(F.struct("term", "kind")).alias("terms"))
    out = ["doc_id", *_COUNTS, "base_sha256"]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_sha256 string, spans string"
    marked = held.join(terms, _KEY, "left").select(*out, "held", "terms").mapInArrow(_mark, schema)
    return rows.where("held is null").select(*out, F.col("base").alias("spans")).unionByName(marked)


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents."""
    return private_spans(read(spark, sf_dir, "documents"))
