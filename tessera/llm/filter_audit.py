"""How document filters interact: what each removes in every order, from contingency tensors of their failures.

Each document fails some of five conditions. Per part of the corpus the counts of documents by failed conditions are a
2x2x2x2x2 tensor (one axis for each filter: pass, fail), for all documents, for good and for toxic ones. Contracting every
axis with one of the vectors pass, fail and all answers all questions of all orders: what a step keeps is pass along the
axes so far and all along the others; what it removes is fail along its own axis, pass along the earlier ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

FILTERS = "ABCDE"
#: Failure conditions: fewer words; fewer distinct words of a hundred; more capitals in a hundred characters; symbols; copies.
WORDS, DISTINCT, CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
PASS, FAIL, ALL = range(3)
#: Columns pass, fail, all of one axis.
SELECT = np.array([[1, 0, 1], [0, 1, 1]], np.int64)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * F.length(text), text.rlike(SYMBOLS)]


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, cell (bit f set: filter f fails), and its documents: n, good, toxic.

    A copy is found without joining documents: rows are counted by text digest (SHA-256), part, label and id, then by all
    but the id with the least id's own rows beside; of a digest only the rows with its least id are not copies. So a text
    that a third of all documents share is a few rows before anything meets by digest. Null ids are never copies and make
    none of others.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    bits = sum((F.when(x, 1 << f).otherwise(0) for f, x in enumerate(text_failures(F.col("text")))), F.lit(0))
    facts = facts.select("id", "part", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), bits.alias("bits"))
    has = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(f"is_{c}")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(has("quality"), has("toxic"))
    group = ["part", "digest", "bits", "is_quality", "is_toxic"]
    by_id = facts.join(marks, "id", "left").fillna(0, ["is_quality", "is_toxic"]).groupBy("id", *group).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    found = by_id.groupBy(*group).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("no_id"), first.alias("first"))
    least = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.col("no_id") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    found = found.withColumn("own", own)
    split = found.select(*group, F.inline(F.array(F.struct(F.lit(0).alias("copy"), F.col("own").alias("m")), F.struct(F.lit(16).alias("copy"), (F.col("n") - F.col("own")).alias("m")))))
    return split.groupBy("part", (F.col("bits") + F.col("copy")).alias("cell")).agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("is_quality")).alias("good"), F.sum(F.col("m") * F.col("is_toxic")).alias("toxic"))


def contracted(tensor: np.ndarray) -> np.ndarray:
    """All contractions of a tensor (measure, 2, 2, 2, 2, 2): entry [m, a, b, c, d, e] has pass, fail or all on each axis."""
    return np.einsum("mabcde,ai,bj,ck,dl,ez->mijklz", tensor, *[SELECT] * 5)


def _at(fail: str, keep: str = "") -> tuple[int, ...]:
    return tuple(FAIL if f in fail else PASS if f in keep else ALL for f in FILTERS)


def audit_part(tensor: np.ndarray) -> list[tuple]:
    """(order, step, the COUNTS) for all orders of the filters; measures of the tensor: documents, good ones, toxic ones."""
    t = contracted(tensor)
    removed = {(f, before): t[(slice(None), *_at(f, before))] for f in FILTERS for k in range(5) for before in map("".join, permutations([x for x in FILTERS if x != f], k))}
    total = {f: 0 for f in FILTERS}
    orders = ["".join(p) for p in permutations(FILTERS)]
    for order in orders:
        for s, f in enumerate(order):
            total[f] += int(removed[f, order[:s]][0])
    out = []
    for order in orders:
        for s, f in enumerate(order):
            gone = removed[f, order[:s]]
            kept, fails = t[(0, *_at("", order[: s + 1]))], t[(0, *_at(f))]
            unique = t[(0, *_at(f, "".join(x for x in FILTERS if x != f)))]
            out.append((order, s + 1, *map(int, (kept, gone[0], fails - gone[0], unique, gone[1], gone[2])), total[f]))
    return out


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
    for batch in batches:
        for row in batch.to_pylist():
            tensor = np.zeros((3, 32), np.int64)
            for c in row["cells"]:
                tensor[:, c["cell"]] = c["n"], c["good"], c["toxic"]
            # Bit f of a cell is the axis of filter f; numpy's first axis is the highest bit.
            found = audit_part(tensor.reshape(3, *[2] * 5).transpose(0, 5, 4, 3, 2, 1))
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([[row["part"]] * len(found), *columns], types)], names=names)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source), order of the five filters and step: the columns of RESULT.

    Null text: empty. Null source: the empty string. A document counts as good or toxic if any label of its id says so;
    null labels say nothing. Repeated rows count each; rows that share id and text are no copies of one another. No
    documents: no rows. Other columns are not read. A part is at most 32 counted cells, so a task holds a few hundred rows
    at a time however many documents a part has.
    """
    parts = cells(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(_audit, RESULT)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents by source."""
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL = """
with docs as (select doc_id, coalesce(text, '') t, coalesce(source, '') part from documents),
marks as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels where doc_id is not null group by doc_id),
split as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from docs),
fails as (select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
  (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > min(doc_id) over (partition by t), false)::int as code
  from split left join marks using (doc_id)),
cube as (select part, code, count(*) n, sum(good) good, sum(toxic) toxic from fails group by part, code),
letters as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) l(f, bit)),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] bits from letters a, letters b, letters c, letters d, letters e
  where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, s::int as step, bits[s] as own, coalesce(list_sum(bits[:s - 1]), 0)::int as prior from orders, range(1, 6) r(s)),
counted as (select part, filter_order, step, own,
  coalesce(sum(n) filter (where code & (prior | own) = 0), 0)::bigint kept,
  coalesce(sum(n) filter (where code & own <> 0 and code & prior = 0), 0)::bigint removed,
  coalesce(sum(n) filter (where code & own <> 0 and code & prior <> 0), 0)::bigint redundant,
  coalesce(sum(n) filter (where code = own), 0)::bigint unique_fails,
  coalesce(sum(good) filter (where code & own <> 0 and code & prior = 0), 0)::bigint good_lost,
  coalesce(sum(toxic) filter (where code & own <> 0 and code & prior = 0), 0)::bigint toxic_lost
  from cube, steps group by part, filter_order, step, own)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from counted
"""
