"""Removal of repeated multi-line chunks; chunk borders follow the lines themselves, so shifted text is cut alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: A chunk ends after a line at which the rolling hash of the last WINDOW line hashes is 0 modulo MEAN, but not right after
#: another end (of such lines in a row every second one counts), so chunks have two lines at least.
MEAN, WINDOW, BASE, PRIME = 2, 2, 31, 1_000_003
#: Lines with a word that a chunk needs before it counts as multi-line.
LEAST = 2


def _hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _own(x: Column, name: str) -> Column:
    """x as a column that is computed once, however often it is read."""
    return F.explode(F.array(x)).alias(name)


def chunks_of(docs: DataFrame, *keep: str) -> DataFrame:
    """docs with `lines` and `chunks`, an array of (start from 1, number of lines), by column text."""
    with_lines = docs.select(*keep, _own(F.split(F.coalesce("text", F.lit("")), "\n", -1), "lines"))
    hashed = with_lines.select(*keep, "lines", _own(F.transform("lines", _hash), "hashes"))
    at = lambda i: F.when(i >= 1, F.element_at("hashes", F.greatest(i, F.lit(1)).cast("int"))).otherwise(0)

    def may_end(i: Column) -> Column:
        rolling = F.lit(0).cast("long")
        for back in range(WINDOW - 1, -1, -1):
            rolling = (rolling * BASE + at(i - back)) % PRIME
        return F.when(rolling % MEAN == 0, "1").otherwise("0")

    n = F.size("lines")
    flags = F.concat(F.lit("1"), F.array_join(F.transform(F.sequence(F.lit(1), n), may_end), ""))  # the first is the text's begin
    kept = hashed.select(*keep, "lines", _own(F.split(F.regexp_replace(flags, "11", "10"), ""), "flags"))
    ends = lambda i: (i == n) | ((i < n - 1) & (F.element_at("flags", i + 1) == "1"))
    cut = kept.select(*keep, "lines", _own(F.filter(F.sequence(F.lit(1), n), ends), "ends"))
    previous = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))))
    spans = F.transform("ends", lambda end, k: F.struct((previous(k) + 1).alias("start"), (end - previous(k)).alias("n")))
    return cut.select(*keep, "lines", _own(spans, "chunks"))


def repeats(docs: DataFrame) -> DataFrame:
    """Chunks to be removed: doc_id, h (md5 of the text), at (its number in the document), body (its lines), as arrays by document."""
    chunk = (
        chunks_of(docs.select(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("h"), "text"), "doc_id", "h")
        .select("doc_id", "h", "lines", F.posexplode("chunks").alias("at", "span"))
        .where(F.col("span.n") >= LEAST)
        .select("doc_id", "h", "at", F.slice("lines", F.col("span.start"), F.col("span.n")).alias("body"))
        .where(F.size(F.filter("body", lambda line: F.trim(line) != "")) >= LEAST)
        .select("doc_id", "h", "at", F.array_join("body", "\n").alias("body"))
    )
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "at")
    first = chunk.groupBy("body").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select(F.md5("body").alias("key"), "body", "first")
    found = chunk.select("doc_id", "h", "at", F.md5("body").alias("key")).join(first, "key").where(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "at") > F.col("first"))
    return found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("at", "body")).alias("repeated"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, where each multi-line chunk that stood earlier in the table is taken out of `text`.

    Lines are what `\\n` parts. A chunk of at least LEAST lines with a word that occurs more than once stays only at its
    first place, by doc_id (null last), md5 of the text and position. Chunks are grouped by their whole text, and each
    removal compares the bytes again. All other lines stay in order; texts that lose nothing stay as they are, null too.
    Repeated rows (same doc_id and text) are one document: they keep or lose the same chunks. A column n_chars becomes the
    new text's length where the text has changed. Other columns stay as they are; a document may become empty.
    """
    names = docs.columns
    own = {c: f"c{i}" for i, c in enumerate(names)}  # names of our own, so that none clashes
    marked = docs.toDF(*own.values()).withColumn("h", F.md5(F.coalesce(own["text"], F.lit(""))))
    gone = repeats(docs.select("doc_id", "text")).select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h"), "repeated")
    both = marked.join(gone, (F.col("h") == F.col("gone_h")) & F.col(own["doc_id"]).eqNullSafe(F.col("gone_id")), "left").select(*own.values(), "repeated")
    same, changed = both.where("repeated is null").drop("repeated"), both.where("repeated is not null")
    span = lambda at: F.element_at("chunks", at + 1)
    lines = lambda at: F.slice("lines", span(at)["start"], span(at)["n"])
    keep = [x for x in own.values() if x != own["text"]]
    out = F.transform(F.filter("repeated", lambda r: F.array_join(lines(r["at"]), "\n") == r["body"]), lambda r: r["at"])
    cut = chunks_of(changed.withColumnRenamed(own["text"], "text"), *keep, "repeated").select(*keep, "lines", "chunks", _own(out, "out"))
    text = F.array_join(F.flatten(F.transform(F.array_except(F.sequence(F.lit(0), F.size("chunks") - 1), "out"), lines)), "\n")
    kept = cut.select(*keep, _own(text, own["text"]))
    if "n_chars" in names:
        kept = kept.withColumn(own["n_chars"], F.length(own["text"]).cast(docs.schema["n_chars"].dataType))
    return same.unionByName(kept).toDF(*names)


_SQL = f"""
with docs as (select distinct doc_id, text, md5(coalesce(text, '')) h from documents),
lines as (select doc_id, h, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) i from docs),
hashed as (select *, ('0x' || substr(md5(line), 1, 7))::bigint x, count(*) over (partition by doc_id, h) n from lines),
rolled as (select *, (coalesce(lag(x) over (partition by doc_id, h order by i), 0) * {BASE} + x) % {PRIME} r from hashed),
flagged as (select doc_id, h, regexp_replace('1' || string_agg(case when r % {MEAN} = 0 then '1' else '0' end, '' order by i), '11', '10', 'g') flags from rolled group by all),
ended as (select r.*, i < n - 1 and flags[i + 1] = '1' ends from rolled r join flagged f on r.doc_id is not distinct from f.doc_id and r.h = f.h),
numbered as (select *, coalesce(sum(case when ends then 1 else 0 end) over (partition by doc_id, h order by i rows between unbounded preceding and 1 preceding), 0) k from ended),
chunks as (select doc_id, h, k, string_agg(line, chr(10) order by i) body, count(*) filter (trim(line, ' ') <> '') lines_with from numbered group by all),
ranked as (select *, dense_rank() over (partition by body order by doc_id is null, doc_id, h, k) place from chunks),
kept as (select doc_id, h, string_agg(body, chr(10) order by k) body from ranked where not (lines_with >= {LEAST} and place > 1) group by all)
"""
SQL = _SQL + "select d.doc_id, coalesce(k.body, case when d.text is null then null else '' end) as text from documents d left join kept k on d.doc_id is not distinct from k.doc_id and md5(coalesce(d.text, '')) = k.h"


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text")
