"""Bounded-space online packing of token sequences into fixed windows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read, text_slices
from .encoding import cut_of, encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECES}, sequence_id long, offset long, open boolean"

#: Partitions whose leftovers one task merges.
FAN_IN = 32


class OpenWindows:
    """A fixed number of open windows: a piece goes where the least room stays; if it fits nowhere, the fullest is emitted."""

    def __init__(self, size: int, windows: int, first_id: int):
        self.size, self.windows, self.next_id = size, windows, first_id
        self.room: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list] = {}

    def add(self, piece: tuple) -> list[tuple]:
        """piece: a row of PIECES. Returns the placed rows of a window emitted to make room, if any."""
        out, length = [], piece[2]
        at = bisect_left(self.room, (length, -1))
        if at < len(self.room):
            room, window = self.room.pop(at)
        else:
            if len(self.room) >= self.windows:
                out = self._close(self.room.pop(0)[1], False)
            room, window = self.size, self.next_id
            self.next_id += 1
            self.held[window] = []
        self.held[window].append((piece, self.size - room))
        if room == length:
            out += self._close(window, False)
        else:
            insort(self.room, (room - length, window))
        return out

    def _close(self, window: int, is_open: bool) -> list[tuple]:
        return [(*piece, window, offset, is_open) for piece, offset in self.held.pop(window)]

    def rest(self, final: bool) -> list[tuple]:
        return [row for _, window in self.room for row in self._close(window, not final)]


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SCHEMA = pa.schema([(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("open", pa.bool_())])


def _first_id(level: int) -> int:
    from pyspark import TaskContext

    return (level << 56) | (TaskContext.get().partitionId() << 28)


def _pack_texts(path: str, cut: str, end_id: int, size: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, end, rows = OpenWindows(size, windows, _first_id(0)), end_id.to_bytes(4, "little"), []
        for batch, texts in text_slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path, cut).encode(texts)):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows += held.add((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            if len(rows) > 5000:
                yield _batch(rows, _SCHEMA)
                rows = []
        rows += held.rest(False)
        if rows:
            yield _batch(rows, _SCHEMA)

    return run


def _merge(level: int, size: int, windows: int, final: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(*(b.column(f.strip().split()[0]).to_pylist() for f in PIECES.split(",")))]
        if not rows:
            return
        rows.sort(key=lambda x: (-x[2], x[0] is None, x[0] or 0, x[1], x[3]))
        held, out = OpenWindows(size, len(rows) if final else windows, _first_id(level)), []
        for x in rows:
            out += held.add(x)
        out += held.rest(final)
        yield _batch(out, _SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, windows: int = 64, end_id: int = 2) -> DataFrame:
    """Token pieces of every document, placed in sequences of at most `size` ids.

    Each partition keeps `windows` open windows while it reads its documents once. A document longer than `size` is cut
    at multiples of it; a full piece is a sequence of its own. What is still open at the end (at most `windows` for each
    partition) is merged, longest first, FAN_IN partitions to a task and round by round, until one task holds the last.

    Null text: an empty document, which is its end id alone. Null or repeated doc_id: each row is a document of its own.
    Other columns are not read. No documents: no rows. Columns: those of PIECES, sequence_id, offset.
    """
    parts = max(1, docs.rdd.getNumPartitions())
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = materialize(source.mapInArrow(_pack_texts(tokenizer, cut_of(tokenizer), end_id, size, windows), PLACED), "packed")
    done, left, level = placed.where(~F.col("open")), placed.where("open"), 1
    group = F.shiftright(F.col("sequence_id"), 28).bitwiseAND(F.lit((1 << 28) - 1))
    while True:
        parts = -(-parts // FAN_IN)
        final = parts == 1
        dealt = left.repartition(1) if final else left.withColumn("task", F.floor(group / FAN_IN)).repartitionByRange(parts, "task")
        merged = dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").mapInArrow(_merge(level, size, windows, final), PLACED)
        if final:
            return done.unionByName(merged).drop("open")
        merged = materialize(merged, "packed")
        done, left, level = done.unionByName(merged.where(~F.col("open"))), merged.where("open"), level + 1


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
