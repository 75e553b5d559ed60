"""Token ids in flat binary files with 64-bit document offsets, written and read by partitions.

A data set is a folder: for each shard NNNNNN the files `.bin` (ids, little-endian unsigned 16 or 32 bits), `.idx` (offsets
of documents within the shard, n+1 little-endian 64-bit integers), `.doc` (document ids, 64-bit) and `.nul` (a byte each, 1
where the document id is null). Global positions are a shard's base, from prefix sums over the shards, plus an offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, read, text_slices
from .encoding import cut_of, encoder

SHARD = "shard long, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
ROWS = 4096


def _files(folder: str):
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    return system, root, isinstance(system, fs.LocalFileSystem)


def _write(folder: str, path: str, cut: str, end_id: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root, _ = _files(folder)
        name = f"{root}/{task.partitionId():06d}"
        mine = f"{name}-{task.taskAttemptId()}"
        end, lengths, docs = end_id.to_bytes(4, "little"), [], []
        with system.open_output_stream(f"{mine}.bin") as out:
            for batch, texts in text_slices(batches):
                docs += batch.column("doc_id").to_pylist()
                for ids in encoder(path, cut).encode(texts):
                    ids += end
                    lengths.append(len(ids) // 4)
                    out.write(ids if dtype == "<u4" else np.frombuffer(ids, "<u4").astype(dtype).tobytes())
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, dtype="<i8"))]).astype("<i8")
        for kind, data in (("idx", offsets), ("doc", np.array([x or 0 for x in docs], dtype="<i8")), ("nul", np.array([x is None for x in docs], dtype="u1"))):
            with system.open_output_stream(f"{mine}.{kind}") as out:
                out.write(data.tobytes())
        for kind in ("bin", "doc", "nul", "idx"):  # whole files take their place at once; a repeated task writes the same
            system.move(f"{mine}.{kind}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "n_docs": [len(docs)], "n_tokens": [int(offsets[-1])]})

    return run


def _load(system, path: str, local: bool, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a file system, else read."""
    if not system.get_file_info(path).size:
        return np.zeros(0, dtype)
    if local:
        return np.memmap(path, dtype=dtype, mode="r")
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _read_shards(folder: str, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root, local = _files(folder)
        for shard, base in (x for b in batches for x in zip(b.column("shard").to_pylist(), b.column("base").to_pylist())):
            ids, offsets, docs, nul = (_load(system, f"{root}/{shard:06d}.{kind}", local, t) for kind, t in (("bin", dtype), ("idx", "<i8"), ("doc", "<i8"), ("nul", "u1")))
            for i in range(0, len(docs), ROWS):
                at = range(i, min(i + ROWS, len(docs)))
                crc = [zlib.crc32(ids[offsets[j] : offsets[j + 1]].astype("<u4").tobytes()) for j in at]
                cut = slice(at.start, at.stop)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[cut], mask=nul[cut] == 1), pa.array(offsets[cut] + base), pa.array(np.diff(offsets[at.start : at.stop + 1])), pa.array(crc, pa.int64())], schema=_READ
                )

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> DataFrame:
    """Encode every document and write the files; returns a row for each shard with its base (shard, n_docs, n_tokens, base).

    Documents are in ascending doc_id order over all shards, null ids first; rows of one id are ordered by their text, so
    the files do not depend on the order of the input. Null text: the end id alone. Each id takes 16 bits where the
    vocabulary allows it. Nothing but a row for each shard comes to the driver. No documents: shards without documents.
    """
    from pyarrow import fs
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    dtype = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = sorted(ordered.mapInArrow(_write(folder, tokenizer, cut_of(tokenizer), end_id, dtype), SHARD).collect())
    totals = np.cumsum([0, *(x.n_tokens for x in shards)])
    with system.open_output_stream(f"{root}/manifest") as out:
        out.write("\n".join([dtype, *(f"{x.shard} {x.n_docs} {x.n_tokens} {b}" for x, b in zip(shards, totals))]).encode())
    return spark.createDataFrame([(*x, int(b)) for x, b in zip(shards, totals)], f"{SHARD}, base long")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of a folder that write_tokens() filled: doc_id, start, n_tokens, ids_crc32."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    with system.open_input_file(f"{root}/manifest") as f:
        dtype, *lines = f.read().decode().split("\n")
    shards = [(int(s), int(b)) for s, _, _, b in map(str.split, lines)]
    return spark.createDataFrame(shards, "shard long, base long").repartition(max(1, len(shards)), "shard").mapInArrow(_read_shards(folder, dtype), READ)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_tokens(spark, folder)
