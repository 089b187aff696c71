"""Token ids in files of fixed-width packed bits, with block offsets for random access.

A file part is one byte string:

    magic "FLB1" | bits u32 | n_docs u64 | n_ids u64 | block_len u32 | n_blocks u32
    doc ids i64 * n_docs | end of each document u64 * n_docs | offset of each block u64 * (n_blocks + 1)
    payload: blocks of block_len ids, each id in ``bits`` bits, little-endian, each block byte-aligned

Parts are rows of a Parquet table in the shared folder, because Spark's committer is what makes
a write survive lost executors on any file system; ``export`` writes the same bytes as a plain file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import map_batches, narrow, real_id, written
from formline.llm.words import WordCodec

_HEAD = struct.Struct("<4sIQQII")
BLOCK_LEN = 4096
#: A part is closed once it holds so many ids; a longer document is a part of its own.
PART_IDS = 1_000_000
#: Texts whose new words are looked up together.
TEXTS = 128


def bits_for(vocab_size: int) -> int:
    """The fewest bits that hold every id below ``vocab_size``."""
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def build(doc_ids: list[int], docs: list[np.ndarray], bits: int, block_len: int = BLOCK_LEN) -> bytes:
    """The bytes of one part."""
    ids = np.concatenate(docs) if docs else np.zeros(0, np.uint32)
    blocks = [pack(ids[i : i + block_len], bits) for i in range(0, len(ids), block_len)]
    ends = np.cumsum([len(d) for d in docs], dtype=np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    head = _HEAD.pack(b"FLB1", bits, len(docs), len(ids), block_len, len(blocks))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class Part:
    """Reads a part: whole, by document, or any range of ids without touching other blocks."""

    def __init__(self, raw: bytes) -> None:
        magic, self.bits, n_docs, self.n_ids, self.block_len, n_blocks = _HEAD.unpack_from(raw)
        if magic != b"FLB1":
            raise ValueError("not a packed part")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        self.ends = np.frombuffer(raw, "<u8", n_docs, at + 8 * n_docs)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at + 16 * n_docs)
        self.payload = memoryview(raw)[at + 16 * n_docs + 8 * (n_blocks + 1) :]
        self.open = -1, np.zeros(0, np.uint32)

    def block(self, b: int) -> np.ndarray:
        """The ids of one block; the last one asked for is kept."""
        if self.open[0] != b:
            n = min(self.block_len, self.n_ids - b * self.block_len)
            self.open = b, unpack(self.payload[int(self.offsets[b]) : int(self.offsets[b + 1])], self.bits, n)
        return self.open[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_len, (stop - 1) // self.block_len
        base = first * self.block_len
        if first == last:
            return self.block(first)[start - base : stop - base]
        return np.concatenate([self.block(b) for b in range(first, last + 1)])[start - base : stop - base]

    def docs(self):
        start = 0
        for doc_id, end in zip(self.doc_ids.tolist(), self.ends.tolist(), strict=True):
            yield doc_id, start, self.ids(start, end)
            start = end


def export(raw: bytes, path: str) -> None:
    """One part as a plain file, for readers outside Spark."""
    with open(path, "wb") as f:
        f.write(raw)


def write_parts(df: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, order by (doc_id, text) and write; returns the table of parts as read back.

    Columns: ``file_no`` (place of the task's range in the order), ``part_no``, ``file_start``
    (ids before the part in its file), ``n_ids``, ``part`` (the bytes).  The one shuffle is the
    range partitioning of the texts.
    """
    spark = df.sparkSession
    with open(tokenizer_path, "rb") as f:  # fixed by the vocabulary
        shared = spark.sparkContext.broadcast(f.read())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")

    def run(batches):
        codec = WordCodec.shared(shared.value)
        bits = bits_for(codec.vocab_size)
        file_no, part_no, file_start = TaskContext.get().partitionId(), 0, 0
        doc_ids, docs, held = [], [], 0

        def close():
            nonlocal doc_ids, docs, held, part_no, file_start
            row = {"file_no": [file_no], "part_no": [part_no], "file_start": [file_start], "n_ids": [held], "part": [build(doc_ids, docs, bits)]}
            part_no, file_start, doc_ids, docs, held = part_no + 1, file_start + held, [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=kinds)

        kinds = pa.schema([("file_no", pa.int32()), ("part_no", pa.int32()), ("file_start", pa.int64()), ("n_ids", pa.int64()), ("part", pa.binary())])
        end = np.array([end_id], codec.kind).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                for doc_id, raw in zip(part.column(0).to_pylist(), codec.raws(part.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, codec.kind)
                    doc_ids.append(doc_id)
                    docs.append(ids)
                    held += len(ids)
                    if held >= PART_IDS:
                        yield close()
        if docs:
            yield close()

    ordered = narrow(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, "file_no int, part_no int, file_start long, n_ids long, part binary"), "bitpack")


def read_parts(parts: DataFrame) -> DataFrame:
    """Per document, from the files alone: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    ``start`` counts the ids of all documents before it: those of earlier files (a running sum
    over one row per file, broadcast: there are as many as tasks wrote), of earlier parts of its
    file, and of its part.
    """
    order = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = parts.groupBy("file_no").agg(F.sum("n_ids").alias("n")).select("file_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    rows = parts.join(F.broadcast(files), "file_no").select((F.col("before") + F.col("file_start")).alias("start"), "part")

    def run(x):
        out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
        for start, raw in zip(x["start"], x["part"], strict=True):
            for doc_id, at, ids in Part(raw).docs():
                out["doc_id"].append(doc_id)
                out["start"].append(start + at)
                out["n_tokens"].append(len(ids))
                out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
        return out

    return map_batches(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long", rows=8).select(real_id(), "start", "n_tokens", "ids_crc32")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the packed files and read them back.  Repeated ids are ordered by their text; null ids come first."""
    return read_parts(write_parts(df, tokenizer_path, end_id, id_col, text_col))
