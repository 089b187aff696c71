"""Document fingerprints: a Merkle tree over chunks, paragraphs and sections.

Paragraphs are lines; sections are runs of paragraphs, closed after a paragraph whose own hash
says so, so that an edit moves no later boundary; below paragraphs, chunks of some words are cut
at white space by the bytes before it.  Chunks joined give the text back, and every boundary is a
function of the text, so roots are equal exactly when texts are.  Two trees are compared from the
root down: a branch whose hash the other tree has is shared, only differing branches are opened.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import map_batches, narrow, real_id, written


#: Within so many first bytes every space ends a chunk, so that short texts have several.
HEAD = 64
#: Longer chunks (one word again and again) are cut at this many bytes.
MAX_CHUNK = 256


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Tree:
    """levels: sections, paragraphs, chunks; each a list of (hash, start, end, first child, last child) in bytes."""

    def __init__(self, text: str) -> None:
        raw = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, np.uint8)
        cut = (b == 10).nonzero()[0] + 1
        if len(b) > 4:
            code = (b[:-4].astype(np.uint32) << 24) + (b[1:-3].astype(np.uint32) << 16) + (b[2:-2].astype(np.uint32) << 8) + b[3:-1]
            at = ((b[4:] == 32) & ((code * np.uint32(2654435761)) >> np.uint32(29) == 0)).nonzero()[0] + 5
            cut = np.union1d(cut, at)
        cut = np.union1d(cut, (b[:HEAD] == 32).nonzero()[0] + 1)
        edges = [0]
        for z in [*cut.tolist(), len(raw)]:
            edges += range(edges[-1] + MAX_CHUNK, z, MAX_CHUNK)
            if z > edges[-1]:
                edges.append(z)
        self.chunks = [(_hash(raw[a:z]), a, z, 0, 0) for a, z in zip(edges, edges[1:], strict=False)]
        self.paragraphs, self.sections = [], []
        first = 0
        for i, (_, _, z, _, _) in enumerate(self.chunks):
            if raw[z - 1] == 10 or i == len(self.chunks) - 1:
                self.paragraphs.append((_hash(b"P" + b"".join(c[0] for c in self.chunks[first : i + 1])), self.chunks[first][1], z, first, i + 1))
                first = i + 1
        first = 0
        for i, p in enumerate(self.paragraphs):
            if p[0][0] < 64 or i == len(self.paragraphs) - 1:
                self.sections.append((_hash(b"S" + b"".join(c[0] for c in self.paragraphs[first : i + 1])), self.paragraphs[first][1], p[2], first, i + 1))
                first = i + 1
        self.root = _hash(b"R" + b"".join(s[0] for s in self.sections)).hex()
        self.size = len(raw)

    def children(self, level: int, node: tuple) -> list[tuple]:
        return (self.paragraphs, self.chunks)[level][node[3] : node[4]] if level < 2 else []


def compare(a: Tree, b: Tree) -> tuple[float, int, int]:
    """(likeness 0..1, start and end in bytes of the part of ``a`` that ``b`` lacks; -1, -1 where nothing is lacking).

    Likeness is twice the bytes under shared branches over the bytes of both.
    """
    if a.root == b.root:
        return 1.0, -1, -1
    mine, other, shared, lacking = a.sections, b.sections, 0, []
    for level in range(3):
        left = Counter(n[0] for n in other)
        rest = []
        for n in mine:
            if left[n[0]] > 0:
                left[n[0]] -= 1
                shared += n[2] - n[1]
            else:
                rest.append(n)
        rest_b = []
        for n in reversed(other):
            if left[n[0]] > 0:
                left[n[0]] -= 1
                rest_b.append(n)
        if level == 2:
            lacking = rest
        mine = [c for n in rest for c in a.children(level, n)]
        other = [c for n in rest_b for c in b.children(level, n)]
    start, end = (min(n[1] for n in lacking), max(n[2] for n in lacking)) if lacking else (-1, -1)
    return 2.0 * shared / (a.size + b.size), start, end


def edited(text: str, other: str) -> str:
    """``text`` with its last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def digest(text: str, tree: Tree, following: str, following_tree: Tree) -> dict[str, object]:
    new = edited(text, following)
    new_tree = Tree(new)
    near, start, end = compare(tree, new_tree)
    raw = text.encode("utf-8", "surrogatepass")
    chars = lambda at: -1 if at < 0 else len(raw[:at].decode("utf-8", "ignore"))
    return {
        "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": tree.root,
        "edited_fingerprint": new_tree.root, "near_edited": near, "near_next": compare(tree, following_tree)[0],
        "n_sections": len(tree.sections), "n_paragraphs": len(tree.paragraphs), "edit_start": chars(start), "edit_end": chars(end),
    }


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections long, n_paragraphs long, edit_start long, edit_end long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def trees(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` and ``nodes``, the tree as (level, hash, start, end) in bytes."""

    def run(x):
        made = [Tree(t) for t in x["text"]]
        nodes = [[{"level": k, "hash": n[0].hex(), "start": n[1], "end": n[2]} for k, level in enumerate((t.sections, t.paragraphs, t.chunks)) for n in level] for t in made]
        return {"doc_id": x["doc_id"], "fingerprint": [t.root for t in made], "nodes": nodes}

    return map_batches(
        narrow(df, id_col, text_col), run, "doc_id long, fingerprint string, nodes array<struct<level:int,hash:string,start:long,end:long>>"
    ).select(real_id(), "fingerprint", "nodes")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's fingerprint, that of its edited text, and how like they and its neighbour's are.

    The edit takes text from the next row in descending order of (id, text), null ids last; after the
    last comes the first.  Texts are range partitioned once; within a range a task walks in order,
    and only the first and last row of each range meet their neighbours by a join on range numbers.
    A table of one row is its own neighbour.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    schema = f"file_no int, kind string, doc_id long, text string, {_OUT}"
    kinds = pa.schema([("file_no", pa.int32()), ("kind", pa.string()), ("doc_id", pa.int64()), ("text", pa.string())] + [
        (n, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (x.split() for x in _OUT.split(", "))
    ])

    def run(batches):
        file_no, last, blank = TaskContext.get().partitionId(), None, dict.fromkeys(_NAMES)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tree = Tree(text)
                if last is None:
                    rows.append({"file_no": file_no, "kind": "first", "doc_id": doc_id, "text": text} | blank)
                else:
                    rows.append({"file_no": file_no, "kind": "row", "doc_id": doc_id, "text": None} | digest(text, tree, *last[1:]))
                last = (doc_id, text, tree)
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"file_no": file_no, "kind": "last", "doc_id": last[0], "text": last[1]} | blank], schema=kinds)

    ordered = narrow(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    done = written(ordered.mapInArrow(run, schema), "merkle")
    firsts = done.where("kind = 'first'").select("file_no", "doc_id", "text")
    files = firsts.select("file_no")  # one short row per range
    before = files.select("file_no", F.lag("file_no").over(Window.orderBy("file_no")).alias("before"))
    before = before.crossJoin(F.broadcast(files.agg(F.max("file_no").alias("end_no")))).select("file_no", F.coalesce("before", "end_no").alias("before"))
    lasts = done.where("kind = 'last'").select(F.col("file_no").alias("before"), F.col("text").alias("following"))
    edges = firsts.join(before, "file_no").join(lasts, "before").select("doc_id", "text", "following")

    def edge(x):
        rows = [digest(t, Tree(t), f, Tree(f)) for t, f in zip(x["text"], x["following"], strict=True)]
        return {"doc_id": x["doc_id"]} | {n: [r[n] for r in rows] for n in _NAMES}

    both = done.where("kind = 'row'").select("doc_id", *_NAMES).unionByName(map_batches(edges, edge, f"doc_id long, {_OUT}"))
    return both.select(real_id(), *_NAMES)
