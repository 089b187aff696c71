"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut where no match of the splitting pattern can cross: before a space that
follows a character which is not white space.  Every piece of the pattern that holds a
non-space character ends before the next white space, so cuts there change no piece.
"""

from __future__ import annotations

import base64
import hashlib
import re

import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_batches, narrow, real_id

#: Characters after which the next safe boundary ends a chunk.
CHUNK = 32_768
#: Runs of white space from this length on are split here, as the library's matcher backtracks over them.
LONG_SPACE = 4_096
_SAFE = re.compile(r"(?<=\S) ")
_SPACES = re.compile(r"\s{%d,}" % LONG_SPACE)
_CODECS: dict[int, "ByteBPE"] = {}


class ByteBPE:
    """The codec of one rank file, made from the file's bytes so that tasks need no local copy."""

    def __init__(self, rank_bytes: bytes, pattern: str) -> None:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_bytes.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = [str(i) for i in range(max(ranks.values(), default=-1) + 1)]

    @staticmethod
    def shared(rank_bytes: bytes, pattern: str) -> "ByteBPE":
        """One codec per worker process and rank file."""
        key = hash((rank_bytes, pattern))
        if key not in _CODECS:
            _CODECS[key] = ByteBPE(rank_bytes, pattern)
        return _CODECS[key]

    def chunks(self, text: str) -> list[str]:
        """Consecutive parts of ``text``, cut at safe boundaries only."""
        out, start = [], 0
        while len(text) - start > CHUNK and (cut := _SAFE.search(text, start + CHUNK)):
            out.append(text[start : cut.start()])
            start = cut.start()
        out.append(text[start:])
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.chunks(text) if len(text) > CHUNK else (text,):
            if len(part) >= LONG_SPACE and _SPACES.search(part):
                for piece in self.pattern.findall(part):
                    ids += self.encoding._encode_single_piece(piece)
            else:
                ids += self.encoding.encode_ordinary(part)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def _codec(df: DataFrame, rank_path: str, pattern: str):
    with open(rank_path, "rb") as f:  # about a megabyte, fixed by the vocabulary
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: ByteBPE.shared(shared.value, pattern)


def encode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``ids`` (array of int).  Null and empty texts give no ids."""
    codec = _codec(df, rank_path, pattern)

    def run(x):
        bpe = codec()
        return {"doc_id": x["doc_id"], "ids": [bpe.encode(t) for t in x["text"]]}

    return map_batches(narrow(df, id_col, text_col), run, "doc_id long, ids array<int>").select(real_id(), "ids")


def decode(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: ``doc_id``, ``decoded`` (binary); a null array counts as empty."""
    codec = _codec(df, rank_path, pattern)

    def run(x):
        bpe = codec()
        return {"doc_id": x["doc_id"], "decoded": [bpe.decode(ids) for ids in x["ids"]]}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return map_batches(rows, run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass; per input row the count and digests of both directions."""
    codec = _codec(df, rank_path, pattern)

    def run(x):
        bpe = codec()
        out = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for text in x["text"]:
            ids = bpe.encode(text)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(narrow(df, id_col, text_col), run, schema).select(real_id(), "n_tokens", "ids_sha256", "decoded_sha256")
