"""Quality by nearest-neighbour voting over latent-semantic vectors.

Fit (bounded): at most ``MAX_LABELLED`` labelled texts, those with the smallest id hash, become
hashed byte-trigram weights plus a few style terms; a truncated SVD of that matrix gives the
latent space.  Score (every document): its vector's exact cosine with every labelled vector, in
blocks; the nearest ``NEIGHBOURS`` vote with their similarity as weight.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_batches, narrow, real_id

#: The bound of the labelled sample: what is broadcast is this many vectors of RANK floats.
MAX_LABELLED = 4000
BUCKETS = 2048
RANK = 48
NEIGHBOURS = 25
STYLE = 8


def features(text: str) -> np.ndarray:
    """Hashed trigram weights (unit length) and style terms of one whole text, float32."""
    out = np.zeros(BUCKETS + STYLE, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return out
    if len(raw) >= 3:
        b = raw.astype(np.uint32)
        code = (b[:-2] * 65536 + b[1:-1] * 256 + b[2:]) * np.uint32(2654435761)
        tf = np.log1p(np.bincount(code >> np.uint32(21), minlength=BUCKETS).astype(np.float32))
        out[:BUCKETS] = tf / max(float(np.sqrt(tf @ tf)), 1e-9)
    words = raw.tobytes().split()
    n = max(len(words), 1)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    pairs = 1 - len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1) if len(words) > 1 else 0
    kinds = np.bincount(_KIND[raw], minlength=5) / len(raw)
    out[BUCKETS:] = (same, pairs, *np.minimum(kinds[1:] * (2, 3, 4, 8), 1), len(set(words)) / n * 0.3, min(np.log1p(n) / 12, 1) * 0.5)
    return out


_KIND = np.zeros(256, np.int64)
_KIND[65:91] = 1  # capitals
_KIND[48:58] = 2  # digits
_KIND[list(b"!?#*$%&|<>=_{}[]\\^~@+")] = 3  # symbols
_KIND[[9, 10, 13]] = 4  # line ends and tabs


def fit_space(x: np.ndarray, rank: int = RANK, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(term weights with idf, projection) by a randomised truncated SVD."""
    df = (x > 0).sum(0)
    idf = np.log((1 + len(x)) / (1 + df)).astype(np.float32) + 0.2
    idf[BUCKETS:] = 1.0
    m = x * idf
    rng = np.random.default_rng(seed)
    k = min(rank + 10, *m.shape)
    q = np.linalg.qr(m @ rng.standard_normal((m.shape[1], k)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(m @ np.linalg.qr(m.T @ q)[0])[0]
    v = np.linalg.svd(q.T @ m, full_matrices=False)[2][:rank]
    return idf, v.T.astype(np.float32)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.sqrt((z * z).sum(1, keepdims=True)), 1e-9)


def vote(z: np.ndarray, anchors: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Similarity-weighted share of label 1 among the k nearest anchors of each row.

    Cosines count in steps of 1e-5, so how rows fall into blocks decides nothing; at equal steps the
    anchor with the smaller number is nearer.
    """
    step = np.rint((z @ anchors.T).astype(np.float64) * 1e5).astype(np.int64)
    k = min(k, len(anchors))
    near = np.argpartition(np.arange(len(anchors)) - step * len(anchors), k - 1, axis=1)[:, :k]
    weight = (np.maximum(np.take_along_axis(step, near, 1), 0) / 1e5) ** 8 + 1e-9
    return (weight * labels[near]).sum(1) / weight.sum(1)


def train_split(id_col: str = "doc_id"):
    """True for rows that may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_labelled: int = MAX_LABELLED, text_key: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted`` (and ``text_hash``, xxhash64 of the text).

    Only text is ever an input of a score.  Empty (and null) texts score 0.0; without any usable label
    every other text scores 0.5.  Repeated label rows of an id count once (the larger label).
    """
    spark = docs.sparkSession
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train_split(id_col))
        .groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    texts = narrow(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").where("text != ''")  # at most max_labelled short rows
    rows = map_batches(
        texts, lambda x: {"doc_id": x["doc_id"], "label": x["label"], "f": [features(t).tobytes() for t in x["text"]]}, "doc_id long, label int, f binary"
    ).collect()  # bounded by max_labelled
    rows = sorted({r.doc_id: r for r in rows}.values(), key=lambda r: r.doc_id)
    model = None
    if rows:
        x = np.stack([np.frombuffer(r.f, np.float32) for r in rows])
        idf, space = fit_space(x)
        model = (idf[:, None] * space, _unit((x * idf) @ space), np.array([r.label for r in rows], np.float32))
    shared = spark.sparkContext.broadcast(model)

    def run(x):
        texts, model = x["text"], shared.value
        out = np.full(len(texts), 0.5)
        if model is not None and texts:
            space, anchors, y = model
            out = vote(_unit(np.stack([features(t) for t in texts]) @ space), anchors, y).astype(np.float64)
        out[[i for i, t in enumerate(texts) if not t]] = 0.0
        return {"doc_id": x["doc_id"], "score": np.clip(out, 0.0, 1.0)} | {c: x[c] for c in key}

    key = ["text_hash"] if text_key else []
    rows = narrow(docs, id_col, text_col)
    rows = rows.withColumn("text_hash", F.xxhash64("text")) if text_key else rows
    scored = map_batches(rows, run, "doc_id long, score double" + ", text_hash long" * text_key)
    return scored.select(real_id(), "score", *key).select(
        "doc_id", (~train_split("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *key
    )
