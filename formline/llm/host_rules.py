"""Host-level quality rules: document rules, failure rates by host with a beta prior, verdicts joined back."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import NULL_ID, map_batches, real_id, written

_SYMBOL = re.compile(r"[#*$%&|<>]")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5


def measure(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    chars = np.frombuffer(raw, np.uint8)
    space = (chars == 32) | ((chars >= 9) & (chars <= 13))
    word_chars = int(((chars & 0xC0) != 0x80).sum() - space.sum())
    repeat = 0
    if len(ids) >= 4:
        n = len(seen)
        if n**3 < 2**62:
            window = (ids[:-2] * n + ids[1:-1]) * n + ids[2:]
        else:
            pair = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1]
            window = pair * n + ids[2:]
        _, code, count = np.unique(window, return_inverse=True, return_counts=True)
        twice = count[code] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : len(ids) - 2 + k] |= twice
        repeat = int(covered.sum())
    dup, lines = 0, set()
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            if line in lines:
                dup += 1
            lines.add(line)
    return len(words), word_chars, len(_SYMBOL.findall(text)), dup, repeat


def document_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: ``doc_id``, ``host``, the five counts and ``base_failed``."""
    rows = df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.col(host_col).cast("string").alias("host"),
    )

    def run(x):
        m = np.array([measure(t) for t in x["text"]], np.int64)
        failed = (m[:, 0] < MIN_WORDS) | (100 * m[:, 4] > MAX_REPEAT_PERCENT * m[:, 0])
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {"doc_id": x["doc_id"], "host": x["host"]} | {n: m[:, i] for i, n in enumerate(names)} | {"base_failed": failed}

    schema = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    return map_batches(rows, run, schema)


def host_rates(rules: DataFrame) -> DataFrame:
    """Per host: documents, failures and the rate shrunk by a beta prior fitted to all hosts by moments.

    With the hosts' mean rate m and variance v, the prior's strength is m(1-m)/v - 1, at least 2
    (also where v is 0 or there is one host).  All of it is two small aggregates over the hosts.
    """
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v")).select(
        "m", F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.when(F.col("v") > 0, F.col("v")) - 1, F.lit(2.0))).otherwise(F.lit(2.0)).alias("k")
    )
    shrunk = (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("host_rate"))  # the prior is one row


def apply(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per input row with its counts, its host's rate and ``kept``.

    Null hosts form one host of their own.  Repeated rows are counted and returned each.
    """
    rules = written(document_rules(df, id_col, text_col, host_col), "host-rules")
    hosts = host_rates(rules).select(F.col("host").alias("_host"), "host_rate")
    both = rules.join(hosts, rules.host.eqNullSafe(hosts["_host"]), "left")
    return both.select(
        real_id(), "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= max_rate)).alias("kept"),
    )
