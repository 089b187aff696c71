"""Collocations: phrases of two to four words that stand together far oftener than their parts apart.

1. Texts are read once, into blocks of one language: the block's distinct words, their counts, and the
   block as numbers of these words with breaks between pieces.  Words are counted by Spark; those with
   ``least`` occurrences get ids, and each block's numbers become ids by a join of its own words.
2. Pairs of ids, then runs of three and four whose pairs are all frequent, are counted in quotient
   filters: each task merges its blocks' and sends a filter for each range of permuted keys; the ranges'
   filters meet, merge, and give back the frequent phrases.  Which pairs are frequent goes to the tasks
   as a bitmap of bounded size: it lets through all frequent ones, so it decides cost, not counts.
3. Scores, cuts and what longer phrases explain are joins of frequent phrases with each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formline.llm import quotient_filter as Q
from formline.llm.common import written

LEAST = 30
WORDS = 4
TOP = 2000
SCALE = 2_000_000
#: Words of a block, at about; keys that a task holds; distinct keys that a range of merged filters may have, at about.
BLOCK = 1 << 18
HELD = 1 << 20
RANGE = 1 << 19
#: The bitmap of frequent pairs has at most so many bits (8 MB).
SIEVE_BITS = 26
#: Texts are read in parts of about so many bytes.
PART = 1 << 20
_BREAK = b".,;:!?\n\x0b\x0c\r"
_LOWER = bytes(10 if c in _BREAK else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs inside; afterwards the session is as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class _Numbers(dict):
    """Numbers of a block's words from 1, in order of appearance; 0 is a break, -1 nothing."""

    def __init__(self) -> None:
        super().__init__({b"": -1, b"\n": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) - 1
        return number


def pieces(raw: bytes, size: int = PART) -> Iterator[bytes]:
    """The text in lower case, breaks as line ends, in parts of about ``size`` bytes that end between words, after a break if one is there."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        part = raw[at:end].translate(_LOWER)
        while end < len(raw) and b" " not in part and b"\n" not in part:  # inside one very long word
            part, end = part + raw[end : end + size].translate(_LOWER), min(end + size, len(raw))
        if end < len(raw):
            part = part[: (part.rfind(b"\n") + 1) or (part.rfind(b" ") + 1)]
        at += len(part)
        yield part


_BLOCK_SCHEMA = "block long, lang string, n_words long, words array<string>, counts array<int>, numbers binary"


def _blocks(batches):
    """Blocks of the languages that a task's texts have."""
    kinds = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("numbers", pa.binary())])
    open_: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
    sizes: dict[str, int] = {}
    made = TaskContext.get().partitionId() << 32

    def close(lang):
        nonlocal made
        known, parts = open_.pop(lang)
        del sizes[lang]
        numbers = np.concatenate(parts)
        counts = np.bincount(numbers, minlength=len(known) - 1)[1:]
        words = pa.array(list(known)[2:], pa.binary()).cast(pa.string())
        whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        kind = np.uint16 if len(known) < 1 << 16 else np.uint32
        columns = [pa.array([made]), pa.array([lang]), pa.array([int(counts.sum())]), whole(words), whole(pa.array(counts.astype(np.int32))), pa.array([numbers.astype(kind).tobytes()], pa.binary())]
        made += 1
        return pa.RecordBatch.from_arrays(columns, schema=kinds)

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in pieces(raw + b"\n"):
                known, parts = open_.setdefault(lang, (_Numbers(), []))
                words = part.replace(b"\n", b" \n ").split(b" ")
                numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                parts.append(numbers[numbers >= 0].astype(np.uint32))
                sizes[lang] = sizes.get(lang, 0) + len(parts[-1])
                if part.endswith(b"\n"):  # no phrase goes on
                    if sizes[lang] >= BLOCK:
                        yield close(lang)
                    if sum(sizes.values()) >= 4 * BLOCK:
                        for each in list(open_):
                            yield close(each)
    for lang in list(open_):
        yield close(lang)


def _coded(batches):
    """Numbers of blocks as ids; words without one are breaks."""
    for batch in batches:
        block, numbers, total, mapping = (batch.column(i) for i in range(4))
        local, ids = (mapping.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edge = mapping.offsets.to_numpy()
        out = []
        for i in range(batch.num_rows):
            size = total[i].as_py()
            code = np.zeros(size + 1, np.uint32)
            code[local[edge[i] : edge[i + 1]]] = ids[edge[i] : edge[i + 1]]
            out.append(code[np.frombuffer(numbers[i].as_py(), np.uint16 if size + 2 < 1 << 16 else np.uint32)].tobytes())
        yield pa.RecordBatch.from_arrays([block, pa.array(out, pa.binary())], names=["block", "codes"])


_FILTER_SCHEMA = "k int, part int, filter binary"


def _filters(sizes: tuple[int, ...], width: int, part_bits: int, sieve):
    """Counts phrases of ``sizes`` ids in a task's blocks: filters by range of permuted keys."""

    def run(batches):
        kinds = pa.schema([("k", pa.int32()), ("part", pa.int32()), ("filter", pa.binary())])
        held = {k: [] for k in sizes}
        bits = None if sieve is None else np.frombuffer(sieve.value, np.uint8)

        def reduce(k):
            held[k] = [Q.merged(held[k], Q.half_bits(k, width))]

        def emit(k):
            half = Q.half_bits(k, width)
            (a, b), counts = held[k][0]
            skip = min(part_bits, half)
            parts = (a >> np.uint64(half - skip)).astype(np.int64)
            edge = np.concatenate([[0], (parts[1:] != parts[:-1]).nonzero()[0] + 1, [len(parts)]])
            rows, size = [], 0
            for x, z in zip(edge, edge[1:], strict=False):
                if x < z:
                    rows.append((k, int(parts[x]), Q.encode((a[x:z], b[x:z]), counts[x:z], half, skip)))
                    size += len(rows[-1][2])
                if rows and (size >= 1 << 23 or z == len(parts)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.types[i]) for i in range(3)], schema=kinds)
                    rows, size = [], 0
            held[k] = []

        for batch in batches:
            for raw in batch.column(0):
                codes = np.frombuffer(raw.as_py(), np.uint32)
                for k in sizes:
                    n = len(codes) - k + 1
                    if n < 1:
                        continue
                    good = codes[:n] > 0
                    for j in range(1, k):
                        good &= codes[j : n + j] > 0
                    if bits is not None:
                        good &= _all_frequent(codes, k, width, bits)
                    at = good.nonzero()[0]
                    half = Q.half_bits(k, width)
                    held[k].append(Q.counted(Q.permute(Q.pack([codes[at + j] for j in range(k)], width), half), None, half))
                    if sum(len(p[1]) for p in held[k]) >= HELD:
                        reduce(k)
                        if len(held[k][0][1]) >= HELD // 2:
                            yield from emit(k)
        for k in sizes:
            if held[k]:
                reduce(k)
                yield from emit(k)

    return run


def _slots(keys: Q.Keys, half: int, n_bits: int) -> np.ndarray:
    """The bit of each permuted pair in a bitmap of n_bits."""
    return ((keys[0] << np.uint64(half) | keys[1]) & np.uint64(n_bits - 1)).astype(np.int64)


def _all_frequent(codes: np.ndarray, k: int, width: int, bits: np.ndarray) -> np.ndarray:
    """True where no pair inside the k ids from there is surely rare."""
    half = Q.half_bits(2, width)
    slot = _slots(Q.permute(Q.pack([codes[:-1], codes[1:]], width), half), half, 8 * len(bits))
    pair = (bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)
    n = len(codes) - k + 1
    good = pair[:n].copy()
    for j in range(1, k - 1):
        good &= pair[j : n + j]
    return good


def _frequent(width: int, least: int, sieve_bits: int):
    """Merges the filters of each (k, part), which come sorted by them: the phrases of at least ``least`` occurrences."""
    kinds = pa.schema([("ids", pa.list_(pa.int64())), ("f", pa.int64()), ("slot", pa.int64())])

    def out(k, part):
        half = Q.half_bits(k, width)
        keys, counts = Q.merged(part, half)
        good = counts >= least
        keys = keys[0][good], keys[1][good]
        slot = _slots(keys, half, 1 << sieve_bits) if k == 2 else np.zeros(int(good.sum()), np.int64)
        ids = np.stack(Q.unpack(Q.restore(keys, half), k, width), 1).ravel() if good.any() else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(int(good.sum()) + 1) * k, pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([lists, pa.array(counts[good]), pa.array(slot)], schema=kinds)

    def run(batches):
        last, held = None, []
        for batch in batches:
            for k, part, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (k, part) != last:
                    if held:
                        yield out(last[0], held)
                    last, held = (k, part), []
                held.append(Q.decode(raw, part))
                if sum(len(p[1]) for p in held) >= 2 * RANGE and len(held) > 1:
                    held = [Q.merged(held, Q.half_bits(k, width))]
        if held:
            yield out(last[0], held)

    return run


def _with_ids(words: DataFrame) -> DataFrame:
    """Adds ``id``, from 1 without gaps: by the rows of each written part and those of the parts before."""
    kept = written(words.withColumn("_m", F.monotonically_increasing_id()), "phrases-words")
    part = F.shiftright("_m", 33)
    sizes = kept.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # as many rows as parts
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    numbered = kept.withColumn("_p", part).join(F.broadcast(before), "_p")
    return numbered.select(*words.columns, (F.col("_before") + F.col("_m").bitwiseAND(F.lit(2**33 - 1)) + 1).alias("id"))


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, words: int = WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, vocabulary, totals): (ids, f) of all phrases of up to ``words`` words with at least ``least`` occurrences in
    their language, (lang, word, id) of such words, and (lang, n) with the words of each language.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    with batches_of(spark, 256):
        blocks = written(docs.mapInArrow(_blocks, _BLOCK_SCHEMA), "phrases-blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    seen = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w"))
    seen = seen.select("block", "lang", (F.col("local") + 1).alias("local"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    common = seen.groupBy("lang", "word").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    vocabulary = written(_with_ids(common), "phrases-vocabulary")
    size, n = vocabulary.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0], totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = max(int(size).bit_length(), 1)
    if width > 32:
        raise ValueError(f"more than 2**32 words occur {least} times: raise least")
    mapping = seen.join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("local", "id")).alias("ids"))
    whole = blocks.select("block", "numbers", F.size("words").alias("n_local")).join(mapping, "block")
    with batches_of(spark, 16):
        coded = written(whole.select("block", "numbers", "n_local", "ids").mapInArrow(_coded, "block long, codes binary"), "phrases-coded")
    part_bits = max((int(n) // RANGE).bit_length(), 0)

    def counted(sizes, sieve, sieve_bits):
        with batches_of(spark, 16):
            made = coded.select("codes").mapInArrow(_filters(sizes, width, part_bits, sieve), _FILTER_SCHEMA)
            met = made.repartition("k", "part").sortWithinPartitions("k", "part").mapInArrow(_frequent(width, least, sieve_bits), "ids array<long>, f long, slot long")
            return written(met, "phrases-counted")

    sieve_bits = min(SIEVE_BITS, max(16, (int(size) * 32).bit_length()))
    found = [vocabulary.select(F.array("id").alias("ids"), "f")]
    if words > 1:
        pairs = counted((2,), None, sieve_bits)
        found.append(pairs.select("ids", "f"))
    if words > 2:
        bit = F.col("slot") + 1
        rows = pairs.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()  # at most 8 MB
        sieve = bytearray((1 << sieve_bits) // 8)
        for r in rows:
            at = (r.b - 1) * 4096
            sieve[at : at + 4096] = r.bits[: len(sieve) - at]
        longer = counted(tuple(range(3, words + 1)), spark.sparkContext.broadcast(bytes(sieve)), sieve_bits)
        found.append(longer.select("ids", "f"))
    phrases = found[0]
    for f in found[1:]:
        phrases = phrases.unionByName(f)
    return phrases, vocabulary, totals


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, words: int = WORDS, top: int = TOP, share: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of two to ``words`` words by score, then count, then phrase in byte order.

    ``a``, ``l``, ``r`` count the phrase and the two parts of its weakest cut (of equal scores the shortest first
    part), ``n`` all words.  A phrase that lies inside a longer one with at least ``share`` percent of its count
    is left out.  A null language is ``und``; null and empty texts have no words; repeated rows count each time;
    an empty table gives no rows.  Ties are broken by the phrase, so the result is one.  Products are exact
    up to 9 * 10**16 occurrences.  A very long text is read in parts; only a stretch without any break is held whole.
    """
    phrases, vocabulary, totals = frequent_phrases(df, text_col, lang_col, least, words)
    phrases = phrases.select("ids", "f")
    long_ones = phrases.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    cut = long_ones.withColumn("j", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cut = cut.withColumns({"first": F.slice("ids", F.lit(1), F.col("j")), "rest": F.slice("ids", F.col("j") + 1, F.size("ids") - F.col("j"))})
    scored = cut.join(phrases.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(phrases.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    score = F.expr(f"CAST(CAST({SCALE} AS DECIMAL(9,0)) * CAST(a AS DECIMAL(19,0)) AS DECIMAL(38,0)) DIV CAST(l + r AS DECIMAL(38,0))")
    weakest = scored.groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "j", "l", "r")).alias("c"))
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    inside = long_ones.where(F.size("ids") > 2).select(F.explode(F.array_distinct(inner)).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("around"))
    kept = weakest.join(inside, "ids", "left").where(F.col("around").isNull() | (100 * F.col("around") < share * F.col("a")))
    spelled = kept.select("ids", "a", "c", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = spelled.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = named.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # a language's best are among the best of its 64 parts
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
