"""Exact Jaccard self-join of word n-gram sets by prefix trees, and the components of its links.

A text's set holds 64-bit hashes of its distinct word n-grams, in one global order: n-grams that a
sample shows to be in very many texts last, otherwise by hash.  The order only steers the work; any
order gives the same links.

1. Texts with equal sets are one class.  A task sends on the set's marks of only the first text of a
   class that it meets; of these, one per class goes on.
2. Classes that agree in a band of min-hashes meet that band's hub (the one that most tasks met, or
   another chosen by hash); the pairs are verified and most classes of a group of copies are connected.
3. The exact step: any two sets with Jaccard >= t share one of their first n - ceil(t n) + 1 elements.
   Classes meet by these elements; pairs that are already connected are skipped (only components are
   asked for), pairs that lengths, places or parity bitmaps rule out too, and all others are verified.

Verification groups the pairs by hub, at most ``BLOCK`` sets of a hub in a block: the block's ordered
sets go into a trie, and the hub's set is traversed against it, so that common beginnings are counted
once and a subtree is left as soon as what remains on both sides cannot reach the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from formline.llm.common import Cache, commonest, map_batches, narrow, real_id, unique_ids, written
from formline.llm.components import connected

BANDS = 5
BLOCK = 256
#: Groups of up to so many members give their pairs at once; larger ones are compared by bitmap, in blocks of GROUP_BLOCK.
SMALL_GROUP, GROUP_BLOCK = 4, 2048
#: One text in HOT_SAMPLE is looked at for the order; at most HOT_KEPT n-grams are put last (a megabyte).
HOT_SAMPLE, HOT_LEAST, HOT_KEPT = 32, 3, 131_072
#: A list of wanted documents with up to so many places to go is broadcast (some megabytes); a longer one is joined by shuffling.
BROADCAST_PLACES = 200_000
SALTS = 16
#: Classes that a task remembers having met.
MET = 1_000_000
_WORDS = Cache(xxhash.xxh3_64_intdigest, 300_000)
_STEP = np.random.default_rng(41).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the n-grams of ASCII-lower-cased words; a shorter text is one n-gram as a whole."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    code = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        code += h[i : len(h) - k + 1 + i] * _STEP[i]
    return np.unique(_mixed(code))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def needed(m: int, n: int, percent: int) -> int:
    """The smallest intersection with which sets of m and n elements are linked: 100 i >= percent (m + n - i)."""
    return -(-percent * (m + n) // (100 + percent))


def bands(s: np.ndarray, count: int = BANDS) -> list[int]:
    """Each of two min-hashes; equal sets agree in all, sets of Jaccard 0.8 in two of three."""
    if not len(s):
        return []
    least = [int(_mixed(s * _STEP[8 + i]).min()) for i in range(2 * count)]
    return [hash((k, least[2 * k], least[2 * k + 1])) for k in range(count)]  # of integers: the same in every process


def parity(s: np.ndarray) -> bytes:
    """One bit per bucket of about one element each: whether their number is odd.

    Two sets' intersection is at most half of both sizes less the differing bits; a longer bitmap
    folds into a shorter one, since buckets are low bits.
    """
    b = min(max(64, 1 << (max(len(s), 1) - 1).bit_length()), 65_536)
    return np.packbits((np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8)).tobytes()


def may_link(m: int, n: int, a: bytes, b: bytes, percent: int) -> bool:
    """False only if bitmaps ``a`` and ``b`` of sets of m and n elements rule a link out."""
    size = min(len(a), len(b))
    return (m + n - int(np.bitwise_count(_folded(a, size) ^ _folded(b, size)).sum())) // 2 >= needed(m, n, percent)


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bitmap, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class Trie:
    """Ordered sets by their common beginnings; a node holds a run of elements."""

    __slots__ = ("run", "kids", "ends", "least", "most")

    def __init__(self, run: np.ndarray) -> None:
        self.run, self.kids, self.ends, self.least, self.most = run, {}, [], 2**62, 0

    def insert(self, s: np.ndarray, name: int) -> None:
        node, at, size = self, 0, len(s)
        node.least, node.most = min(node.least, size), max(node.most, size)
        while at < size:
            kid = node.kids.get(int(s[at]))
            if kid is None:
                kid = node.kids[int(s[at])] = Trie(s[at:])
                kid.least = kid.most = size
                kid.ends.append((name, size))
                return
            m = min(len(kid.run), size - at)
            off = (kid.run[:m] != s[at : at + m]).nonzero()[0]
            same = int(off[0]) if len(off) else m
            if same < len(kid.run):  # split the run
                low = Trie(kid.run[same:])
                low.kids, low.ends, low.least, low.most = kid.kids, kid.ends, kid.least, kid.most
                kid.run, kid.kids, kid.ends = kid.run[:same], {int(low.run[0]): low}, []
            kid.least, kid.most = min(kid.least, size), max(kid.most, size)
            node, at = kid, at + same
        node.ends.append((name, size))

    def linked(self, s: np.ndarray, percent: int) -> list[int]:
        """Names of the stored sets linked with ``s``."""
        n, out, stack = len(s), [], [(self, 0, 0)]
        while stack:
            node, depth, shared = stack.pop()
            left = n
            if len(node.run):
                at = np.searchsorted(s, node.run)
                shared += int((s[np.minimum(at, n - 1)] == node.run).sum()) if n else 0
                depth += len(node.run)
                left = n - int(np.searchsorted(s, node.run[-1], side="right"))
            for name, size in node.ends:
                if 100 * shared >= percent * (size + n - shared):
                    out.append(name)
            if node.kids and shared + min(left, node.most - depth) >= needed(node.least, n, percent):
                stack += [(kid, depth, shared) for kid in node.kids.values()]
        return out


def _hot(docs: DataFrame, n: int) -> np.ndarray:
    """Ascending hashes of the most common n-grams of one text in HOT_SAMPLE: it decides the order only."""

    def run(x):
        found = [shingles(t, n) for t in x["text"]]
        value, count = np.unique(np.concatenate(found), return_counts=True)
        return {"s": value.view(np.int64), "c": count}

    seen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(HOT_SAMPLE)) == 0).select("text")
    counts = map_batches(seen, run, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_LEAST)
    top = commonest(written(counts, "hot"), HOT_KEPT)  # bounded, whatever the number of tasks
    return np.sort(np.array([s for s, _ in top], np.int64).view(np.uint64))


_MARKS = "bands array<long>, parity binary, prefix binary"


def _sets(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Table of doc_id, given_id, n_shingles, digest of the set; for one text of each class also how many tasks met it
    (``copies``), its bands, its parity bitmap and its prefix in the global order (48 bits of each n-gram)."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot(docs, n))

    ddl = [f"doc_id long, given_id long, n_shingles long, digest binary, {c}{_MARKS}" for c in ("", "copies long, ")]
    kinds = [to_arrow_schema(StructType.fromDDL(d)) for d in ddl]

    def marks(s):
        late = hot.value[np.minimum(np.searchsorted(hot.value, s), len(hot.value) - 1)] == s if len(hot.value) else np.zeros(len(s), bool)
        prefix = np.concatenate([s[~late], s[late]])[: prefix_length(len(s), percent)] >> np.uint64(16)
        return bands(s), parity(s), np.ascontiguousarray(prefix.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()

    def run(batches):
        met = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {"doc_id": part.column(0).to_pylist(), "given_id": part.column(1).to_pylist(), "n_shingles": [], "digest": [], "bands": [], "parity": [], "prefix": []}
                for text in part.column(2).to_pylist():
                    s = shingles(text, n)
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    new = len(s) > 0 and digest not in met
                    for name, value in zip(("n_shingles", "digest", "bands", "parity", "prefix"), (len(s), digest, *(marks(s) if new else (None, None, None))), strict=True):
                        out[name].append(value)
                    if new:
                        if len(met) >= MET:
                            met.clear()
                        met.add(digest)
                yield pa.RecordBatch.from_pydict(out, schema=kinds[0])

    def one_of_each(batches):
        """Rows by digest: the first with marks keeps them and learns how many there are; it is held until its class ends."""
        held = None
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if r["prefix"] is None:
                    rows.append(r)
                elif held and held["digest"] == r["digest"]:
                    held["copies"] += 1
                    rows.append(r | {"bands": None, "parity": None, "prefix": None})
                else:
                    rows += [held] if held else []
                    held = r | {"copies": 1}
            yield pa.RecordBatch.from_pylist(rows, schema=kinds[1])
        yield pa.RecordBatch.from_pylist([held] if held else [], schema=kinds[1])

    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    made = docs.select("doc_id", "given_id", "text").mapInArrow(run, ddl[0])
    key = F.when(F.col("prefix").isNotNull(), F.col("digest")).otherwise(F.col("doc_id").cast("string").cast("binary"))  # what is only listed goes anywhere
    sorted_ = made.repartition(key).sortWithinPartitions("digest", "doc_id")
    return written(sorted_.mapInArrow(one_of_each, ddl[1]), "sets")


def verified(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked ones of (hub, member) pairs, as a table; sets travel to blocks of at most BLOCK members of a hub."""
    pairs = written(pairs.select("hub", "member"), "pairs")
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    hubs = blocks.select(F.col("hub").alias("doc_id"), "hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"))
    members = pairs.join(blocks, "hub").select(
        F.col("member").alias("doc_id"), "hub", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("kind")
    )
    goes = written(hubs.unionByName(members).groupBy("doc_id").agg(F.collect_list(F.struct("hub", "block", "kind")).alias("to")), "sends")
    wanted = F.broadcast(goes) if (goes.agg(F.sum(F.size("to") + 1)).first()[0] or 0) <= BROADCAST_PLACES else goes

    def send(x):
        out = {"hub": [], "block": [], "kind": [], "doc_id": [], "s": []}
        for doc, text, to in zip(x["doc_id"], x["text"], x["to"], strict=True):
            raw = shingles(text, n).tobytes()
            for t in to:
                for name, value in (("hub", t["hub"]), ("block", t["block"]), ("kind", t["kind"]), ("doc_id", doc), ("s", raw)):
                    out[name].append(value)
        return out

    sent = map_batches(docs.select("doc_id", "text").join(wanted, "doc_id"), send, "hub long, block int, kind int, doc_id long, s binary", rows=64)

    def check(batches):
        key, hub, trie, held = None, None, Trie(np.zeros(0, np.uint64)), 0
        kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links():
            return [(key[0], m) for m in trie.linked(hub, percent)] if held else []

        for batch in batches:
            found = []
            for h, block, kind, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if (h, block) != key or kind == 0:
                    found += links()
                    key, hub, trie, held = (h, block), s, Trie(np.zeros(0, np.uint64)), 0
                if kind:
                    trie.insert(s, doc)
                    held += 1
                    if held >= 2 * BLOCK:
                        found += links()
                        trie, held = Trie(np.zeros(0, np.uint64)), 0
            yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=kinds)
        found = links()
        yield pa.RecordBatch.from_pydict({"a": [x[0] for x in found], "b": [x[1] for x in found]}, schema=kinds)

    met = sent.repartition("hub", "block").sortWithinPartitions("hub", "block", "kind")
    return written(met.mapInArrow(check, "a long, b long"), "links")


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that their parity bitmaps do not rule out; a hub's bitmap goes to SALTS tasks, its members are dealt over them."""
    pairs = written(pairs.select("hub", "member"), "near")
    one, two = (sets.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("parity").alias(f"p_{k}")) for k in ("hub", "member"))
    one = one.join(pairs.select("hub").distinct(), "hub", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int")).join(one, ["hub", "salt"]).join(two, "member")
    both = both.select("hub", "member", "n_hub", "n_member", "p_hub", "p_member")

    def run(x):
        keep = [i for i in range(len(x["hub"])) if may_link(x["n_hub"][i], x["n_member"][i], x["p_hub"][i], x["p_member"][i], percent)]
        return {k: [x[k][i] for i in keep] for k in ("hub", "member")}

    return map_batches(both, run, "hub long, member long")


def _candidates(batches, percent: int):
    """Postings (token, doc_id, comp, n << 32 | pos) sorted by token, of tokens in several components: the pairs of a
    small group that can still be linked, the members of a larger one (which go on to ``_large``)."""
    kinds = pa.schema([("hub", pa.int64()), ("member", pa.int64()), ("token", pa.int64()), ("size", pa.int32())])
    held = None

    def found(cols):
        token, doc, comp, n, pos = cols
        edge = np.concatenate([[0], (token[1:] != token[:-1]).nonzero()[0] + 1])
        low, high = np.minimum.reduceat(comp, edge), np.maximum.reduceat(comp, edge)
        size = np.diff(np.concatenate([edge, [len(token)]]))
        mixed = low != high
        out = [np.zeros((2, 0), np.int64)]
        for g in range(2, SMALL_GROUP + 1):  # all groups of one size at a time
            at = edge[mixed & (size == g)]
            for i in range(g):
                for j in range(i + 1, g):
                    x, y = at + i, at + j
                    most = np.minimum(pos[x], pos[y]) + 1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1
                    ok = (comp[x] != comp[y]) & (most >= -(-percent * (n[x] + n[y]) // (100 + percent)))
                    out.append(np.stack([np.minimum(doc[x], doc[y])[ok], np.maximum(doc[x], doc[y])[ok]]))
        pairs = np.unique(np.concatenate(out, 1), axis=1)
        group = np.repeat(np.arange(len(edge)), size)
        big = (mixed & (size > SMALL_GROUP))[group]
        k, m = pairs.shape[1], int(big.sum())
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([pairs[0], doc[big]])), pa.array(np.concatenate([pairs[1], np.zeros(m, np.int64)])),
            pa.array(np.concatenate([np.zeros(k, np.int64), token[big]])), pa.array(np.concatenate([np.zeros(k, np.int32), size[group[big]].astype(np.int32)])),
        ], schema=kinds)

    for batch in batches:
        token, doc, comp, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cols = [token, doc, comp, at >> 32, at & 0xFFFFFFFF]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        cut = int((cols[0] != cols[0][-1]).sum())  # tokens are sorted: the last one's group may go on
        held = [c[cut:] for c in cols]
        if cut:
            yield found([c[:cut] for c in cols])
    if held is not None:
        yield found(held)


def _large(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of large groups (rows doc_id, token, size) that lengths and parity bitmaps leave, compared in blocks.

    A group of over GROUP_BLOCK members is cut into blocks, and every two blocks meet in a task of their own.
    """
    n_blocks = F.ceil(F.col("size") / GROUP_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    rows = members.withColumn("blocks", n_blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("doc_id", "token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own")
    rows = rows.join(sets.select("doc_id", F.col("n_shingles").alias("n"), "comp", "parity"), "doc_id").select("token", "x", "y", "own", "doc_id", "n", "comp", "parity")

    def run(batches):
        kinds = pa.schema([("hub", pa.int64()), ("member", pa.int64())])
        key, group = None, []

        def pairs():
            shortest = min(len(g[4]) for g in group)
            bits = np.stack([_folded(g[4], shortest) for g in group])
            own, doc, n, comp = (np.array([g[i] for g in group], np.int64) for i in range(4))
            out = []
            for i in range(0, len(group), 128):
                z = np.s_[i : i + 128]
                off = np.bitwise_count(bits[z, None, :] ^ bits[None, i:, :]).sum(2, dtype=np.int64)
                both = n[z, None] + n[None, i:]
                ok = ((both - off) // 2 >= -(-percent * both // (100 + percent))) & (comp[z, None] != comp[None, i:])
                ok &= 100 * np.minimum(n[z, None], n[None, i:]) >= percent * np.maximum(n[z, None], n[None, i:])
                ok &= np.arange(len(own[z]))[:, None] < np.arange(len(group) - i)[None, :]
                if key[1] != key[2]:  # pairs inside a block meet where the block meets itself
                    ok &= own[z, None] != own[None, i:]
                for r, s in zip(*ok.nonzero(), strict=True):
                    a, b = i + r, i + s
                    if may_link(int(n[a]), int(n[b]), group[a][4], group[b][4], percent):
                        out.append((min(doc[a], doc[b]), max(doc[a], doc[b])))
            return out

        for batch in batches:
            out = []
            for t, x, y, *row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if (t, x, y) != key:
                    out += pairs() if len(group) > 1 else []
                    key, group = (t, x, y), []
                group.append(row)
            yield pa.RecordBatch.from_pydict({"hub": [p[0] for p in out], "member": [p[1] for p in out]}, schema=kinds)
        out = pairs() if len(group) > 1 else []
        yield pa.RecordBatch.from_pydict({"hub": [p[0] for p in out], "member": [p[1] for p in out]}, schema=kinds)

    return rows.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y").mapInArrow(run, "hub long, member long")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links).

    Texts without words have an empty set and are linked with nothing, not even each other.  Repeated
    rows are linked as equal texts are.
    """
    docs = unique_ids(narrow(df, id_col, text_col))
    sets = _sets(docs, n, percent)
    firsts = sets.where("prefix is not null")  # one text of each class

    banded = firsts.select("doc_id", "n_shingles", "copies", F.posexplode("bands").alias("k", "band"))
    rank = F.when(F.col("k") % 2 == 0, F.struct(F.col("copies").cast("long").alias("x"), (-F.col("doc_id")).alias("y"))).otherwise(
        F.struct(F.xxhash64("doc_id", F.lit(7)).alias("x"), (-F.col("doc_id")).alias("y")))
    hubs = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.max_by(F.struct("doc_id", "n_shingles"), rank).alias("hub")).where("c > 1")
    near = banded.join(hubs, "band").select(F.col("hub.doc_id").alias("hub"), F.col("doc_id").alias("member"), F.col("hub.n_shingles").alias("m"), F.col("n_shingles").alias("k"))
    near = near.where((F.col("hub") != F.col("member")) & (100 * F.least("m", "k") >= percent * F.greatest("m", "k"))).select("hub", "member").distinct()
    links = verified(docs, _possible(near, firsts, percent), n, percent)
    groups = connected(links)

    labelled = firsts.join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("comp"), "parity", "prefix"
    )

    def post(x):
        sizes = [len(p) // 6 for p in x["prefix"]]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(x["prefix"]), np.uint8).reshape(-1, 6)
        each = lambda name: np.repeat(np.array(x[name], np.int64), sizes)
        pos = np.concatenate([np.arange(k) for k in sizes]).astype(np.int64)
        return {"token": wide.view("<i8").ravel(), "doc_id": each("doc_id"), "comp": each("comp"), "at": each("n_shingles") << 32 | pos}

    postings = map_batches(labelled.select("doc_id", "n_shingles", "comp", "prefix"), post, "token long, doc_id long, comp long, at long")
    found = written(
        postings.repartition("token").sortWithinPartitions("token").mapInArrow(lambda b: _candidates(b, percent), "hub long, member long, token long, size int"),
        "candidates"
    )
    small = _possible(found.where("size = 0").select("hub", "member").distinct(), firsts, percent)
    large = _large(found.where("size > 0").select(F.col("hub").alias("doc_id"), "token", "size"), labelled, percent)
    more = verified(docs, small.union(large).distinct(), n, percent)
    if not more.isEmpty():
        groups = connected(links.union(more))
    return _answer(sets, groups)


def _answer(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Each document with its component's smallest id, as ids were given: components of classes, named after all their members."""
    shown = F.max(F.when(F.col("prefix").isNotNull(), F.col("doc_id"))).alias("shown")
    classes = sets.where("n_shingles > 0").groupBy("digest").agg(shown, F.min("doc_id").alias("first"))
    classes = classes.join(groups.select(F.col("id").alias("shown"), "comp"), "shown", "left").select("digest", "first", F.coalesce("comp", "shown").alias("comp"))
    named = written(classes, "classes")
    names = named.groupBy("comp").agg(F.min("first").alias("name"))
    own = named.join(names, "comp").select("digest", "name")
    rows = sets.select("doc_id", "given_id", "n_shingles", "digest").join(own, "digest", "left")
    rows = rows.select("given_id", "n_shingles", F.coalesce("name", "doc_id").alias("name"))
    given = sets.where("doc_id != given_id").select(F.col("doc_id").alias("name"), F.col("given_id").alias("name_given")).distinct()
    if not given.isEmpty():
        rows = rows.join(given, "name", "left").withColumn("name", F.coalesce("name_given", "name"))
    return rows.select(real_id("given_id").alias("doc_id"), "n_shingles", real_id("name").alias("component_id"))
