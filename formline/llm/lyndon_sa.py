"""Removing repeated 100-byte strings, with suffix arrays built by linear grouping.

``suffix_array`` orders suffixes without recursive renaming: suffixes are grouped by their Lyndon
prefix, the groups are refined in descending order along previous-smaller pointers, and a last
sweep along the same pointers emits each group's order.

Spark's part is to bring together what can be equal.  Every window of 100 bytes belongs to one
anchor, the 32-byte string in it whose hash is smallest (the first such).  Equal windows belong to
equal anchors, so only occurrences of one anchor need to meet, each with the run of windows that
belong to it (its fragment):

1. Texts are read once.  Of occurrences of an anchor with the same fragment a task sends on only the
   first; the others are known repeats at once, so a passage in a third of all rows leaves each batch once.
2. Occurrences meet by anchor in sorted streams: again later ones with the same fragment are
   repeats.  Anchors with one kind of fragment are done.
3. The rest, edges of edits and of passages, fetch their bytes and meet again by anchor.  Cut to what
   another fragment shares, with the anchor itself as one symbol, they go into suffix arrays, which
   find the equal windows; the earliest of each keeps.
4. An anchor with more than HOT such rows is dealt over salts and cut into blocks: each block finds
   its own repeats and names the earliest place of each of its windows, and these meet by window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_batches, narrow, real_id, unique_ids, written
from formline.llm.rolling import VALUE, mixed, powers, ragged

LENGTH = 100
ANCHOR = 32
#: Symbols of a window whose anchor is one symbol.
SYMBOLS = LENGTH - ANCHOR + 1
#: Texts are joined, and very long ones cut, to about so many bytes.
PIECE = 1 << 18
#: Suffix arrays are built over blocks of about so many symbols; only groups of anchors with over HOT rows are cut.
BLOCK = 32_768
HOT = 1024
#: So many hot anchors are a few megabytes.
BROADCAST_ANCHORS = 200_000


def suffix_array(data: list[int]) -> list[int]:
    """Start positions of the suffixes of ``data`` (non-negative integers) in ascending order.

    A virtual smallest end follows the data.  Phase one refines groups held as ranges of one array:
    the members of a processed group point to their previous smaller suffix, and pointed-to suffixes
    move, by how many pointers they got, to a new group right after their old one.  Phase two walks
    the order from the end symbol and places, along the pointers, each suffix at its group's front.
    """
    n = len(data)
    if not n:
        return []
    text = [*(x + 1 for x in data), 0]
    n += 1
    items = sorted(range(n), key=text.__getitem__)  # stable: by symbol, then by place
    place = [0] * n  # of each suffix in items
    group = [0] * n  # of each suffix: the first place of its range
    size: dict[int, int] = {}
    for i, s in enumerate(items):
        place[s] = i
        group[s] = group[items[i - 1]] if i and text[items[i - 1]] == text[s] else i
        size[group[s]] = size.get(group[s], 0) + 1
    prev = [-1] * n
    end = n
    while end > 0:
        start = group[items[end - 1]]
        if end - start == 1:  # most groups: one suffix, which moves at most one other
            s = items[start]
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[s] = p
            end = start
            if p >= 0:
                old = group[p]
                n_old = size[old]
                if n_old > 1:
                    last, at = old + n_old - 1, place[p]
                    other = items[last]
                    items[at], items[last] = other, p
                    place[other], place[p] = at, last
                    group[p] = last
                    size[last], size[old] = 1, n_old - 1
            continue
        members = sorted(items[start:end])
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[s] = p
        pointed: dict[int, int] = {}
        for s in members:
            if prev[s] >= 0:
                pointed[prev[s]] = pointed.get(prev[s], 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, count in pointed.items():
            by_count.setdefault(count, {}).setdefault(group[p], []).append(p)
        for count in sorted(by_count, reverse=True):
            for old, moved in by_count[count].items():
                last = old + size[old]
                if len(moved) == size[old]:
                    continue  # the whole group moves: nothing changes
                first = last - len(moved)
                for p in moved:  # to the back of the old range
                    last -= 1
                    other, at = items[last], place[p]
                    items[at], items[last] = other, p
                    place[other], place[p] = at, last
                for p in moved:
                    group[p] = first
                size[first] = len(moved)
                size[old] -= len(moved)
        end = start
    front = {}
    order = [-1] * n
    done = [False] * n
    order[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            at = front.get(g, g)
            order[at] = s
            front[g] = at + 1
            done[s] = True
            s = prev[s]
    return order[1:]


# -- anchors -------------------------------------------------------------------------------------


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over each run of w values."""
    have = 1
    while 2 * have <= w:
        x = best(x[:-have], x[have:])
        have *= 2
    return best(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def fragments(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, windows, place of the anchor in it, anchor hash, fragment hash) of all fragments, as arrays.

    A fragment's ``windows`` windows begin at ``start`` and the places after it.  Long texts are cut
    into overlapping pieces of about PIECE bytes, which may cut a run of windows in two.
    """
    found, group, size = [], [], 0
    for i, raw in enumerate(texts):
        for a in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
            part = raw[a : a + PIECE + LENGTH - 1]
            group.append((i, a, part))
            size += len(part)
            if size >= PIECE:
                found.append(_fragments(group))
                group, size = [], 0
    if group:
        found.append(_fragments(group))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (*(np.zeros(0, np.int64),) * 4, *(np.zeros(0, np.uint64),) * 2)


def _fragments(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    size = np.array([len(p) for _, _, p in group])
    begin = np.cumsum(size) - size
    b = np.frombuffer(b"".join([p for _, _, p in group]), np.uint8)
    power, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(VALUE[b] * power[: len(b)], out=total[1:])
    h = mixed((total[ANCHOR:] - total[:-ANCHOR]) * inverse[: len(b) - ANCHOR + 1])
    low = np.uint64((1 << 24) - 1)  # hash first, then the place: the smallest is the first of the smallest hashes
    least = _sliding((h & ~low) | np.arange(len(h), dtype=np.uint64), SYMBOLS, np.minimum)
    count = size - LENGTH + 1
    start = ragged(begin, count)  # of every window that lies in one piece
    owner = np.repeat(np.arange(len(group)), count)
    anchor = (least[start] & low).astype(np.int64)
    first = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]).nonzero()[0]
    n = np.diff(np.append(first, len(start)))
    lo, at, own = start[first], anchor[first], owner[first]
    around = (total[lo + n + LENGTH - 1] - total[lo]) * inverse[lo] + (at - lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + n.astype(np.uint64)
    text, offset = (np.array([g[k] for g in group], np.int64) for k in (0, 1))
    return text[own], lo - begin[own] + offset[own], n, at - lo, h[at], mixed(around)


def _first_and_repeats(anchor, around, doc, pos):
    """Sort order, and whether each row in it starts a run of (anchor, around), or repeats an earlier occurrence."""
    order = np.lexsort((pos, doc, around, anchor))
    a, c, d, p = anchor[order], around[order], doc[order], pos[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, new, ~new & ((d != d[lead]) | (p != p[lead]))


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals united within each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    d, s, e = doc[order], start[order], end[order]
    out, at = [], 0
    bound = np.concatenate([[0], (d[1:] != d[:-1]).nonzero()[0] + 1, [len(d)]])
    for x, y in zip(bound, bound[1:], strict=False):
        far = np.maximum.accumulate(e[x:y])
        head = np.concatenate([[0], (s[x + 1 : y] > far[:-1]).nonzero()[0] + 1])
        tail = np.concatenate([head[1:] - 1, [y - x - 1]])
        out.append((np.full(len(head), d[x]), s[x:y][head], far[tail]))
        at += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _windows(rows: list[tuple[int, int, bytes, int, int]]) -> tuple[np.ndarray, ...]:
    """Of every window of ``rows`` of (doc, start, bytes, place of the anchor, key): document, place, whether it repeats an
    earlier one of the same key, and the row it is from; by suffix array, in which a key's anchor is one symbol."""
    symbols: list[int] = []
    keys: dict[int, int] = {}
    for _, _, raw, core, key in rows:
        symbols += [x + 1 for x in raw[:core]]
        symbols.append(257 + keys.setdefault(key, len(keys)))
        symbols += [x + 1 for x in raw[core + ANCHOR :]]
        symbols.append(0)
    flat = np.array(symbols, np.int32)
    size = np.array([len(r[2]) - ANCHOR + 2 for r in rows])
    begin = np.cumsum(size) - size
    place, row = np.arange(len(flat)) - np.repeat(begin, size), np.repeat(np.arange(len(rows)), size)
    doc, start = (np.array([r[i] for r in rows], np.int64)[row] for i in (0, 1))
    order = np.array(suffix_array(symbols), np.int64)
    order = order[place[order] + SYMBOLS < size[row[order]]]  # every such window holds its anchor
    if not len(order):
        return doc[:0], doc[:0], np.zeros(0, bool), doc[:0]
    view = np.lib.stride_tricks.sliding_window_view(flat, SYMBOLS)
    same = [(view[order[i : i + 4096]][: len(order) - 1 - i] == view[order[i + 1 : i + 4097]]).all(1) for i in range(0, len(order) - 1, 4096)]
    run = np.concatenate([[0], np.cumsum(~np.concatenate(same))]) if same else np.zeros(1, np.int64)
    d, p = doc[order], start[order] + place[order]
    by = np.lexsort((p, d, run))
    r, d, p = run[by], d[by], p[by]
    new = np.ones(len(r), bool)
    new[1:] = r[1:] != r[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    return d, p, ~new & ((d != d[lead]) | (p != p[lead])), row[order][by]


def repeated_windows(rows: list[tuple[int, int, bytes, int, int]]) -> list[tuple[int, int, int]]:
    """(doc, start, end) spans covered by windows that also lie earlier in ``rows``."""
    d, p, again, _ = _windows(rows)
    return list(zip(*(x.tolist() for x in _merged(d[again], p[again], p[again] + LENGTH)), strict=True))


# -- jobs ----------------------------------------------------------------------------------------

#: ``shape`` is 256 times the anchor's place in the fragment plus the number of windows; ``stop`` is -1 or ends a finished interval.
_NAMES = ("anchor", "around", "doc_id", "pos", "shape", "stop")
_KINDS = pa.schema([(n, pa.int64()) for n in _NAMES])
_SCHEMA = ", ".join(f"{n} long" for n in _NAMES)


def _occurrences(batches):
    """Fragment rows (stop -1) and finished intervals (stop set), one batch of texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            text, pos, n, core, anchor, around = fragments([t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
            if not len(text):
                continue
            doc, anchor, around, shape = part.column(0).to_numpy()[text], anchor.view(np.int64), around.view(np.int64), 256 * core + n
            order, new, again = _first_and_repeats(anchor, around, doc, pos)
            keep, rep = order[new], order[again]
            d, s, e = _merged(doc[rep], pos[rep], pos[rep] + n[rep] + LENGTH - 1)
            spread = mixed((d ^ (s << 40)).view(np.uint64)).view(np.int64)
            none = np.zeros(len(d), np.int64)
            columns = ((anchor[keep], spread), (around[keep], none), (doc[keep], d), (pos[keep], s), (shape[keep], none), (np.full(len(keep), -1), e))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], schema=_KINDS)


def _meet(batches):
    """Sorted fragment rows: later ones with a known fragment become intervals; anchors with several kinds stay as rows."""
    last = None  # the latest first-of-its-kind: (anchor, around, doc, pos, shape, told)
    for batch in batches:
        a, c, d, p, w, z = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        done = z >= 0
        outs = [(a[done], c[done], d[done], p[done], w[done], z[done])]
        a, c, d, p, w = (x[~done] for x in (a, c, d, p, w))
        if len(a):
            told = False
            if last is not None:
                told = last[5]
                a, c, d, p, w = (np.concatenate([[x], y]) for x, y in zip(last[:5], (a, c, d, p, w), strict=True))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
            lead = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
            again = ~new & ((d != d[lead]) | (p != p[lead]))
            again[0] = False
            outs.append((a[again], c[again], d[again], p[again], w[again], p[again] + w[again] % 256 + LENGTH - 1))
            heads = new.nonzero()[0]
            more = a[heads][1:] == a[heads][:-1]
            open_ = np.zeros(len(heads), bool)
            open_[1:] |= more
            open_[:-1] |= more
            final = bool(open_[-1]) or (told and len(heads) == 1)
            if told:
                open_[0] = False
            k = heads[open_]
            outs.append((a[k], c[k], d[k], p[k], w[k], np.full(len(k), -1)))
            h = heads[-1]
            last = (a[h], c[h], d[h], p[h], w[h], final)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in outs]).astype(np.int64)) for i in range(6)], schema=_KINDS)


def _agreement(parts: list[bytes]) -> list[int]:
    """Of each string, the longest beginning it shares with any other of them: with a neighbour in their order."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        a, b = parts[i], parts[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            mid = (low + high + 1) // 2
            if a[:mid] == b[:mid]:
                low = mid
            else:
                high = mid - 1
        out[i], out[j] = max(out[i], low), max(out[j], low)
    return out


def _shared_parts(key: int, group: dict[tuple[bytes, int], tuple[int, int]]) -> list[tuple[int, int, bytes, int, int]]:
    """(doc, start, bytes, place of the anchor, key) of each different fragment, cut to what can be shared: outside it no window repeats.

    All hold the same anchor; a fragment whose longest agreements left and right of it leave less than a window takes no part.
    """
    raws = list(group)
    left = _agreement([r[:c][::-1] for r, c in raws])
    right = _agreement([r[c + ANCHOR :] for r, c in raws])
    out = []
    for (raw, core), a, z in zip(raws, left, right, strict=True):
        if a + ANCHOR + z >= LENGTH:
            doc, start = group[raw, core]
            out.append((doc, start + core - a, raw[core - a : core + ANCHOR + z], a, key))
    return out


def _suffix_blocks(batches):
    """Rows of (key, salt, doc, start, core, bytes) sorted by all but the bytes: repeated windows within every key.

    Of equal fragments under a key the first stays and the others are repeats as a whole; keys with
    several different ones go into suffix arrays.  A key with a salt (0 or more) is only a part of
    its group and is cut at BLOCK: its blocks also give (doc, pos, -1, hash) of each window's earliest place.
    """
    kinds = pa.schema([("doc_id", pa.int64()), ("pos", pa.int64()), ("stop", pa.int64()), ("window", pa.int64())])
    held, size, key, group, hot_size = [], 0, None, {}, 0

    def rows(spans):
        return pa.RecordBatch.from_arrays([*(pa.array([s[i] for s in spans], pa.int64()) for i in range(3)), pa.nulls(len(spans), pa.int64())], schema=kinds)

    def part_of_hot():
        whole = [(doc, start, raw, core, 0) for (raw, core), (doc, start) in group.items()]
        d, p, again, row = _windows(whole)
        first = [
            hashlib.blake2b(whole[r][2][q - whole[r][1] : q - whole[r][1] + LENGTH], digest_size=8).digest() for r,
            q in zip(row[~again].tolist(), p[~again].tolist(), strict=True)
        ]
        yield rows(list(zip(*(x.tolist() for x in _merged(d[again], p[again], p[again] + LENGTH)), strict=True)))
        names = np.frombuffer(b"".join(first), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(d[~again]), pa.array(p[~again]), pa.array(np.full(len(first), -1)), pa.array(names, pa.int64())], schema=kinds)

    def close():
        nonlocal held, size
        if len(group) > 1:
            parts = _shared_parts(key[0], group)
            held += parts
            size += sum(len(p[2]) - ANCHOR + 2 for p in parts)

    for batch in batches:
        whole = []
        for k, salt, doc, start, core, raw in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (k, salt) != key or (salt >= 0 and hot_size >= BLOCK):
                if key and key[1] >= 0:
                    yield from part_of_hot()
                else:
                    close()
                key, group, hot_size = (k, salt), {}, 0
                if size >= BLOCK:
                    yield rows(repeated_windows(held))
                    held, size = [], 0
            first = group.setdefault((raw, core), (doc, start))
            if first != (doc, start):
                whole.append((doc, start, start + len(raw)))
            else:
                hot_size += len(raw)
        yield rows(whole)
    if key and key[1] >= 0:
        yield from part_of_hot()
    else:
        close()
    if held:
        yield rows(repeated_windows(held))


def repeated_intervals(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, stop) byte intervals, as a table, that together cover all repeated windows of a narrow input."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    met = written(
        docs.select("doc_id", "text").mapInArrow(_occurrences, _SCHEMA).repartition("anchor").sortWithinPartitions("anchor", "around", "doc_id", "pos").mapInArrow(_meet, _SCHEMA),
        "sa-met"
    )
    open_ = met.where("stop < 0").select("anchor", "doc_id", "pos", "shape")
    hot = open_.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)  # at most one in HOT rows
    hot = written(hot.select("anchor", F.ceil(F.col("n") / HOT).cast("long").alias("salts")), "sa-hot")
    dealt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(-1)).alias("salt")
    open_ = open_.join(F.broadcast(hot) if hot.count() <= BROADCAST_ANCHORS else hot, "anchor", "left").select("anchor", "doc_id", "pos", "shape", dealt)
    wanted = open_.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "pos", "shape", "salt")).alias("at"))  # at most a document's bytes

    def surroundings(x):
        out = {"key": [], "salt": [], "doc_id": [], "start": [], "core": [], "part": []}
        for doc, text, at in zip(x["doc_id"], x["text"], x["at"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for row in at:
                core, n = divmod(row["shape"], 256)
                for name, value in (
                    ("key", row["anchor"]), ("salt", row["salt"]), ("doc_id", doc), ("start", row["pos"]), ("core", core),
                    ("part", raw[row["pos"] : row["pos"] + n + LENGTH - 1])
                ):
                    out[name].append(value)
        return out

    parts = map_batches(docs.select("doc_id", "text").join(wanted, "doc_id"), surroundings, "key long, salt long, doc_id long, start long, core int, part binary")
    edges = written(
        parts.repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "start").mapInArrow(_suffix_blocks, "doc_id long, pos long, stop long, window long"),
        "sa-edges"
    )
    spans = met.where("stop >= 0").select("doc_id", "pos", "stop").unionByName(edges.where("stop >= 0").drop("window"))
    if hot.isEmpty():
        return spans
    place = F.struct("doc_id", "pos")
    named = edges.where("stop < 0").select("window", "doc_id", "pos")
    first = named.groupBy("window").agg(F.min(place).alias("first"))
    later = named.join(first, "window").where(place != F.col("first"))  # a block names a window once
    return spans.unionByName(later.select("doc_id", "pos", (F.col("pos") + LENGTH).alias("stop")))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept`` bytes).

    Rows that share id and text are one document; texts that share an id only are documents of their
    own, in the order of their text.  Texts under 100 bytes, empty and null ones lose nothing.
    """
    docs = unique_ids(narrow(df, id_col, text_col))
    spans = repeated_intervals(docs).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "stop")).alias("spans"))
    rows = docs.join(spans, "doc_id", "left").select("given_id", "text", "spans")

    def run(x):
        out = {"doc_id": x["given_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, spans in zip(x["text"], x["spans"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            runs: list[list[int]] = []
            for a, z in sorted((s["pos"], min(s["stop"], len(raw))) for s in spans or ()):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], z)
                else:
                    runs.append([a, z])
            edge = [0, *(v for r in runs for v in r), len(raw)]
            kept = b"".join(raw[a:z] for a, z in zip(edge[::2], edge[1::2], strict=True))
            for name, value in (
                ("n_bytes", len(raw)), ("n_removed", len(raw) - len(kept)), ("n_spans", len(runs)), ("kept_sha256", hashlib.sha256(kept).hexdigest()),
                ("kept", kept if keep_text else None)
            ):
                out[name].append(value)
        return out

    done = map_batches(
        rows, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ).select(real_id(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
    return done if keep_text else done.drop("kept")
