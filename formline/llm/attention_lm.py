"""Language-model scores from a causal self-attention model over subword ids, and from what the corpus repeats.

The model is a causal self-attention layer with learned embeddings of subword ids and an adaptive
softmax over the whole vocabulary: the commonest ids stand in the head, the next ones in classes,
and the rest share one tail in which only counts tell them apart.  Counts enter as the outputs'
first biases, nowhere else.  ``AttentionLM`` says it in numpy, and the same arithmetic runs as one graph
(``attention_net``).  It is trained on all windows of all training texts: it begins on
the driver with a bounded draw of them, then every task carries it on over every window of its texts,
in rounds that each take a share of the windows, and the results are averaged by Spark.  Beyond
``FIRST_WINDOWS`` windows the parameters depend a little on how the texts are dealt over tasks.

A text is its ASCII-lower-cased words, as the base takes them, each encoded with a space before it, and
an end.  Words are counted by a 64-bit hash.  A text is scored in windows of ``WINDOW`` ids that overlap by ``OVERLAP``; each id is scored once, in
the window in which it has most context.

Long repeats: at ``ANCHOR`` ids whose hash says so (one place in ``SPREAD``), what follows up to the
next such place is also looked up in a table of what followed these ids in other training texts.
With c of C other occurrences agreeing, the passage's probability is (c + p) / (C + 1), p being the
attention model's.  The table is a Spark aggregate over all training texts and grows with them.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm import attention_net
from formline.llm.byte_bpe import ByteBPE
from formline.llm.common import NULL_ID, commonest, keep_freed_memory, narrow, real_id, written
from formline.llm.rolling import Words, mixed, ragged

WINDOW, OVERLAP = 32, 4
WIDTH, INNER = 16, 32
#: Levels of the output as (head, classes, ids of a class): the commonest ids stand in the first level's head, the next in
#: its classes, and so on; each level's last choice leads to the next one, and after the last to the tail.
LEVELS = ((32, 16, 32), (0, 64, 64))
SLOTS = sum(h + c * k for h, c, k in LEVELS)
ANCHOR, SPREAD = 16, 64
#: The driver begins with at most FIRST_WINDOWS, FIRST_EPOCHS times over, and with fewer up to MOST_EPOCHS times.
FIRST_WINDOWS, FIRST_EPOCHS, MOST_EPOCHS = 16_384, 5, 12
#: Rounds over all windows, windows that a task holds at once, and windows of a step on the driver and in a task.
ROUNDS, HELD_WINDOWS, STEP_WINDOWS, TASK_STEP = 2, 16_384, 96, 384
#: Words whose counts travel with the tasks (some megabytes); all other words are joined with the table of counts.
COMMON_WORDS = 100_000
#: Distinct words a task holds before it sends their counts on.
COUNTED = 1_000_000
#: Texts that are taken apart together.
TEXTS = 256
#: Passages that more rows than this share are joined by broadcast, if there are at most BROADCAST_ROWS of them.
HOT, BROADCAST_ROWS = 4096, 200_000
#: Rows of the output that are held at once, when scored and when trained on: small enough for the processor's cache.
CACHED, CACHED_STEP = 4096, 1024
#: Parameters that the network knows by their products alone.
PAIRED = ("wq", "wk", "wv", "wo")
#: Rows of a block, all of one class, of each level.
ROWS = (32, 8)
#: Numbers in a block when tasks' arrays are summed, and over how many groups a block's rows are dealt first.
BLOCK, SALTS = 2048, 64
LOG10 = np.log(10.0)


def held_out():
    """True for documents that are not learned from: crc32 of the id as text, mod 10, is 0."""
    return F.crc32(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id").cast("string")).otherwise("").cast("binary")) % 10 == 0


# -- counts --------------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """Table of (word, c) over all texts of a narrow input; words are hashes."""

    def run(batches):
        held, size = [], 0

        def rows():
            word, c = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 2
            word, at = np.unique(word, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(np.bincount(at, weights=c, minlength=len(word)).astype(np.int64))], names=["word", "c"])

        keep_freed_memory()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                held.append(np.unique(Words(batch.column(0).slice(at, TEXTS).to_pylist()).hash, return_counts=True))
                size += len(held[-1][0])
                if size > COUNTED:
                    yield rows()
                    held, size = [], 0
        yield rows()

    train.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return written(train.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "words")


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the tasks' arrays of ``size`` numbers, given as blocks (block int, salt int, v binary of float64)."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v = np.frombuffer(raw)
                held[block] = held[block] + v if block in held else v
        yield pa.RecordBatch.from_pydict({"block": list(held), "salt": [0] * len(held), "v": [v.tobytes() for v in held.values()]}, schema=_BLOCKS)

    kind = "block int, salt int, v binary"
    out = np.zeros(size)
    for r in rows.repartition("block", "salt").mapInArrow(add, kind).repartition("block").mapInArrow(add, kind).collect():  # ``size`` numbers
        v = np.frombuffer(r.v)
        out[r.block * BLOCK : r.block * BLOCK + len(v)] += v
    return out


_BLOCKS = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("v", pa.binary())])


def blocks_of(v: np.ndarray, salt: int) -> pa.RecordBatch:
    cut = range(0, len(v), BLOCK)
    return pa.RecordBatch.from_pydict(
        {"block": list(range(len(cut))), "salt": [salt % SALTS] * len(cut), "v": [v[i : i + BLOCK].astype(np.float64).tobytes() for i in cut]},
        schema=_BLOCKS
    )


# -- the network ---------------------------------------------------------------------------------


class Slots:
    """Where each subword id stands in the output, by the corpus's counts; ties by id."""

    def __init__(self, counts: np.ndarray) -> None:
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.of = np.full(len(counts), SLOTS, np.int32)
        self.of[order[:SLOTS]] = np.arange(min(SLOTS, len(counts)))
        weight = counts + 0.1
        self.tail = np.where(self.of == SLOTS, np.log(weight / max(weight[self.of == SLOTS].sum(), 1e-9)), 0.0).astype(np.float32)
        by = np.bincount(self.of, weights=weight, minlength=SLOTS + 1) + 1e-3
        self.bias = []
        for start, (h, c, k) in zip(STARTS, LEVELS, strict=True):
            kids = by[start + h : start + h + c * k].reshape(c, k)
            first = np.concatenate([by[start : start + h], kids.sum(1), [by[start + h + c * k :].sum()]])
            self.bias.append((np.log(first / first.sum()), np.log(kids / kids.sum(1, keepdims=True))))


STARTS = [sum(h + c * k for h, c, k in LEVELS[:i]) for i in range(len(LEVELS))]


class AttentionLM:
    """Parameters as a dict of float32 arrays; ids are slots."""

    def __init__(self, slots: Slots, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        g = lambda *s, scale=1.0: (rng.standard_normal(s) * scale / np.sqrt(s[-2])).astype(np.float32)
        self.p = {
            "emb": (rng.standard_normal((SLOTS + 1, WIDTH)) * 0.5).astype(np.float32), "pos": (rng.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32),
            "wq": g(WIDTH, WIDTH, scale=WIDTH**-0.5), "wk": g(WIDTH, WIDTH), "wv": g(WIDTH, WIDTH), "wo": g(WIDTH, WIDTH, scale=0.5),
            "w1": g(WIDTH, INNER), "b1": np.zeros(INNER, np.float32), "w2": g(INNER, WIDTH, scale=0.5),
        }
        for i, ((h, c, k), (first, kids)) in enumerate(zip(LEVELS, slots.bias, strict=True)):
            self.p |= {f"wh{i}": g(WIDTH, h + c + 1, scale=0.3), f"bh{i}": first.astype(np.float32), f"wc{i}": g(c, WIDTH, k, scale=0.2), f"bc{i}": kids.astype(np.float32)}
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> AttentionLM:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def body(self, slots: np.ndarray):
        """What each place of (windows, time) knows of itself and of the places before it."""
        p, (b, t) = self.p, slots.shape
        x = p["emb"].take(slots, axis=0)
        x += p["pos"][:t]
        flat = x.reshape(-1, WIDTH)
        q, k, v = ((flat @ p[w]).reshape(b, t, WIDTH) for w in ("wq", "wk", "wv"))
        s = np.matmul(q, np.ascontiguousarray(k.transpose(0, 2, 1)))
        np.clip(s, -60, 60, out=s)
        s += self.mask[:t, :t]
        np.exp(s, out=s)
        s /= (s.reshape(-1, t) @ np.ones(t, s.dtype)).reshape(b, t, 1)
        c = np.matmul(s, v)
        y = flat + c.reshape(-1, WIDTH) @ p["wo"]
        u = y @ p["w1"]
        u += p["b1"]
        np.clip(u, 0, None, out=u)
        return y + u @ p["w2"], (x, q, k, v, s, c, y, u)

    def log_probs(self, z: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probabilities of target slots, of the tail as a whole where a target is in it."""
        out = np.zeros(len(target), z.dtype)
        for i, rows, first, inner, own, classes in self._levels(target):
            here = z if len(rows) == len(z) else z[rows]
            got = np.empty(len(rows), z.dtype)
            for at in range(0, len(rows), CACHED):
                part = np.s_[at : at + CACHED]
                got[part] = self._chosen(here[part] @ self.p[f"wh{i}"], self.p[f"bh{i}"], first[part])
            out[rows] += got
            here, got = z[inner], np.empty(len(inner), z.dtype)
            for c, a, b in classes:
                for at in range(a, b, CACHED):
                    part = np.s_[at : min(at + CACHED, b)]
                    got[part] = self._chosen(here[part] @ self.p[f"wc{i}"][c], self.p[f"bc{i}"][c], own[part])
            out[inner] += got
        return out

    @staticmethod
    def _chosen(h: np.ndarray, bias: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Log probability of one choice of each row."""
        h += bias
        np.clip(h, -60, 60, out=h)
        out = h.take(np.arange(len(h)) * h.shape[1] + which)
        np.exp(h, out=h)
        return out - np.log(h @ np.ones(h.shape[1], h.dtype))

    @staticmethod
    def _levels(target: np.ndarray):
        """Of each level: the rows that reach it, their choice there; those in a class, by class, their place in it, and (class, begin, end) among them."""
        rows = np.arange(len(target))
        for i, (start, (h, c, k)) in enumerate(zip(STARTS, LEVELS, strict=True)):
            at = target[rows] - start
            first = np.where(at < h, at, np.minimum(h + (at - h) // k, h + c))
            inner = ((at >= h) & (first < h + c)).nonzero()[0]
            kind = (first[inner] - h).astype(np.uint8)
            order = np.argsort(kind, kind="stable")
            inner, kind = inner[order], kind[order]
            edges = [0, *((kind[1:] != kind[:-1]).nonzero()[0] + 1).tolist(), len(kind)]
            yield i, rows, first, rows[inner], (at[inner] - h) % k, [(int(kind[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a]
            rows = rows[first == h + c]

    def loss_and_grad(self, slots: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """Mean negative log-likelihood of the targets that count, and its gradient."""
        p, (z, (x, q, k, v, s, c, y, u)), (b, t) = self.p, self.body(slots), slots.shape
        w = (weight.reshape(-1) / max(float(weight.sum()), 1.0)).astype(z.dtype)
        counted = w.nonzero()[0]  # the other places cost nothing: no output is made for them
        w, target, known = w[counted], target.reshape(-1)[counted], z[counted]
        loss, back, g = 0.0, np.zeros_like(known), {}

        def choice(z, w, which, weights, bias):
            """Gradients of weights and bias, and of z, of one choice of each row, CACHED_STEP rows at a time."""
            nonlocal loss
            dz, dw, db, turned = np.empty_like(z), np.zeros_like(weights), np.zeros_like(bias), np.ascontiguousarray(weights.T)
            one = np.ones(max(CACHED_STEP, len(bias)), z.dtype)
            for at in range(0, len(z), CACHED_STEP):
                part = np.s_[at : at + CACHED_STEP]
                own, own_w = z[part], w[part]
                e = own @ weights
                e += bias
                np.clip(e, -60, 60, out=e)
                chosen = np.arange(len(e)) * e.shape[1] + which[part]
                of = e.take(chosen)
                np.exp(e, out=e)
                total = e @ one[: e.shape[1]]
                loss -= float(own_w @ (of - np.log(total)))
                e *= (own_w / total)[:, None]
                e.reshape(-1)[chosen] -= own_w
                np.matmul(e, turned, out=dz[part])
                dw += own.T @ e
                db += one[: len(e)] @ e
            return dw, db, dz

        for i, rows, first, inner, own, classes in self._levels(target):
            every = len(rows) == len(known)
            g[f"wh{i}"], g[f"bh{i}"], dz = choice(known if every else known[rows], w if every else w[rows], first, p[f"wh{i}"], p[f"bh{i}"])
            if every:
                back += dz
            else:
                back[rows] += dz
            g[f"wc{i}"], g[f"bc{i}"] = np.zeros_like(p[f"wc{i}"]), np.zeros_like(p[f"bc{i}"])
            here, of, dz = known[inner], w[inner], np.empty((len(inner), WIDTH), z.dtype)
            for kind, a, e in classes:
                g[f"wc{i}"][kind], g[f"bc{i}"][kind], dz[a:e] = choice(here[a:e], of[a:e], own[a:e], p[f"wc{i}"][kind], p[f"bc{i}"][kind])
            back[inner] += dz
        dz = np.zeros_like(z)
        dz[counted] = back
        du = (dz @ p["w2"].T) * (u > 0)
        g |= {"w2": u.T @ dz, "w1": y.T @ du, "b1": du.sum(0)}
        dy = dz + du @ p["w1"].T
        g["wo"] = c.reshape(-1, WIDTH).T @ dy
        dc = (dy @ p["wo"].T).reshape(b, t, WIDTH)
        ds, dv = np.matmul(dc, np.ascontiguousarray(v.transpose(0, 2, 1))), np.matmul(s.transpose(0, 2, 1), dc)
        ds -= (dc * c) @ np.ones((WIDTH, 1), z.dtype)  # the mean of ds under s
        ds *= s
        dq, dk = np.matmul(ds, k), np.matmul(ds.transpose(0, 2, 1), q)
        flat, dx = x.reshape(-1, WIDTH), dy
        for name, d in (("wq", dq), ("wk", dk), ("wv", dv)):
            d = d.reshape(-1, WIDTH)
            g[name] = flat.T @ d
            dx = dx + d @ p[name].T
        g["pos"] = np.zeros_like(p["pos"])
        g["pos"][:t] = dx.reshape(b, t, WIDTH).sum(0)
        at = (slots.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
        g["emb"] = np.bincount(at, weights=dx.ravel(), minlength=p["emb"].size).reshape(p["emb"].shape).astype(z.dtype)
        return loss, g

    def outputs(self, slots: np.ndarray, target: np.ndarray, counted: np.ndarray, learns: bool = False) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """``log_probs`` of the targets at the counted places of whole windows, and if it learns the gradient of their summed loss, by ``attention_net``."""
        run, names = attention_net.network(WINDOW, WIDTH, INNER, LEVELS, SLOTS + 1, learns)
        p, dealt = self.p, []
        feed = {k: v for k, v in p.items() if k not in PAIRED} | {"wa": p["wq"] @ p["wk"].T, "wm": p["wv"] @ p["wo"], "slot": slots.astype(np.int64), "counted": counted}
        for i, rows, first, inner, own, classes in self._levels(target.astype(np.int64)):
            kind, begin, end = np.array(classes or [(0, 0, 0)]).T
            n = np.maximum(-(-(end - begin) // ROWS[i]), 1)
            start = np.cumsum(n) - n
            place = ragged(start * ROWS[i], end - begin)
            at, which, of = (np.zeros(int(n.sum()) * ROWS[i], k) for k in (np.int64, np.int64, np.float32))  # what is not dealt has weight 0
            at[place], which[place], of[place] = inner, own, 1
            feed |= {f"kind{i}": np.repeat(kind, n), f"at{i}": at.reshape(-1, ROWS[i]), f"of_own{i}": of.reshape(-1, ROWS[i], 1)}
            feed[f"own{i}"] = which + np.arange(len(which)) * LEVELS[i][2]
            if i:  # no input is empty
                some = (rows, first, np.ones(len(rows), np.float32)) if len(rows) else (*np.zeros((2, 1), np.int64), np.zeros(1, np.float32))
                feed[f"rows{i}"], first, feed[f"of{i}"] = some[0], some[1], some[2][:, None]
            feed[f"first{i}"] = first + np.arange(len(first)) * (sum(LEVELS[i][:2]) + 1)
            dealt.append((i, rows, inner, place, kind, start))
        g, out = dict(zip((n.removeprefix("d_") for n in names), run.run(names, feed), strict=True)), np.zeros(len(target), np.float32)
        for i, rows, inner, place, kind, start in dealt:
            out[rows] += g.pop(f"lp_first{i}")[: len(rows)]
            out[inner] += g.pop(f"lp_own{i}")[place]
            for name in (f"wc{i}", f"bc{i}") if learns else ():
                total = np.zeros_like(p[name])
                total[kind] = np.add.reduceat(g[name], start, axis=0)
                g[name] = total
        if learns:
            wa, wm = g.pop("wa"), g.pop("wm")
            g |= {"wq": wa @ p["wk"], "wk": wa.T @ p["wq"], "wv": wm @ p["wo"].T, "wo": p["wv"].T @ wm}
        return out, g

    def step(self, slots: np.ndarray, target: np.ndarray, weight: np.ndarray):
        """``loss_and_grad`` of windows whose places have weight 1 or 0, by ``attention_net``."""
        counted = weight.reshape(-1).nonzero()[0]
        if not len(counted):
            return self.loss_and_grad(slots, target, weight)
        lp, grad = self.outputs(slots, target.reshape(-1)[counted], counted, learns=True)
        for g in grad.values():
            g *= np.float32(1 / len(counted))
        return -float(lp.mean()), grad

    def fit(self, ids: np.ndarray, targets: np.ndarray, weight: np.ndarray, epochs: int, rate: float, seed: int = 9, size: int = STEP_WINDOWS) -> float:
        """Adam with a rate that rises for a few steps and then falls; returns the last epoch's mean loss."""
        keep_freed_memory()
        rng, step, losses = np.random.default_rng(seed), 0, [0.0]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        steps = epochs * -(-len(ids) // size)
        for _ in range(epochs):
            order, losses = rng.permutation(len(ids)), []
            for at in range(0, len(order), size):
                part = order[at : at + size]
                loss, grad = self.step(ids[part], targets[part], weight[part])
                losses.append(loss)
                own = rate * min(1.0, (step + 1) / 40) * (0.05 + 0.475 * (1 + np.cos(np.pi * step / steps)))
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    g *= g
                    g -= v[k]
                    g *= 0.02
                    v[k] += g
                    np.sqrt(np.divide(v[k], 1 - 0.98**step, out=g), out=g)
                    g += 1e-7
                    np.divide(m[k], g, out=g)
                    g *= own / (1 - 0.9**step)
                    self.p[k] -= g
        return float(np.mean(losses))


# -- texts as ids --------------------------------------------------------------------------------


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n targets: each but the first repeats OVERLAP ids of the one before."""
    return np.arange(0, max(n - OVERLAP, 1), WINDOW - OVERLAP)


def fresh(at: np.ndarray, stop, first) -> np.ndarray:
    """Which places of windows (rows of ``at``) are scored there: inside the text, and not in the window before."""
    return (at < np.reshape(stop, (-1, 1))) & ((np.arange(at.shape[1]) >= OVERLAP) | np.reshape(first, (-1, 1)))


def passages(docs: list[np.ndarray]):
    """(document, key, passage hash, first and end place in all ids) of what follows each anchor, over texts with their edges.

    An anchor is ANCHOR ids in a row, none of them the first edge, whose hash falls in one of SPREAD;
    the passage goes on to the next anchor's end or the text's.
    """
    ids, size = np.concatenate(docs), np.array([len(d) for d in docs])
    start = np.cumsum(size) - size
    value = mixed(ids.astype(np.uint64) + np.uint64(1))
    h, k = value, 1
    while k < ANCHOR:  # hash of 2k ids from those of k
        h, k = np.concatenate([h[:k], h[k:] + h[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k)]), 2 * k
    h = mixed(h)
    owner = np.repeat(np.arange(len(docs)), size)
    at = ((h % np.uint64(SPREAD) == 0) & (np.arange(len(ids)) - start[owner] >= ANCHOR)).nonzero()[0]
    at = at[at + 1 < (start + size)[owner[at]]]
    doc = owner[at]
    stop = np.minimum(np.append(at[1:] + 1, len(ids)), (start + size)[doc])
    if not len(at):
        return doc, at, at, at, stop
    far = np.arange(len(ids), dtype=np.uint64) - np.repeat(np.concatenate([[0], at + 1]), np.diff(np.concatenate([[0], at + 1, [len(ids)]]))).astype(np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(value + far * np.uint64(0xA24BAED4963EE407)), dtype=np.uint64)])
    follow = mixed(total[stop] - total[at + 1] + (stop - at).astype(np.uint64))
    return doc, h[at].view(np.int64), follow.view(np.int64), at + 1, stop


class Scorer:
    """Natural log probabilities of every id of whole texts (edge, ids, edge) given as arrays."""

    def __init__(self, slots: Slots, model: AttentionLM) -> None:
        self.slots, self.model = slots, model

    def ids(self, docs: list[np.ndarray]) -> np.ndarray:
        """Of all targets (each text's ids but the first), one text after the other."""
        n = np.array([len(d) - 1 for d in docs])
        base = np.cumsum(n + 1) - (n + 1)
        every = np.concatenate(docs)
        slot = self.slots.of[every]
        cut = [windows(k) for k in n]
        start = np.concatenate([c + b for c, b in zip(cut, base, strict=True)])
        stop = np.repeat(base + n, [len(c) for c in cut])
        first = np.concatenate([c == 0 for c in cut])
        out = []
        for a in range(0, len(start), TASK_STEP):
            part = np.s_[a : a + TASK_STEP]
            at = start[part, None] + np.arange(WINDOW)
            counted = fresh(at, stop[part], first[part])
            goal, places = at[counted] + 1, counted.ravel().nonzero()[0]
            lp, _ = self.model.outputs(slot.take(np.minimum(at, len(slot) - 1)), slot[goal], places)
            out.append(lp + self.slots.tail[every[goal]])
        return np.concatenate(out)


class Encoder:
    """Ids of texts' words; the common ones are encoded once per worker."""

    def __init__(self, bpe: ByteBPE, common: np.ndarray) -> None:
        self.bpe, self.common = bpe, common  # different hashes
        self.table = np.full(1 << max(4, int(4 * len(common)).bit_length()), -1, np.int32)  # a common word stands at its hash's last bits, or next to what stands there
        rest, slot = np.arange(len(common)), self._slot(common)
        while len(rest):
            free = self.table[slot] < 0
            self.table[slot[free]] = rest[free]
            left = self.table[slot] != rest
            rest, slot = rest[left], (slot[left] + 1) % len(self.table)
        self.at, self.size = np.full(len(common), -1), np.zeros(len(common), np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int64), 0
        self.begins = np.array([bpe.decode([i])[:1] == b" " for i in range(len(bpe.decimal))])

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Of each word its place among the common ones, and whether it is one."""
        slot = self._slot(words.hash)
        at = self.table[slot]
        if not len(self.common):
            return np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        known = (self.common[at] == words.hash) & (at >= 0)
        rest = (~known & (at >= 0)).nonzero()[0]
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.table)
            at[rest] = self.table[slot[rest]]
            known[rest] = (self.common[at[rest]] == words.hash[rest]) & (at[rest] >= 0)
            rest = rest[~known[rest] & (at[rest] >= 0)]
        return np.maximum(at, 0), known

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return h & (len(self.table) - 1)

    def new(self, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per word) of chosen words, encoded together: a space starts each and stands nowhere else."""
        if not len(which):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ids = np.array(self.bpe.encode(words.joined(which).decode("utf-8", "replace")), np.int64)
        first = self.begins[ids].nonzero()[0]
        if len(first) == len(which) and not first[0]:
            return ids, np.diff(np.append(first, len(ids)))
        if len(which) > 1:  # some word begins otherwise, such as by white space beyond ASCII
            one, two = self.new(words, which[: len(which) // 2]), self.new(words, which[len(which) // 2 :])
            return tuple(np.concatenate(x) for x in zip(one, two, strict=True))
        return ids, np.array([len(ids)])

    def __call__(self, words: Words, at: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        fresh = known & (self.at[at] < 0) if len(self.common) else known
        _, first, group = np.unique(words.hash[~known | fresh], return_index=True, return_inverse=True)
        which = (~known | fresh).nonzero()[0]
        ids, size = self.new(words, which[first])
        start, n, source = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), ids
        if len(which):
            begin = np.cumsum(size) - size
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int64)])
            keep = fresh[which[first]].nonzero()[0]
            took = ragged(begin[keep], size[keep])
            self.flat[self.used : self.used + len(took)] = ids[took]
            place = at[which[first]][keep]
            self.at[place], self.size[place] = self.used + np.cumsum(size[keep]) - size[keep], size[keep]
            self.used += len(took)
            start[which], n[which] = begin[group] + self.used, size[group]
        old = known & ~fresh
        start[old], n[old] = self.at[at[old]], self.size[at[old]]
        source = np.concatenate([self.flat[: self.used], ids])
        return source[ragged(start, n)], n


_ENCODERS: dict[str, Encoder] = {}


def encode(docs: DataFrame, codec, edge: int, words: DataFrame, base) -> DataFrame:
    """Table of each text's ids and edges, and of what the common words add to its base; the other words and their counts beside."""
    rows = sorted(commonest(words, COMMON_WORDS))  # bounded
    shared = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, np.array([r[0] for r in rows], np.int64), base(np.array([r[1] for r in rows], np.float64))))
    number = np.uint32 if edge > 65_535 else np.uint16
    lists = {"words": pa.int64(), "times": pa.int32()}
    kinds = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                       ("base", pa.float64()), *((k, pa.list_(v)) for k, v in lists.items())])

    def run(batches):
        keep_freed_memory()
        key, common, value = shared.value
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(codec(), common)
        encoder = _ENCODERS[key]
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                own = Words(part.column(3).to_pylist())
                at, known = encoder.find(own)
                ids, size = encoder(own, at, known)
                cut = np.searchsorted(own.doc, np.arange(own.n_docs + 1))
                stop = np.concatenate([[0], np.cumsum(size)])[cut].tolist()
                ids = ids.astype(number)
                ends = np.array([edge], number).tobytes()
                added = np.bincount(own.doc[known], weights=value[at[known]], minlength=own.n_docs) if len(value) else np.zeros(own.n_docs)
                doc, word = own.doc[~known], own.hash[~known]
                order = np.lexsort((word, doc))
                doc, word = doc[order], word[order]
                first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])])[: len(doc)].nonzero()[0]
                times = np.diff(np.append(first, len(doc)))
                offsets = pa.array(np.searchsorted(doc[first], np.arange(own.n_docs + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array([ends + ids[x:y].tobytes() + ends for x, y in zip(stop, stop[1:], strict=False)], pa.binary()),
                    pa.array(np.diff(cut) + 1), pa.array(np.bincount(own.doc[known], minlength=own.n_docs)), pa.array(added),
                    *(pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in zip((word[first], times), lists.values(), strict=True)),
                ], schema=kinds)

    return written(
        docs.select("doc_id", "th", "held_out", "text").mapInArrow(
            run, "doc_id long, th long, held_out boolean, ids binary, n_tokens long, n_known long, base double, words array<long>, times array<int>"
        ),
        "ids"
    )


def _arrays(column, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column.to_pylist()]


def id_counts(train: DataFrame, kind: str, size: int) -> np.ndarray:
    """How often each id stands in the training texts, their last edges included."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            docs = _arrays(batch.column(0), kind)
            total += np.bincount(np.concatenate(docs), minlength=size)
            total[docs[0][0]] -= len(docs)  # the first edges
        yield blocks_of(total, int(total.sum()))

    return summed(train.select("ids").mapInArrow(run, "block int, salt int, v binary"), size)


def seeded(train: DataFrame) -> DataFrame:
    """(seed, ids) of the training texts: the seed is of id and text, so copies of a text give different windows."""
    return train.select(F.xxhash64("doc_id", "th").alias("seed"), "ids")


def n_windows(train: DataFrame, kind: str) -> int:
    """How many windows the texts have."""
    targets = F.length("ids") / np.dtype(kind).itemsize - 1
    return train.agg(F.sum(F.ceil(F.greatest(targets - OVERLAP, F.lit(1)) / (WINDOW - OVERLAP)))).first()[0] or 0


def windows_of(batches, kind: str, chosen):
    """(h, first, ids) of those windows of (seed, ids) batches whose hash is ``chosen``; ids have one more than the window."""
    for batch in batches:
        for seed, d in zip(batch.column(0).to_pylist(), _arrays(batch.column(1), kind), strict=True):
            start = windows(len(d) - 1)
            h = mixed(np.uint64(seed & (2**64 - 1)) + start.astype(np.uint64))
            for i in chosen(h).nonzero()[0]:
                yield int(h[i].view(np.int64)), bool(i == 0), d[start[i] : start[i] + WINDOW + 1].tobytes()


def first_windows(train: DataFrame, kind: str, n: int) -> list[tuple]:
    """At most FIRST_WINDOWS of the n windows, all if they are no more; the draw is by hash, so tasks send no more than that."""
    share = np.uint64(2**32 if n <= FIRST_WINDOWS else int(2**32 * 0.95 * FIRST_WINDOWS / n))
    kinds = pa.schema([("h", pa.int64()), ("first", pa.bool_()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = list(windows_of([batch], kind, lambda h: (h >> np.uint64(32)) < share))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k.type) for i, k in enumerate(kinds)], schema=kinds)

    drawn = seeded(train).mapInArrow(run, "h long, first boolean, ids binary").limit(FIRST_WINDOWS)
    return [(r.h, r.first, bytes(r.ids)) for r in drawn.collect()]  # bounded: about a megabyte and a half


def held_windows(batches, kind: str, chosen):
    """The windows of ``windows_of`` as arrays (h, first, number of ids, ids), HELD_WINDOWS at a time."""
    held, n = [], 0
    for batch in batches:
        docs = _arrays(batch.column(1), kind)
        ids, size = np.concatenate(docs), np.array([len(d) for d in docs])
        base, cut = np.cumsum(size) - size, -(-np.maximum(size - 1 - OVERLAP, 1) // (WINDOW - OVERLAP))
        doc = np.repeat(np.arange(len(docs)), cut)
        start = ragged(np.zeros(len(cut), np.int64), cut) * (WINDOW - OVERLAP)
        h = mixed(batch.column(0).to_numpy().view(np.uint64)[doc] + start.astype(np.uint64))
        of = chosen(h).nonzero()[0]
        for a in range(0, len(of), HELD_WINDOWS):
            part = of[a : a + HELD_WINDOWS]
            at = (base[doc[part]] + start[part])[:, None] + np.arange(WINDOW + 1)
            held.append((h[part].view(np.int64), start[part] == 0, np.minimum(size[doc[part]] - start[part], WINDOW + 1), ids.take(np.minimum(at, len(ids) - 1))))
            n += len(part)
            if n >= HELD_WINDOWS:
                every = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield [x[:HELD_WINDOWS] for x in every]
                held, n = [[x[HELD_WINDOWS:] for x in every]], n - HELD_WINDOWS
    if n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def framed(slots: Slots, h: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and weights of windows, in the order of h."""
    order, place = np.argsort(h, kind="stable"), np.arange(WINDOW + 1)
    first, n = first[order, None], size[order, None] - 1
    grid = slots.of.take(ids[order]) * (place <= n)
    inside = place[:-1] < n
    return grid[:, :-1] * inside, grid[:, 1:].copy(), (inside & ((place[:-1] >= OVERLAP) | first)).astype(np.float32)


def as_batch(slots: Slots, rows: list[tuple], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``framed`` of (h, first, ids) rows."""
    size = np.array([len(r[2]) for r in rows], np.int64) // np.dtype(kind).itemsize
    ids = np.zeros((len(rows), WINDOW + 1), kind)
    ids[np.arange(WINDOW + 1) < size[:, None]] = np.frombuffer(b"".join(r[2] for r in rows), kind)
    return framed(slots, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], bool), size, ids)


def carried_on(batches, slots: Slots, start: AttentionLM, kind: str, chosen, rate: float) -> tuple[AttentionLM, int]:
    """The model after one pass over all chosen windows of a task's texts, HELD_WINDOWS at a time, and their number."""
    model, n = AttentionLM(slots).load(start.flat()), 0
    for held in held_windows(batches, kind, chosen):
        model.fit(*framed(slots, *held), 1, rate, size=TASK_STEP)
        n += len(held[0])
    return model, n


def train(learned: DataFrame, slots: Slots, kind: str, rounds: int = ROUNDS) -> AttentionLM:
    """A model begun on the driver and carried on over every window of ``learned`` once, averaged after each round."""
    model, spark, n = AttentionLM(slots), learned.sparkSession, n_windows(learned, kind)
    drawn = first_windows(learned, kind, n)
    if not drawn:
        return model
    model.fit(*as_batch(slots, drawn, kind), min(MOST_EPOCHS, -(-FIRST_EPOCHS * FIRST_WINDOWS // len(drawn))), 0.012)
    if n <= FIRST_WINDOWS:  # all windows were drawn
        return model
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((slots, model))

        def run(batches, k=k, rate=0.004 / (k + 1)):
            own, start = shared.value
            done, seen = carried_on(batches, own, start, kind, lambda h: (h >> np.uint64(8)) % np.uint64(rounds) == k, rate)
            if seen:
                yield blocks_of(np.concatenate([done.flat(), [1.0]]) * seen, seen)

        total = summed(seeded(learned).mapInArrow(run, "block int, salt int, v binary"), len(model.flat()) + 1)
        if total[-1]:
            model.load(total[:-1] / total[-1])
    return model


# -- scores --------------------------------------------------------------------------------------


def attention_scores(encoded: DataFrame, slots: Slots, model: AttentionLM, kind: str) -> DataFrame:
    """Table of each text's natural log probability and of its passages: key, passage, log probability, own occurrences of both."""
    shared = encoded.sparkSession.sparkContext.broadcast((slots, model))
    lists = {"key": pa.int64(), "follow": pa.int64(), "lp": pa.float32(), "own": pa.int32(), "own_key": pa.int32()}
    kinds = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("train", pa.bool_()), ("net", pa.float64()), *((k, pa.list_(v)) for k, v in lists.items())])

    def run(batches):
        keep_freed_memory()
        scorer = Scorer(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                docs = _arrays(part.column(3), kind)
                size = np.array([len(d) for d in docs])
                lp = np.concatenate([[0.0], np.cumsum(scorer.ids(docs), dtype=np.float64)])
                edge = np.concatenate([[0], np.cumsum(size - 1)])
                doc, key, follow, start, stop = passages(docs)
                value = lp[stop - doc - 1] - lp[start - doc - 1]  # a target's number is its place less the texts begun
                order = np.lexsort((follow, key, doc))
                own, own_key = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
                for out, by in ((own, (doc, key, follow)), (own_key, (doc, key))):
                    new = np.ones(len(order), bool)
                    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in by], axis=0)
                    run_of = np.cumsum(new) - 1
                    out[order] = np.bincount(run_of)[run_of] if len(order) else 0
                offsets = pa.array(np.searchsorted(doc, np.arange(len(docs) + 1)), pa.int32())
                columns = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in zip((key, follow, value.astype(np.float32), own, own_key), lists.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([not h for h in part.column(2).to_pylist()]), pa.array(lp[edge[1:]] - lp[edge[:-1]]), *columns],
                    schema=kinds
                )

    ddl = "doc_id long, th long, train boolean, net double, key array<long>, follow array<long>, lp array<float>, own array<int>, own_key array<int>"
    return written(encoded.select("doc_id", "th", "held_out", "ids").mapInArrow(run, ddl), "lm-scores")


def repeats(scored: DataFrame) -> DataFrame:
    """(doc_id, th, more): what passages that other training texts share add to a text's natural log probability, by passage."""
    arrays = F.arrays_zip("key", "follow", "lp", "own", "own_key")
    rows = scored.select("doc_id", "th", "train", F.explode(arrays).alias("x")).select("doc_id", "th", "train", "x.*")
    each = rows.groupBy("key", "follow").agg(F.sum(F.col("train").cast("long")).alias("c"), F.count(F.lit(1)).alias("n"))
    each = written(each, "lm-passages")
    keys = each.groupBy("key").agg(F.sum("c").alias("c_key"), F.sum("n").alias("n_key")).where("n_key > 1 and c_key > 0")
    told = written(each.join(keys, "key").select("key", "follow", "c", "c_key", "n"), "lm-repeats")
    hot = told.where(F.col("n") > HOT)
    wide = hot.count() <= BROADCAST_ROWS  # bounded by the rows over HOT
    minus = F.when(F.col("train"), F.col("own")).otherwise(0), F.when(F.col("train"), F.col("own_key")).otherwise(0)
    c, c_key = (F.greatest(F.col(n) - m, F.lit(0)).cast("double") for n, m in zip(("c", "c_key"), minus, strict=True))
    lp = F.col("lp").cast("double")
    more = F.when(c > 0, F.log(c + F.exp(lp)) - lp).otherwise(0.0) - F.log(c_key + 1)
    parts = [(told.where(F.col("n") <= HOT), False), (hot, True)] if wide else [(told, False)]
    found = [rows.join(F.broadcast(t) if small else t, ["key", "follow"]).select("doc_id", "th", more.alias("more")) for t, small in parts]
    return found[0].union(found[1]) if wide else found[0]


def score(df: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``
    and ``attention_score`` (the network's alone).

    The base is the smoothed word model over all training tokens.  ``score`` is the log10 probability
    of the text's byte-level subwords and its end; a training text's own passages are left out of the
    table of passages for itself.  Rows that share id and text are one document to that table, and get
    a row each.  Without training documents every word is unknown, N is 0 and V is 0.
    """
    spark = df.sparkSession
    docs = narrow(df, id_col, text_col).withColumns({"held_out": held_out(), "th": F.xxhash64("text")})
    words = word_counts(docs.where(~F.col("held_out")))
    n_docs = docs.where(~F.col("held_out")).select("doc_id").count()
    totals = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = totals.n + n_docs, totals.v + (n_docs > 0)
    base = lambda c: np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
    with open(rank_path, "rb") as f:  # fixed by the vocabulary
        raw = f.read()
    ranks = spark.sparkContext.broadcast(raw)
    edge = len(ByteBPE.shared(raw, pattern).decimal)  # the first free id stands for both ends of a text
    kind = "<u4" if edge > 65_535 else "<u2"
    encoded = encode(docs, lambda: ByteBPE.shared(ranks.value, pattern), edge, words, base)
    learned = encoded.where(~F.col("held_out"))
    counts = id_counts(learned, kind, edge + 1)
    slots = Slots(counts)
    model = train(learned, slots, kind)
    scored = attention_scores(encoded, slots, model, kind)

    rare = encoded.select("doc_id", "th", F.explode(F.arrays_zip("words", "times")).alias("x")).select("doc_id", "th", F.col("x.words").alias("word"), F.col("x.times").alias("tf"))
    c = F.coalesce("c", F.lit(0))
    rare = rare.join(words, "word", "left").select(
        "doc_id", "th", F.when(c > 0, F.col("tf")).otherwise(0).cast("long").alias("n_known"),
        (F.col("tf") * F.log10((c + 0.1) / F.lit(n + 0.1 * (v + 1)))).alias("base")
    )
    parts = [
        encoded.select(
            "doc_id", "th", F.lit(1).cast("long").alias("rows"), "held_out", "n_tokens", (F.col("n_known") + F.lit(int(n_docs > 0))).alias("n_known"),
            (F.col("base") + F.lit(float(base(n_docs)))).alias("base")
        ),
        rare, scored.select("doc_id", "th", "net"), repeats(scored),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    sums = {k: F.sum(k).alias(k) for k in ("rows", "n_known", "base", "net", "more")}
    by = both.groupBy("doc_id", "th").agg(*sums.values(), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"))
    one = lambda k: F.col(k) / F.col("rows")
    return by.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select(
        real_id(), "held_out", "n_tokens", one("n_known").cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), one("base").alias("base_score"),
        ((one("net") + F.coalesce(one("more"), F.lit(0.0))) / LOG10).alias("score"), (one("net") / LOG10).alias("attention_score"),
    )
