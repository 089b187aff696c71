"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions.

The network adds what the patterns miss: other written forms of the four kinds (``name [at] host``,
``12[.]3[.]4[.]5`` and colon forms, cards with odd separators, national phone numbers) and a fifth
kind, ``secret`` (passwords, tokens, access keys), which has no base pattern and stands after the
four.  It is trained here in numpy on labelled windows: values drawn in many forms, set into places
of a bounded sample of real texts (``MAX_TRAIN_DOCS`` documents, a documented parameter), together with
what the base patterns label there, and with numbers, dates, versions and names that are no personal
data.  What it marks is kept where its form is: a marked card must have a right check digit, as every card has, and a
marked secret is the whole unbroken string it is marked in.

Scoring covers every whole text: windows overlap by half, each character takes its label from the
window in which it lies most central, and the labels of a text are joined into spans once.  A window
without a digit, an at sign or a bracketed "at" holds nothing that the network is taught, and is not run.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import map_batches, narrow, real_id

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds with a base pattern, which alone are counted.
BASE_KINDS = KINDS[:4]
MAX_TRAIN_DOCS = 400
#: Places of one text that are sent for training.
PLACES = 4
WINDOW, STRIDE = 96, 48
HIDDEN, EMBED = 20, 12
TAGS = 1 + 2 * len(KINDS)
BATCH, STEPS = 64, 400

# The base patterns.  Where a pattern could rescan a long run, the run's start is looked
# for first; the matches are those of a plain left-to-right search.
_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?=@)")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]|[\[(] ?[aA][tT] ?[\])]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kinds in the order of KINDS, then by start."""
    if not _HINT.search(text):
        return []
    out, last = [], 0
    if "@" in text:
        for m in _LOCAL.finditer(text):
            start = max(m.start(), last)
            if start < m.end() and (d := _DOMAIN.match(text, m.end())):
                out.append(("email", start, d.end()))
                last = d.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])))


# -- the network ---------------------------------------------------------------------------------


def char_ids(text: str) -> np.ndarray:
    """Code points below 128 as they are, all others 1; 0 is padding."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code < 128, np.maximum(code, 1), 1).astype(np.int64)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


class BiLstmCrf:
    """Parameters as a dict of arrays (single precision unless set otherwise); batches are (time, batch)."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
        self.p = {"emb": rng.standard_normal((128, EMBED)) * 0.3, "out": g(2 * HIDDEN, TAGS), "ob": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for d in "fb":
            self.p |= {f"wx{d}": g(EMBED, 4 * HIDDEN), f"wh{d}": g(HIDDEN, 4 * HIDDEN), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
        for k in range(len(KINDS)):  # an inside tag follows its own kind only
            for prev in range(TAGS):
                if prev not in (1 + 2 * k, 2 + 2 * k):
                    self.p["trans"][prev, 2 + 2 * k] = -8.0
            self.p["start"][2 + 2 * k] = -8.0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _lstm(self, x, d, keep):
        t, b, _ = x.shape
        h, c = np.zeros((b, HIDDEN), x.dtype), np.zeros((b, HIDDEN), x.dtype)
        z_in, wh = x @ self.p[f"wx{d}"] + self.p[f"b{d}"], self.p[f"wh{d}"]
        hs, saved = np.empty((t, b, HIDDEN), x.dtype), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = z_in[i] + h @ wh
            a = _sigmoid(z[:, : 3 * HIDDEN])
            i_g, f_g, o_g, u = a[:, :HIDDEN], a[:, HIDDEN : 2 * HIDDEN], a[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            c_new = f_g * c + i_g * u
            tc = np.tanh(c_new)
            if keep:
                saved.append((i, h, c, i_g, f_g, o_g, u, tc))
            h, c = o_g * tc, c_new
            hs[i] = h
        return hs, saved

    def _lstm_back(self, x, d, saved, dhs, grad):
        wh = self.p[f"wh{d}"]
        dh_next, dc_next = np.zeros_like(dhs[0]), np.zeros_like(dhs[0])
        dz_all = np.empty((*dhs.shape[:2], 4 * HIDDEN), x.dtype)
        for i, h, c, i_g, f_g, o_g, u, tc in reversed(saved):
            dh = dhs[i] + dh_next
            dc = dc_next + dh * o_g * (1 - tc * tc)
            dz = np.concatenate([dc * u * i_g * (1 - i_g), dc * c * f_g * (1 - f_g), dh * tc * o_g * (1 - o_g), dc * i_g * (1 - u * u)], 1)
            dz_all[i] = dz
            grad[f"wh{d}"] += h.T @ dz
            dh_next, dc_next = dz @ wh.T, dc * f_g
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grad[f"wx{d}"] += x.reshape(-1, EMBED).T @ flat
        grad[f"b{d}"] += flat.sum(0)
        return dz_all @ self.p[f"wx{d}"].T

    def emissions(self, ids, keep=False):
        x = self.p["emb"][ids]
        hf, sf = self._lstm(x, "f", keep)
        hb, sb = self._lstm(x, "b", keep)
        h = np.concatenate([hf, hb], 2)
        return h @ self.p["out"] + self.p["ob"], (x, h, sf, sb)

    def loss_and_grad(self, ids, tags):
        """Mean negative log-likelihood of the gold tags, and its gradient by forward-backward."""
        t, b = ids.shape
        e, (x, h, sf, sb) = self.emissions(ids, True)
        tr = self.p["trans"]
        alpha, beta = np.empty((t, b, TAGS), e.dtype), np.zeros((t, b, TAGS), e.dtype)
        alpha[0] = self.p["start"] + e[0]
        for i in range(1, t):
            alpha[i] = _lse(alpha[i - 1][:, :, None] + tr, 1) + e[i]
        for i in range(t - 2, -1, -1):
            beta[i] = _lse(tr + (e[i + 1] + beta[i + 1])[:, None, :], 2)
        z = _lse(alpha[-1], 1)
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(alpha + beta - z[None, :, None])
        grad["start"] = de[0].sum(0)
        rows, gold = np.arange(b), 0.0
        for i in range(1, t):
            grad["trans"] += np.exp(alpha[i - 1][:, :, None] + tr + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
            np.subtract.at(grad["trans"], (tags[i - 1], tags[i]), 1.0)
            gold += tr[tags[i - 1], tags[i]].sum()
        np.subtract.at(grad["start"], tags[0], 1.0)
        for i in range(t):
            de[i, rows, tags[i]] -= 1.0
            gold += e[i, rows, tags[i]].sum()
        gold += self.p["start"][tags[0]].sum()
        grad["out"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
        grad["ob"] = de.sum((0, 1))
        dh = de @ self.p["out"].T
        dx = self._lstm_back(x, "f", sf, dh[:, :, :HIDDEN], grad) + self._lstm_back(x, "b", sb, dh[:, :, HIDDEN:], grad)
        np.add.at(grad["emb"], ids.ravel(), dx.reshape(-1, EMBED))
        return (z.sum() - gold) / b, {k: v / b for k, v in grad.items()}

    def fit(self, ids, tags, epochs: int, batch: int = BATCH, rate: float = 0.012, seed: int = 5) -> float:
        """Adam over shuffled batches; returns the last epoch's mean loss."""
        rng, step, mean = np.random.default_rng(seed), 0, 0.0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        steps = epochs * -(-ids.shape[1] // batch)
        for _ in range(epochs):
            order, losses = rng.permutation(ids.shape[1]), []
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                loss, grad = self.loss_and_grad(ids[:, part], tags[:, part])
                losses.append(loss)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                step += 1
                own = rate * (1.0 - 0.9 * step / steps)
                for k, g in grad.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (own * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(self.p[k].dtype)
            mean = float(np.mean(losses)) if losses else 0.0
        return mean

    def decode(self, ids):
        """Viterbi tags of each window."""
        e, _ = self.emissions(ids)
        t, b = ids.shape
        best, back = self.p["start"] + e[0], np.empty((t, b, TAGS), np.int64)
        for i in range(1, t):
            s = best[:, :, None] + self.p["trans"]
            back[i] = s.argmax(1)
            best = s.max(1) + e[i]
        tags = np.empty((t, b), np.int64)
        tags[-1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[i - 1] = back[i, np.arange(b), tags[i]]
        return tags


def tags_of(n: int, spans) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, z in spans:
        k = KINDS.index(kind)
        out[a:z] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


# -- labelled windows ----------------------------------------------------------------------------

# What stands around made-up values and what is not personal data.
_NAMES = ("info", "maria", "j.smith", "k_lee", "sales", "anna.k", "dr.hahn", "office", "tomas", "lea.b")
_HOSTS = ("example", "mail", "post", "web", "corp", "uni-x", "shop")
_ENDS = ("com", "org", "net", "de", "fr", "es", "co.uk")
_KEYS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "access_key", "auth")
_PREFIXES = ("AKIA", "ASIA", "sk-", "ghp_", "xoxb-", "AIza")
_ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def made_up(kind: str, rng: np.random.Generator) -> tuple[str, int, int]:
    """(text, start, end of the value in it): a value of a kind in one of its written forms."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    chars = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    before = after = ""
    if kind == "email":
        name, host, end = pick(*_NAMES) + pick("", d(1), d(2)), pick(*_HOSTS) + pick("", d(1)), pick(*_ENDS)
        at, dot = pick(
            ("@", "."), ("@", "."), (" @ ", "."), (" [at] ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "."),
            ("[@]", "."), (" (at) ", ".")
        )
        value = name + at + host + dot + end
    elif kind == "ip":
        four = [str(x) for x in rng.integers(0, 256, 4)]
        value = pick(".", ".", "[.]", " . ", "(.)", " [.] ").join(four) if rng.random() < 0.75 else ":".join(chars("0123456789abcdef", int(rng.integers(2, 5))) for _ in range(8))
    elif kind == "card":
        digits = with_check_digit(pick("4", "5", "3", "6") + d(14))
        value = pick("", " ", "-", ".", "  ", "/", " - ", "_").join(digits[i : i + 4] for i in range(0, 16, 4))
    elif kind == "phone":
        a, b, c = d(3), d(3), d(4)
        value = pick(
            f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{d(2)} {a} {b}{c}", f"0{d(2)}/{b}{c}",
            f"1-{a}-{b}-{c}", f"+{d(2)}/{a}/{b}{c}", f"({a}){b}{c}"
        )
    else:
        if rng.random() < 0.35:
            value = pick(*_PREFIXES) + chars(_ALPHABETS[int(rng.integers(1, 3))], int(rng.integers(16, 36)))
        else:
            value, quote = chars(pick(*_ALPHABETS), int(rng.integers(10, 44))), pick("", "", '"', "'")
            before, after = pick(*_KEYS) + pick("=", " = ", ": ", ":") + quote, quote
    return before + value + after, len(before), len(before) + len(value)


def with_check_digit(digits: str) -> str:
    return next(digits + str(i) for i in range(10) if luhn(digits + str(i)))


def harmless(rng: np.random.Generator) -> str:
    """Numbers and names that are no personal data: order numbers and time stamps among them, not runs of a card's length, whose
    check digit decides."""
    if rng.random() < 0.15:
        run = "".join(map(str, rng.integers(0, 10, 22)))
        return (run[:9], run[:10], run[:12], run[:20], run, f"order {run[:11]}", f"1{run[:9]}.{run[9:12]}", f"id={run[:12]}")[int(rng.integers(8))]
    pick = lambda *x: x[int(rng.integers(len(x)))]
    n = lambda k: str(int(rng.integers(1, 10**k)))
    return pick(
        n(1), n(2), n(3), n(4), n(5), n(6), f"{n(2)}.{n(2)}", f"{n(2)},{n(2)}", f"v{n(1)}.{n(1)}.{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{rng.integers(1800, 2100)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}",
        f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}", f"{rng.integers(10, 24)}:{rng.integers(10, 60)}", f"{n(2)}%", f"${n(3)}", f"@{pick(*_HOSTS)}", f"{pick(*_NAMES)}@{pick(*_HOSTS)}",
        f"A{n(1)}", f"{n(2)}th", f"{n(2)} {n(2)}", f"{n(3)} {n(3)}", f"({n(2)})", f"[{n(2)}]", f"{n(2)}-{n(2)}", f"{n(1)}+{n(1)}={n(2)}", f"No. {n(4)}", f"{n(3)}/{n(2)}", "section 1.2.3", "Version 4.0.",
        f"token {n(2)}", "password", f"{n(3)},{n(3)},{n(3)}", f"#{n(5)}", f"{n(6)}{n(2)}",
    )


def places(text: str, seed: int) -> list[str]:
    """Up to PLACES pieces of a text, of up to WINDOW characters: around its first labelled values, around hints, and anywhere."""
    rng, out = np.random.default_rng(seed), []
    near = [a for _, a, _ in base_spans(text)[: PLACES // 2]] + [m.start() for _, m in zip(range(2), _HINT.finditer(text), strict=False)]
    for at in [*near, *rng.integers(0, max(len(text), 1), PLACES).tolist()][:PLACES]:
        start = max(0, at - int(rng.integers(10, 60)))
        out.append(text[start : start + WINDOW])
    return [x for x in out if x]


def training_windows(pieces: list[str], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(time, windows) ids and tags: every piece as it is, and twice with made-up values or harmless ones set between its words."""
    rng = np.random.default_rng(seed)
    ids, tags = [], []

    def add(text, spans):
        if spans and spans[-1][2] > WINDOW:
            spans = spans[:-1]  # an edge cuts the last value: what is left of it is no example
            text = text[: max([z for _, _, z in spans], default=0)]
        text = text[:WINDOW]
        if text:
            ids.append(np.pad(char_ids(text), (0, WINDOW - len(text))))
            tags.append(np.pad(tags_of(len(text), spans), (0, WINDOW - len(text))))

    for piece in pieces:
        taken, own = -1, []
        for s in sorted(base_spans(piece), key=lambda s: (s[1], KINDS.index(s[0]))):
            if s[1] > taken and s[1] > 0 and s[2] < len(piece):  # where kinds overlap, the first is the label
                own.append(s)
                taken = s[2]
        if own or not _HINT.search(piece):
            add(piece, own)
        words = re.sub(r"\S*(?:%s)\S*" % _HINT.pattern, " ", piece).split()
        for _ in range(2):
            out, spans, at = "", [], int(rng.integers(0, max(min(len(words), 8), 1)))
            head, tail = " ".join(words[max(0, at - 6) : at]), words[at:]
            out = head + " " * bool(head)
            for _ in range(int(rng.integers(1, 3))):
                if rng.random() < 0.65:
                    kind = KINDS[int(rng.integers(len(KINDS)))]
                    value, a, z = made_up(kind, rng)
                    spans.append((kind, len(out) + a, len(out) + z))
                else:
                    value = harmless(rng)
                k = int(rng.integers(1, 5))
                out += value + ("", "", "", ".", ",", ")")[int(rng.integers(6))] + " " + " ".join(tail[:k]) + " "
                tail = tail[k:]
            add(out + " ".join(tail), spans)
    if not ids:
        return np.zeros((WINDOW, 0), np.int64), np.zeros((WINDOW, 0), np.int64)
    return np.stack(ids, 1), np.stack(tags, 1)


def label_texts(model: BiLstmCrf, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of whole texts: overlapping windows, each character labelled where it is most central."""
    jobs, where = [], []
    codes = [char_ids(t) if _HINT.search(t) else None for t in texts]
    for i, code in enumerate(codes):
        if code is not None:
            hint = np.zeros(len(code), bool)
            hint[[m.start() for m in _HINT.finditer(texts[i])]] = True
            for at in range(0, max(len(code) - STRIDE, 1), STRIDE):
                if hint[at : at + WINDOW].any():
                    part = code[at : at + WINDOW]
                    jobs.append(np.pad(part, (0, WINDOW - len(part))))
                    where.append((i, at, len(part)))
    tags = {i: (np.zeros(len(c), np.int64), np.full(len(c), -1, np.int64)) for i, c in enumerate(codes) if c is not None}
    for first in range(0, len(jobs), 256):
        got = model.decode(np.stack(jobs[first : first + 256], 1))
        for k, (i, at, n) in enumerate(where[first : first + 256]):
            best, depth = tags[i]
            own = np.minimum(np.arange(n), WINDOW - 1 - np.arange(n))
            if at == 0:
                own[: WINDOW // 2] = WINDOW
            if at + WINDOW >= len(best):
                own[WINDOW // 2 :] = WINDOW
            better = own > depth[at : at + n]
            best[at : at + n][better] = got[:n, k][better]
            depth[at : at + n][better] = own[better]
    out = [[] for _ in texts]
    for i, (best, _) in tags.items():
        j, n = 0, len(best)
        while j < n:
            if best[j] == 0:
                j += 1
                continue
            kind, start = (best[j] - 1) // 2, j
            j += 1
            while j < n and best[j] == 2 + 2 * kind:
                j += 1
            out[i].append((KINDS[kind], start, j))
    return out


#: The shortest value of any kind has so many characters: four numbers with three separators.
LEAST = 7
_VALUE = re.compile(r"[A-Za-z0-9_+/-]+")


def settled(text: str, kind: str, a: int, z: int) -> tuple[str, int, int] | None:
    """A marked span with its value's own bounds, or None where it is no value of its kind.

    It begins and ends with a letter or digit; a secret is the whole unbroken string that it is marked in; a card has 13 to 19
    digits with a right check digit, which no card lacks.
    """
    while a < z and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while a < z and not text[z - 1].isalnum():
        z -= 1
    if kind == "secret" and a < z:
        runs = [m for m in _VALUE.finditer(text, max(0, a - 256), min(len(text), z + 256)) if m.start() < z and a < m.end()]
        if runs:
            longest = max(runs, key=lambda m: min(m.end(), z) - max(m.start(), a))
            a, z = longest.span()
    if kind == "card":
        digits = _digits(text[a:z])
        if not (13 <= len(digits) <= 19 and luhn(digits)):
            return None
    return (kind, a, z) if z - a >= LEAST and _HINT.search(text, a, z) else None


def all_spans(model: BiLstmCrf | None, texts: list[str]) -> list[tuple[list, list]]:
    """Per text: (base spans, all spans).  Network spans take their values' bounds, hold a digit or an at sign of some form
    themselves, and touch no base span; of two that overlap the first stays."""
    found = label_texts(model, texts) if model is not None else [[] for _ in texts]
    out = []
    for text, extra in zip(texts, found, strict=True):
        base = base_spans(text)
        spans, end = list(base), 0
        for kind, a, z in extra:
            span = settled(text, kind, a, z)
            if span and span[1] >= end and not any(b < span[2] and span[1] < e for _, b, e in base):
                spans.append(span)
                end = span[2]
        out.append((base, spans))
    return out


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span (overlapping ones merged, named by the first) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS, steps: int = STEPS) -> BiLstmCrf | None:
    """A model from the ``max_docs`` documents with the smallest id hash among those with a digit or at sign; None without any.

    Tasks send a text's ``places`` only, so what comes to the driver is bounded in characters too.  Fewer
    windows are gone over more often: there are about ``steps`` steps of BATCH windows in any case.
    """
    rows = narrow(df, id_col, text_col).where(F.col("text").rlike("[0-9@]"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = rows.select("doc_id").orderBy(*order).limit(max_docs).distinct()
    picked = rows.join(F.broadcast(ids), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id", "text"))  # at most max_docs ids
    cut = lambda x: {"h": x["h"], "pieces": [places(t, h & 0xFFFFFFFF) for t, h in zip(x["text"], x["h"], strict=True)]}
    found = map_batches(picked.select("h", "text"), cut, "h long, pieces array<string>").orderBy("h").limit(max_docs).collect()  # bounded
    windows, tags = training_windows([p for r in found for p in r.pieces])
    if not windows.shape[1]:
        return None
    model = BiLstmCrf()
    model.fit(windows, tags, -(-steps * BATCH // max(windows.shape[1], BATCH)))
    return model


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: BiLstmCrf | None = None, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """One row per input row: ``doc_id``, base counts by kind, ``base_sha256``, ``spans``, ``redacted`` text.

    Repeated rows are each returned; a text without digits or at signs has no spans.
    """
    model = model or train(df, id_col, text_col, max_docs)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(x):
        both = all_spans(shared.value, x["text"])
        counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in both] for k in BASE_KINDS}
        return {"doc_id": x["doc_id"], **counts, "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both],
                "spans": [joined(spans) for _, spans in both], "redacted": [redacted(t, spans) for t, (_, spans) in zip(x["text"], both, strict=True)]}

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    return map_batches(narrow(df, id_col, text_col), run, schema).select(real_id(), *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "redacted")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: BiLstmCrf | None = None, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The input with its text redacted in place; every other column and row as it was (null texts stay null)."""
    model = model or train(df, id_col, text_col, max_docs)
    shared = df.sparkSession.sparkContext.broadcast(model)
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    at = df.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(at).to_pylist()
                both = all_spans(shared.value, [t or "" for t in texts])
                new = [None if t is None else redacted(t, s) for t, (_, s) in zip(texts, both, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
