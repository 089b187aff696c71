"""The training-data operators against brute force, round trips and held-out accuracy, with hard inputs."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from formline.llm import attention_lm, bitpack, byte_bpe, components, host_rules, lyndon_sa, merkle, pii_crf, poisson_mix, quality_knn, trie_join
from formline.llm.rolling import Words
from formline.llm.words import WordCodec

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held_out string, score string, spans string"
RNG = np.random.default_rng(5)
VOCAB = ["the", "of", "and", "erly", "Thhaen", "été", "ouble", "inger", "tion,", "was.", "nd", "reth", "shonti", "über", "straße", "ñoquí"]


def words(n, rng=RNG):
    return " ".join(VOCAB[i] for i in rng.integers(0, len(VOCAB), n))


def long_text(n_words, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in", "ed", "st"], rng.integers(1, 4))) for _ in range(n_words))


@pytest.fixture(scope="module")
def texts():
    base = [long_text(120, i) for i in range(12)]
    near = [b.replace(" er ", " zz ", 2) for b in base[:6]]
    passage = long_text(60, 99)
    out = [None, "", " \n\t ", "one", "two words", *base, *base[:3], *near, *(f"{long_text(40, 50 + i)} {passage} {long_text(30, 80 + i)}" for i in range(4)), "ab " * 300, "x" * 500, long_text(4000, 7), "\n".join([base[0], base[1], base[0]])]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Odd ids, one of them null, repeated rows, and extra columns whose names clash."""
    rows = [(i * 3 if i != 9 else None, t, "en", None if i % 5 == 0 else f"src{i % 3}", None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], rows[6]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def ordered(pairs):
    return sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1].encode()))


# -- 10: byte-level BPE


def test_byte_bpe(docs, empty):
    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect())
    want = Counter()
    for i, t in rows_of(docs):
        ids = plain.encode_ordinary(t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert got == want
    assert byte_bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    encoded = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert Counter(bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()) == Counter(t.encode() for _, t in rows_of(docs))


def test_byte_bpe_safe_boundaries(monkeypatch):
    codec = byte_bpe.ByteBPE(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    text = "don't  stop \n\n12 a's " * 40 + " " * 9000 + "end" + "\n" * 50 + "é" * 300 + "  "
    whole = codec.encoding.encode_ordinary(text)
    monkeypatch.setattr(byte_bpe, "CHUNK", 17)
    assert codec.encode(text) == whole and codec.decode(whole) == text.encode()


# -- 5: bit packing


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_pack(bits):
    ids = RNG.integers(0, 2**bits, 10_001, dtype=np.uint64).astype(np.uint32)
    part = bitpack.Part(bitpack.build([3, 1, 2], [ids[:5000], ids[:0], ids[5000:]], bits, block_len=512))
    assert [(d, s, x.tolist()) for d, s, x in part.docs()] == [(3, 0, ids[:5000].tolist()), (1, 5000, []), (2, 5000, ids[5000:].tolist())]
    assert part.ids(700, 1900).tolist() == ids[700:1900].tolist()


def test_pack_export(tmp_path):
    raw = bitpack.build([1], [np.arange(10, dtype=np.uint32)], bitpack.bits_for(49_408))
    bitpack.export(raw, str(tmp_path / "a.bits"))
    assert bitpack.Part((tmp_path / "a.bits").read_bytes()).ids(3, 6).tolist() == [3, 4, 5] and bitpack.bits_for(49_408) == 16


def test_bitpack_round_trip(docs, empty):
    tok = Tokenizer.from_file(WORDS)
    special = docs.sparkSession.createDataFrame([(2, "hello <|endoftext|> world <|startoftext|>it's <|ENDOFTEXT|>x"), (5, "<|endoftext|>")], "doc_id long, text string")
    docs = docs.unionByName(special, allowMissingColumns=True)
    at, want = 0, Counter()
    for i, t in ordered(rows_of(docs)):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want[(i, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in bitpack.round_trip(docs, WORDS).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want
    assert bitpack.round_trip(empty, WORDS).count() == 0


def test_word_codec_equals_the_library():
    codec, tok = WordCodec(open(WORDS, "rb").read()), Tokenizer.from_file(WORDS)
    assert codec.ids("hello <|endoftext|> world <|startoftext|>").tolist() == [3306, 49407, 1002, 49406]
    for t in ("".join(f"{chr(c)}x{chr(c)}. ab{chr(c)} " for c in range(33, 1200)), "x<|endoftext|><|startoftext|>y <|EndOfText|>", "It's 12 a.m., don't!", "ÉTÉ, ñ.,.  x y <|endoftext|> \x1c z", "a" * 300, "ΟΔΟΣ, ΟΔΟΣ", "é. Å,", "!!., ..", "日本語。テスト, 12,345."):
        assert codec.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, t
    words = [w.encode() for w in ("the", "été,", "a.m.", "İx", "don't", "12,", "x..", "...", "Straße")]
    for some in (words, [w for w in words if w != "İx".encode()]):
        assert [np.frombuffer(r, codec.kind).tolist() for r in codec.many(some)] == [tok.encode(w.decode(), add_special_tokens=False).ids for w in some]


# -- 9: host rules


def brute_rules(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:]))
    rep = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_host_rules(docs, empty, texts):
    for t in [*(x or "" for x in texts), "a b\na b\n\n \na b", "#a *$% &|<> é"]:
        assert host_rules.measure(t) == brute_rules(t)
    out = host_rules.apply(docs).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.host_rate <= host_rules.MAX_HOST_RATE)
    assert {r.host for r in out} == {None, "src0", "src1", "src2"}
    hosts = {}
    for r in out:
        n, bad = hosts.get(r.host, (0, 0))
        hosts[r.host] = (n + 1, bad + r.base_failed)
    rates = [bad / n for n, bad in hosts.values()]
    mean = sum(rates) / len(rates)
    spread = sum((x - mean) ** 2 for x in rates) / (len(rates) - 1)
    strength = max(mean * (1 - mean) / spread - 1, 2.0) if spread else 2.0
    for r in out:
        n, bad = hosts[r.host]
        assert math.isclose(r.host_rate, (bad + mean * strength) / (n + strength), rel_tol=1e-9)
    assert host_rules.apply(empty).count() == 0


# -- 8: personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_luhn(d):
    v = [int(c) for c in d[::-1]]
    return (sum(v[::2]) + sum(sum(divmod(2 * c, 10)) for c in v[1::2])) % 10 == 0


def brute_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    ok = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": lambda x: 13 <= len(digits(x)) <= 19 and brute_luhn(digits(x)), "phone": lambda x: 9 <= len(digits(x)) <= 15}
    return [(k, *m.span()) for k in BASE for m in re.finditer(BASE[k], t) if ok[k](m[0])]


@pytest.mark.parametrize("text", [
    "mail a.b@c.de, x@y @z.com a@b@c.org a@b.co%c@d.com.", "1.2.3.4 1.2.3.4.5.6.7.8 300.1.1.1 1..2.3.4 0001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "+1 (375) 555-4393, +12 34, ++1 234 567 890 12, +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6", "é" * 50 + "q@w.er" + "9" * 400, "@@@@ 1@2.3 a@b.c-d.e", "",
])
def test_base_patterns(text):
    assert pii_crf.base_spans(text) == brute_spans(text)


def test_base_patterns_at_random():
    rng = np.random.default_rng(3)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab1290..@@+-() %45"), rng.integers(0, 40)))
        assert pii_crf.base_spans(text) == brute_spans(text), text


def private(seed):
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    card = "4" + d(14)
    card += next(c for c in "0123456789" if brute_luhn(card + c))
    values = [f"{long_text(1, seed)}.{d(2)}@mail{d(1)}.example.com", f"{rng.integers(1, 255)}.{rng.integers(0, 255)}.{rng.integers(0, 255)}.{rng.integers(1, 255)}", card, f"+1 ({d(3)}) 555-{d(4)}"]
    return " ".join(f"{long_text(12, seed * 7 + i)} {v} {long_text(9, seed * 11 + i)}" for i, v in enumerate(values)), card


def test_crf_gradient():
    model = pii_crf.BiLstmCrf()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, tags = RNG.integers(0, 128, (7, 3)), RNG.integers(0, 3, (7, 3))
    _, grad = model.loss_and_grad(ids, tags)
    for name in ("emb", "out", "trans", "whf", "wxb", "start", "bf"):
        flat = model.p[name].reshape(-1)
        i = int(ids[3, 1] * pii_crf.EMBED + 2) if name == "emb" else int(RNG.integers(len(flat)))
        keep, e = flat[i], 1e-5
        flat[i] = keep + e
        up, _ = model.loss_and_grad(ids, tags)
        flat[i] = keep - e
        down, _ = model.loss_and_grad(ids, tags)
        flat[i] = keep
        assert math.isclose((up - down) / (2 * e), grad[name].reshape(-1)[i], rel_tol=1e-4, abs_tol=1e-6), name


def test_personal_data(spark, docs, empty):
    made = [private(s) for s in range(200)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(made)], "doc_id long, text string")
    model = pii_crf.train(df.where("doc_id < 160"))
    held = [t for t, _ in made[160:]]
    found = pii_crf.label_texts(model, held)
    gold = [set(brute_spans(t)) for t in held]
    hit = sum(len(set(f) & g) for f, g in zip(found, gold, strict=True))
    assert hit / sum(map(len, gold)) > 0.8  # the network alone
    rng, caught, total = np.random.default_rng(123), 0, 0
    for i in range(300):  # other values than it was trained on, in forms that the base patterns miss
        kind = pii_crf.KINDS[i % 5]
        value, a, z = pii_crf.made_up(kind, rng)
        head = long_text(20, 40_000 + i) + " "
        text = f"{head}{value} {long_text(12, 50_000 + i)}"
        if brute_spans(f" {value} "):
            continue
        base, spans = pii_crf.all_spans(model, [text])[0]
        total, caught = total + 1, caught + ((kind, len(head) + a, len(head) + z) in spans)
    assert total > 150 and caught / total >= 0.9
    clean = [f"{long_text(80, 60_000 + i)} {pii_crf.harmless(rng)} {long_text(15, 70_000 + i)} {pii_crf.harmless(rng)} {long_text(9, i)}" for i in range(200)]
    assert sum(len(s) - len(b) for b, s in pii_crf.all_spans(model, clean)) <= 12  # of 400 numbers and names that are no personal data
    out = {r.doc_id: r for r in pii_crf.find(df, model=model).collect()}
    for i, (t, card) in enumerate(made):
        base = brute_spans(t)
        assert out[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base).encode()).hexdigest()
        assert {f"{k}:{a}:{z}" for k, a, z in base} <= set(out[i].spans.split(","))
        assert card not in out[i].redacted and "[card]" in out[i].redacted
    clean = pii_crf.redact(docs, model=model)
    assert clean.columns == docs.columns and Counter(r.text for r in clean.collect()) == Counter(r.text for r in docs.collect())
    assert pii_crf.find(empty).count() == 0 and pii_crf.redact(empty).count() == 0
    odd = pii_crf.find(docs, model=model).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in odd) == Counter((i, hashlib.sha256(pii_crf.joined(brute_spans(t)).encode()).hexdigest()) for i, t in rows_of(docs))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the given tables")
def test_marks_on_the_given_texts(spark):
    """No run of a card's length without a right check digit is marked, and values of ``token`` and the like are exact."""
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = pii_crf.train(df.where("doc_id >= 3000"))
    texts = [r.text or "" for r in df.where("doc_id < 3000").select("text").collect()]
    runs, exact, named = 0, 0, 0
    for text, (base, spans) in zip(texts, pii_crf.all_spans(model, texts), strict=True):
        for kind, a, z in spans[len(base):]:
            digits = re.sub("[^0-9]", "", text[a:z])
            assert kind != "card" or (13 <= len(digits) <= 19 and pii_crf.luhn(digits))
        marked = {(a, z) for _, a, z in spans}
        runs += sum(any(a < m.end() and m.start() < z for a, z in marked) for m in re.finditer(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])", text) if not pii_crf.luhn(re.sub("[^0-9]", "", m[0])))
        for m in re.finditer(r'token = "([^"]+)"', text):
            named, exact = named + 1, exact + (m.span(1) in marked)
    assert runs <= 3 and named > 20 and exact >= 0.95 * named, (runs, exact, named)


def test_bounds_of_marks():
    assert pii_crf.settled('token = "abc123def456ghi"', "secret", 11, 20) == ("secret", 9, 24)
    assert pii_crf.settled("n 4111.1111.1111.1111.", "card", 2, 22) == ("card", 2, 21)
    assert pii_crf.settled("n 4111.1111.1111.1112.", "card", 2, 22) is None and pii_crf.settled("x 12 y", "ip", 2, 4) is None


def test_viterbi_is_the_best_path():
    model, rng = pii_crf.BiLstmCrf(seed=8), np.random.default_rng(2)
    model.p["trans"] = (model.p["trans"] + rng.standard_normal(model.p["trans"].shape)).astype(np.float32)
    ids = rng.integers(1, 128, (4, 6))
    e, _ = model.emissions(ids)
    got = model.decode(ids)
    for b in range(6):
        score = lambda path: model.p["start"][path[0]] + sum(e[i, b, k] for i, k in enumerate(path)) + sum(model.p["trans"][x, y] for x, y in zip(path, path[1:]))  # noqa: E731, B023
        best = max(itertools.product(range(pii_crf.TAGS), repeat=4), key=score)
        assert math.isclose(score(best), score(tuple(got[:, b])), rel_tol=1e-5)


def test_spans_across_windows_are_one():
    class Fixed:  # marks digits, whatever else is in the window
        def decode(self, ids):
            digit = (ids >= 48) & (ids <= 57)
            before = np.vstack([np.zeros((1, ids.shape[1]), bool), digit[:-1]])
            return np.where(digit, np.where(before, 8, 7), 0)

    for start in (0, 30, 40, 47, 48, 60, 90, 95, 96, 130):
        text = "x" * start + "1" * 30 + "y" * 100
        spans = pii_crf.label_texts(Fixed(), [text])[0]
        assert (min(a for _, a, _ in spans), max(z for _, _, z in spans)) == (start, start + 30) and sum(z - a for _, a, z in spans) == 30


def test_redacted_overlaps():
    assert pii_crf.redacted("a 123456 b", [("card", 2, 6), ("phone", 4, 8)]) == "a [card] b"


# -- 7: repeated strings


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(400):
        s = rng.integers(0, rng.integers(1, 5), rng.integers(0, 60)).tolist()
        assert lyndon_sa.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute_repeats(rows):
    """(id, n_bytes, n_removed, n_spans, digest); equal (id, text) rows are one document."""
    seen, out = {}, {}
    for key in dict.fromkeys(ordered(rows)):
        raw = key[1].encode()
        cover = np.zeros(len(raw) + 1, bool)
        fresh = []
        for i in range(len(raw) - 99):
            w = raw[i : i + 100]
            if w in seen:
                cover[i : i + 100] = True
            else:
                seen[w] = key
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        n_spans = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[key] = (key[0], len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest())
    return Counter(out[k] for k in rows)


def test_remove_repeats(docs, empty):
    got = Counter(tuple(r) for r in lyndon_sa.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_repeats(rows_of(docs))
    assert lyndon_sa.remove_repeats(empty).count() == 0


def test_remove_repeats_same_id_with_other_texts(spark):
    t = long_text(60, 3)
    df = spark.createDataFrame([(1, "b" + t), (1, "a" + t), (0, "c " + t)], "doc_id long, text string")
    out = {bytes(r.kept): r.n_removed for r in lyndon_sa.remove_repeats(df, keep_text=True).collect()}
    assert out[("c " + t).encode()] == 0 and out[b"a"] == len(t) and out[b"b"] == len(t)


# -- 3: n-gram Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets.setdefault((i, t), frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)]))
    keys = ordered(sets)
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((find(a), find(b)), key=keys.index)
                up[hi] = lo
    return Counter((k[0], len(sets[k]), find(k)[0]) for k in rows)


@pytest.mark.parametrize("small,block", [(4, 2048), (2, 3)])
def test_components(docs, empty, monkeypatch, small, block):
    monkeypatch.setattr(trie_join, "SMALL_GROUP", small)
    monkeypatch.setattr(trie_join, "GROUP_BLOCK", block)
    got = Counter(tuple(r) for r in trie_join.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows_of(docs))
    if small == 4:
        assert trie_join.jaccard_components(empty).count() == 0


def test_components_of_many_near_copies(spark):
    rng = np.random.default_rng(8)
    base = long_text(60, 1).split()
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"edit{rng.integers(1000)}"
        rows.append((1000 - i, " ".join(w)))
    got = Counter(tuple(r) for r in trie_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


def test_trie_and_bounds():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    trie = trie_join.Trie(np.zeros(0, np.uint64))
    for i, s in enumerate(sets):
        trie.insert(s, i)
    for percent in (50, 80):
        for s in sets:
            want = {i for i, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= percent * len(np.union1d(s, x))}
            assert set(trie.linked(s, percent)) == want
            assert all(trie_join.may_link(len(s), len(sets[i]), trie_join.parity(s), trie_join.parity(sets[i]), percent) for i in want)


def test_connected(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.id: r.comp for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- 2: fingerprints


def test_fingerprints(docs, empty):
    rows = ordered(rows_of(docs))
    out = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256) for r in merkle.fingerprint_edits(docs).collect()))
    want = []
    for k, (i, t) in enumerate(rows):
        other = rows[k - 1][1]
        want.append((i is not None, i or 0, len(t), hashlib.sha256(merkle.edited(t, other).encode()).hexdigest()))
    assert out == sorted(want)
    assert merkle.fingerprint_edits(empty).count() == 0
    one = merkle.fingerprint_edits(docs.where("doc_id = 15")).first()
    assert one.near_next == 1.0 and one.n_chars > 0


def plain_tree(text):
    """Chunks, paragraphs and sections by the rules in words, one byte at a time."""
    raw, edges = text.encode(), [0]
    for z in range(1, len(raw) + 1):
        code = int.from_bytes(raw[z - 5 : z - 1], "big") if z >= 5 else 0
        marked = z >= 6 - 1 and raw[z - 1] == 32 and z >= 5 and (code * 2654435761 % 2**32) >> 29 == 0
        if raw[z - 1] == 10 or marked or (z <= merkle.HEAD and raw[z - 1] == 32) or z == len(raw) or z - edges[-1] == merkle.MAX_CHUNK:
            edges.append(z)
    h = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    chunks = [(h(raw[a:z]), a, z) for a, z in zip(edges, edges[1:])]

    def grouped(mark, nodes, closes):
        out, held = [], []
        for i, n in enumerate(nodes):
            held.append(n)
            if closes(n) or i == len(nodes) - 1:
                out.append((h(mark + b"".join(x[0] for x in held)), held[0][1], held[-1][2], held))
                held = []
        return out

    paragraphs = grouped(b"P", chunks, lambda n: raw[n[2] - 1] == 10)
    sections = grouped(b"S", paragraphs, lambda n: n[0][0] < 64)
    return h(b"R" + b"".join(s[0] for s in sections)).hex(), sections, len(raw)


def plain_likeness(a, b):
    """Twice the bytes under shared branches over all bytes, opening only the branches that differ."""
    (root_a, mine, size_a), (root_b, other, size_b) = plain_tree(a), plain_tree(b)
    if root_a == root_b:
        return 1.0
    shared = 0
    for _ in range(3):
        left = Counter(n[0] for n in mine) & Counter(n[0] for n in other)
        rest = []
        for nodes, count in ((mine, Counter(left)), (other, Counter(left))):
            keep = []
            for n in nodes if nodes is mine else nodes[::-1]:
                if count[n[0]] > 0:
                    count[n[0]] -= 1
                    shared += (n[2] - n[1]) * (nodes is mine)
                else:
                    keep.append(n)
            rest.append(keep if nodes is mine else keep[::-1])
        mine, other = ([c for n in r for c in (n[3] if len(n) > 3 else [])] for r in rest)
    return 2.0 * shared / (size_a + size_b)


def test_fingerprints_equal_a_plain_tree(docs):
    rows = ordered(rows_of(docs))
    plain_edit = lambda t, o: t[: len(t) - len(t) // 2] + o[: len(t) // 2]
    want = Counter()
    for k, (i, t) in enumerate(rows):
        other = rows[k - 1][1]
        new = plain_edit(t, other)
        want[(i, plain_tree(t)[0], plain_tree(new)[0], hashlib.sha256(new.encode()).hexdigest(), round(plain_likeness(t, new), 9), round(plain_likeness(t, other), 9))] += 1
    got = Counter((r.doc_id, r.fingerprint, r.edited_fingerprint, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in merkle.fingerprint_edits(docs).collect())
    assert got == want


def test_merkle_trees():
    a = "\n".join(long_text(20, i) for i in range(30))
    b = a.replace(a[400:460], "CHANGED HERE", 1)
    near, start, end = merkle.compare(merkle.Tree(a), merkle.Tree(b))
    assert 0.8 < near < 1 and start <= 400 and end >= 460 and end - start < 1200
    assert merkle.compare(merkle.Tree(a), merkle.Tree(a)) == (1.0, -1, -1)
    assert merkle.compare(merkle.Tree(a), merkle.Tree(long_text(300, 77)))[0] < 0.1
    seen = {}
    for t in ["", "a", "a ", " a", "a\n", "a\n\n", "ab" * 300, "ab" * 301, *(long_text(9, i) for i in range(50))]:
        assert seen.setdefault(merkle.Tree(t).root, t) == t


def test_tree_table(docs):
    r = merkle.trees(docs.where("doc_id = 15")).first()
    assert {n.level for n in r.nodes} == {0, 1, 2}


# -- 1: quality


def test_quality(spark, empty):
    rng = np.random.default_rng(2)
    good = [long_text(60, 1000 + i) for i in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in long_text(60, 2000 + i).split()) if i % 2 else f"{long_text(1, i)} " * 60 for i in range(60)]
    rows = [(i, t, q) for i, (t, q) in enumerate([*((t, 1) for t in good), *((t, 0) for t in bad)])]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t, _ in rows] + [(900, None), (901, ""), (None, good[0])], "doc_id long, text string")
    labels = spark.createDataFrame([(int(i), int(q)) for i, _, q in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_knn.score(docs, labels).collect()}
    held = [(out[i].predicted, q) for i, _, q in rows if out[i].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    for i, _, _ in rows:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and out[i].predicted == int(out[i].score >= 0.5)
    assert out[900].score == out[901].score == 0.0 and None in out
    assert quality_knn.score(docs, labels.limit(0)).where("score = 0.5").count() == len(rows) + 1
    assert quality_knn.score(empty, labels).count() == 0


def test_vote_equals_a_plain_loop():
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    anchors, z = unit(rng.standard_normal((40, 8))).astype(np.float32), unit(rng.standard_normal((30, 8))).astype(np.float32)
    anchors[20:30] = anchors[:10]  # ties: the smaller number is nearer
    labels = rng.integers(0, 2, 40).astype(np.float32)
    got = quality_knn.vote(z, anchors, labels, 7)
    np.testing.assert_array_equal(got, np.concatenate([quality_knn.vote(z[i : i + 1], anchors, labels, 7) for i in range(30)]))
    for row, value in zip(z, got, strict=True):
        cos = [round(float(np.dot(row.astype(np.float64), a.astype(np.float64))) * 1e5) for a in anchors]
        near = sorted(range(40), key=lambda i: (-cos[i], i))[:7]
        weight = [(max(cos[i], 0) / 1e5) ** 8 + 1e-9 for i in near]
        assert math.isclose(value, sum(w * labels[i] for w, i in zip(weight, near, strict=True)) / sum(weight), rel_tol=2e-3)
    assert quality_knn.vote(z, anchors[:3], labels[:3]).shape == (30,)


def test_quality_of_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120, 3)] * 2 + [(None, 1)], "doc_id long, quality int")
    out = quality_knn.score(docs, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows_of(docs)) and all(0 <= r.score <= 1 for r in out)
    assert len({(r.score, r.predicted) for r in out if r.doc_id == 18}) == 1  # the repeated row
    assert quality_knn.score(docs, labels.limit(0)).count() == len(out) and quality_knn.score(empty, labels.limit(0)).count() == 0


# -- 4: language model


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    slots = attention_lm.Slots(rng.integers(0, 50, 6000).astype(float))
    model = attention_lm.AttentionLM(slots, seed)
    return slots, model, rng


def test_attention_gradient():
    _, model, rng = small_model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    model.mask = model.mask.astype(np.float64)
    ids, targets = rng.integers(0, attention_lm.SLOTS + 1, (2, 3, attention_lm.WINDOW))
    targets[0, :9] = range(28, 37)
    weight = (rng.random((3, attention_lm.WINDOW)) < 0.8).astype(float)
    _, grad = model.loss_and_grad(ids, targets, weight)
    assert grad.keys() == model.p.keys()
    for name in model.p:
        flat = model.p[name].reshape(-1)
        i, e = int(np.abs(grad[name]).argmax()), 1e-6
        keep = flat[i]
        flat[i] = keep + e
        up, _ = model.loss_and_grad(ids, targets, weight)
        flat[i] = keep - e
        down, _ = model.loss_and_grad(ids, targets, weight)
        flat[i] = keep
        assert math.isclose((up - down) / (2 * e), grad[name].reshape(-1)[i], rel_tol=1e-3, abs_tol=1e-6), name


def test_model_is_causal_and_windows_cover_once():
    _, model, rng = small_model()
    ids = rng.integers(0, 50, (1, attention_lm.WINDOW))
    other = ids.copy()
    other[0, 20:] = (other[0, 20:] + 1) % 50
    a, b = model.body(ids)[0], model.body(other)[0]
    np.testing.assert_allclose(a[:20], b[:20], rtol=1e-6)
    assert not np.allclose(a[20:], b[20:])
    for n in (1, 5, 31, 32, 33, 57, 1000):
        starts = attention_lm.windows(n)
        at = starts[:, None] + np.arange(attention_lm.WINDOW)
        fresh = attention_lm.fresh(at, np.full(len(starts), n), starts == 0)
        assert sorted(at[fresh].tolist()) == list(range(n))


def test_output_is_a_distribution():
    slots, model, rng = small_model()
    z = rng.standard_normal((1, attention_lm.WIDTH)).astype(np.float32)
    every = np.arange(6000)
    p = np.exp(model.log_probs(np.repeat(z, 6000, 0), slots.of[every]).astype(np.float64) + slots.tail)
    empty_slots = attention_lm.SLOTS + 1 - len(np.unique(slots.of))
    assert empty_slots == 0 and math.isclose(p.sum(), 1, rel_tol=1e-4)


def test_scores_equal_a_plain_loop():
    slots, model, rng = small_model(3)
    docs = [np.concatenate([[5999], rng.integers(0, 5999, n), [5999]]) for n in (0, 1, 3, 27, 28, 29, 60, 200)]
    got = np.split(attention_lm.Scorer(slots, model).ids(docs), np.cumsum([len(d) - 1 for d in docs])[:-1])
    for d, values in zip(docs, got, strict=True):
        want, n = [], len(d) - 1
        for start in attention_lm.windows(n).tolist():
            part = slots.of[d[start : start + attention_lm.WINDOW]][None, : min(attention_lm.WINDOW, n - start)]
            z = model.body(part)[0]
            for i in range(0 if start == 0 else attention_lm.OVERLAP, part.shape[1]):
                t = int(d[start + i + 1])
                want.append(float(model.log_probs(z[i : i + 1], slots.of[[t]])[0] + slots.tail[t]))
        np.testing.assert_allclose(values, want, rtol=2e-4, atol=2e-4)


def test_passages():
    rng = np.random.default_rng(5)
    docs = [np.concatenate([[9999], rng.integers(0, 9999, n), [9999]]) for n in (0, 10, 15, 16, 17, 400, 900)]
    docs.append(np.concatenate([[9999], docs[5][1:200], docs[6][1:300], [9999]]))
    doc, key, follow, start, stop = attention_lm.passages(docs)
    base = np.cumsum([0, *map(len, docs)])
    flat, seen, keys = np.concatenate(docs), {}, {}
    assert len(doc) > 10
    for d, k, f, a, z in zip(doc.tolist(), key.tolist(), follow.tolist(), start.tolist(), stop.tolist(), strict=True):
        assert base[d] + attention_lm.ANCHOR < a < z <= base[d + 1]
        before, after = tuple(flat[a - attention_lm.ANCHOR : a]), tuple(flat[a:z])
        assert keys.setdefault(k, before) == before and seen.setdefault(f, after) == after
    assert len(seen) < len(doc)  # the copy shares passages


def test_encoder_equals_word_by_word():
    bpe = byte_bpe.ByteBPE(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    texts = ["It's a test, it's.", "", " \n ", "\u00a0x y\u00a0 z 12 a%%% \u2003", "ÉTÉ été don't 日本語 " * 40, "word " * 30]
    own = Words(texts)
    split = [w for t in texts for w in t.encode().lower().split()]
    assert [own.raw[a:z] for a, z in zip(own.start, own.end, strict=True)] == split and len({*own.hash.tolist()}) == len(set(split))
    assert [int(d) for d in own.doc] == [i for i, t in enumerate(texts) for _ in t.encode().lower().split()]
    for k in (0, 3):
        encoder = attention_lm.Encoder(bpe, np.unique(own.hash)[: k * 3])
        for _ in range(2):  # the second time from what is kept
            ids, size = encoder(own, *encoder.find(own))
            want = [bpe.encode(" " + w.decode()) for w in split]
            assert ids.tolist() == [i for w in want for i in w] and size.tolist() == [len(w) for w in want]


def test_language_model(docs, empty):
    rows = rows_of(docs)
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    split = lambda t: [*t.encode().lower().split(), None]
    c = Counter(w for i, t in rows if not is_held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = split(t)
        want[(i, is_held(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6))] += 1
    out = attention_lm.score(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    assert attention_lm.score(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def brute_repeats_gain(docs, train, net):
    """What passages add, by plain counting; own occurrences are left out."""
    out = []
    for i, own in enumerate(docs):
        others = [p for j, d in enumerate(docs) if j != i and train[j] for p in d]
        gain = 0.0
        for (k, f), lp in zip(own, net[i], strict=True):
            c, c_key = sum(p == (k, f) for p in others), sum(p[0] == k for p in others)
            gain += math.log((c + math.exp(lp)) / (c_key + 1)) - lp
        out.append(gain)
    return out


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_equal_plain_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(attention_lm, "HOT", hot)
    rng = np.random.default_rng(4)
    docs = [[(int(k), int(k * 10 + rng.integers(0, 2))) for k in rng.integers(0, 6, n)] for n in (0, 1, 2, 3, 5, 8, 4)]
    train, net = [True, True, False, True, True, False, True], [[-float(x) for x in rng.uniform(0.5, 20, len(d))] for d in docs]
    rows = []
    for i, (d, lp) in enumerate(zip(docs, net, strict=True)):
        k, f = [p[0] for p in d], [p[1] for p in d]
        rows.append((i, i, train[i], 0.0, k, f, lp, [d.count(p) for p in d], [k.count(x) for x in k]))
    df = spark.createDataFrame(rows, "doc_id long, th long, train boolean, net double, key array<long>, follow array<long>, lp array<float>, own array<int>, own_key array<int>")
    got = {r.doc_id: r.x for r in attention_lm.repeats(df).groupBy("doc_id").agg(F.sum("more").alias("x")).collect()}
    for i, want in enumerate(brute_repeats_gain(docs, train, net)):
        assert math.isclose(got.get(i, 0.0), want, rel_tol=1e-4, abs_tol=1e-5), i


def test_attention_beats_counts(spark):
    """Held-out texts: the attention model alone against smoothed counts of single ids and pairs from the same training texts."""
    bpe = byte_bpe.ByteBPE(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.isdir(os.path.dirname(path)):
        pytest.skip("needs the given tables")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(path).orderBy("doc_id").limit(600).collect()]
    edge = len(bpe.decimal)
    ids = {i: np.array([edge, *bpe.encode("".join(" " + w for w in t.encode().lower().decode().split())), edge]) for i, t in docs}
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 10 == 0]
    learn = [ids[i] for i in ids if i not in set(held)]
    counts = np.bincount(np.concatenate([d[1:] for d in learn]), minlength=edge + 1).astype(float)
    slots = attention_lm.Slots(counts)
    model = attention_lm.AttentionLM(slots)
    rows = [(int(h), s == 0, d[s : s + attention_lm.WINDOW + 1].astype("<u2").tobytes()) for h, (s, d) in enumerate((s, d) for d in learn for s in attention_lm.windows(len(d) - 1))]
    model.fit(*attention_lm.as_batch(slots, rows, "<u2"), 5, 0.012)
    n = sum(len(ids[i]) - 1 for i in held)
    net = attention_lm.Scorer(slots, model).ids([ids[i] for i in held]).sum() / n
    pairs, share = Counter(p for d in learn for p in zip(d[:-1].tolist(), d[1:].tolist())), (counts + 0.1) / (counts.sum() + 0.1 * len(counts))
    total, kinds = Counter(), Counter()
    for (a, _), c in pairs.items():
        total[a] += c
        kinds[a] += 1
    single = sum(math.log(share[b]) for i in held for b in ids[i][1:]) / n
    pair = sum(math.log((pairs[a, b] + kinds[a] * share[b]) / (total[a] + kinds[a]) if total[a] else share[b]) for i in held for a, b in zip(ids[i][:-1].tolist(), ids[i][1:].tolist())) / n
    assert net > 0.98 * max(single, pair), (net, single, pair)  # log probabilities: at least 2 % better


# -- 6: mixing


def test_poisson_inverse(spark):
    df = spark.range(2000).select(((F.col("id") + 0.5) / 2000).alias("u"))
    for mean in (0.0, 0.3, 1.0, 6.0, 40.0):
        k = [r.k for r in df.select(poisson_mix.poisson_inverse(F.col("u"), F.lit(mean)).alias("k")).collect()]
        assert abs(np.mean(k) - mean) < 0.02 + mean * 0.01 and k == sorted(k)


def test_mix(spark, docs, empty, monkeypatch):
    big = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise("b").alias("source"), F.lit("t").alias("text"))
    out = poisson_mix.mix(big, {"a": 3, "b": 1, "": 0})
    share = {r.source: r.n for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert None not in share and abs(share["a"] / sum(share.values()) - 0.75) < 0.03 and abs(sum(share.values()) - 6000) < 300
    assert out.where("mix_copy > mix_count").count() == 0
    first = sorted(out.select("doc_id", "mix_copy").collect())
    monkeypatch.setattr(poisson_mix, "BROADCAST_SOURCES", 0)
    assert sorted(poisson_mix.mix(big, {"a": 3, "b": 1, "": 0}).select("doc_id", "mix_copy").collect()) == first
    assert poisson_mix.mix(empty).count() == 0 and poisson_mix.mix(docs, {}).count() == 0
    same = {}
    for r in poisson_mix.mix(docs, total=200.0).groupBy("doc_id", "text").agg(F.min("mix_count").alias("a"), F.max("mix_count").alias("b")).collect():
        assert r.a == r.b


def test_mix_with_clashing_names(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("t").alias("text"), *[F.lit("x").alias(c) for c in ("mix_rate", "mix_copy", "mix_count", "mix_key", "mix_source", "_mix_source", "_mix_one", "c0", "before", "salt")])
    out = poisson_mix.mix(rows)
    assert out.columns == ["doc_id", "source", "text", "mix_source", "_mix_source", "_mix_one", "c0", "before", "salt", "mix_rate", "mix_count", "mix_copy", "mix_key"]
    plain = poisson_mix.mix(rows.select("doc_id", "source", "text"))
    assert sorted(out.select("doc_id", "mix_copy", "mix_key").collect()) == sorted(plain.select("doc_id", "mix_copy", "mix_key").collect())
    assert {r.c for r in out.select(F.concat("mix_source", "_mix_one", "c0", "before", "salt").alias("c")).collect()} == {"xxxxx"}


def test_unlisted_sources_stay(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.element_at(F.array(F.lit("src1"), F.lit("new"), F.lit(None), F.lit("out")), (F.col("id") % 4 + 1).cast("int")).alias("source"), F.lit("t").alias("text"))
    rate = {r.mix_source: r.rate for r in poisson_mix.rates(rows, {"src1": 1.0, "out": 0.0}).collect()}
    assert {k: round(v, 9) for k, v in rate.items()} == {"src1": 1.333333333, "new": 1.333333333, "": 1.333333333, "out": 0.0}
    assert {r.source for r in poisson_mix.mix(rows, {"src1": 1.0, "out": 0.0}).select("source").distinct().collect()} == {"src1", "new", None}
    half = {r.mix_source: r.rate for r in poisson_mix.rates(rows, {"src1": 1.0}, other_weight=0.0).collect()}
    assert half["new"] == half[""] == 0 and half["src1"] == 4


def test_poisson_inverse_of_large_means(spark):
    df = spark.range(20).select(((F.col("id") + 0.5) / 20).alias("u"))
    for mean in (0.5, 700.0, 800.0, 5000.0):
        cdf = np.cumsum([math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(int(2 * mean) + 40)])
        want = [int((cdf < (i + 0.5) / 20).sum()) for i in range(20)]
        assert [r.k for r in df.orderBy("u").select(poisson_mix.poisson_inverse(F.col("u"), F.lit(mean)).alias("k")).collect()] == want


def test_rates_of_a_million(spark, monkeypatch):
    df = spark.range(8).select(((F.col("id") + 0.5) / 8).alias("u"))
    for mean in (260.0, 300.0, 1e6, 5e7, 3e9):
        reach = 12 * math.sqrt(mean) + 40
        k = np.arange(int(mean - reach), int(mean + reach)) if mean > 1e5 else np.arange(int(mean + reach))
        log_p = -mean + k * math.log(mean) - np.array([math.lgamma(x + 1.0) for x in k])
        cdf = np.cumsum(np.exp(log_p))
        got = [r.k for r in df.orderBy("u").select(poisson_mix.poisson_inverse(F.col("u"), F.lit(mean)).alias("k")).collect()]
        want = k[[int((cdf < (i + 0.5) / 8 * cdf[-1]).sum()) for i in range(8)]]
        assert np.abs(np.array(got) - want).max() <= (0 if mean < 1e5 else 1 + 1e-6 * math.sqrt(mean))
    rows = spark.range(4001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, "rare").otherwise("b").alias("source"), F.lit("t").alias("text"))
    first = poisson_mix.mix(rows, {"rare": 1.0, "b": 1.0}, total=400_000.0)
    monkeypatch.setattr(poisson_mix, "MANY_COPIES", 1e9)
    plain = poisson_mix.mix(rows, {"rare": 1.0, "b": 1.0}, total=400_000.0)
    total = lambda df: df.agg(F.count(F.lit(1)), F.countDistinct("doc_id", "mix_copy"), F.sum(F.crc32("mix_key")), F.sum("mix_copy")).first()
    assert total(first) == total(plain) and total(first)[0] == total(first)[1]
    rare = first.where("doc_id = 7").agg(F.count(F.lit(1)).alias("n"), F.min("mix_copy").alias("a"), F.max("mix_copy").alias("b"), F.max("mix_count").alias("c")).first()
    assert rare.a == 1 and rare.n == rare.b == rare.c and abs(rare.n - 200_000) < 3000


def test_hot_passage_is_cut(spark, monkeypatch):
    passage = long_text(60, 123)
    rows = [(i, f"{long_text(12, 2000 + i)} {passage} {'same tail ' if i % 3 else ''}{long_text(20, 5000 + i % 250)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen, want = set(), {}
    for i, t in rows:
        raw, gone = t.encode(), set()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone.update(range(p, p + 100))
            seen.add(raw[p : p + 100])
        want[i] = len(gone)
    monkeypatch.setattr(lyndon_sa, "HOT", 40, raising=False)
    assert {r.doc_id: r.n_removed for r in lyndon_sa.remove_repeats(df).collect()} == want


def test_hot_key_takes_bounded_suffix_arrays(monkeypatch):
    most, array = [], lyndon_sa.suffix_array
    monkeypatch.setattr(lyndon_sa, "suffix_array", lambda x: most.append(len(x)) or array(x))
    core, n = b"c" * 20 + bytes(range(80)), 900
    raws = [core + long_text(20, i).encode()[:34] for i in range(n)]
    columns = {"key": [7] * n, "salt": [0] * n, "doc_id": list(range(n)), "start": [0] * n, "core": [34] * n, "part": raws}
    out = [r for b in lyndon_sa._suffix_blocks(iter([lyndon_sa.pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
    assert max(most) < 2 * lyndon_sa.BLOCK and len(most) > 2 and {r["doc_id"] for r in out} == set(range(n))


def test_every_window_is_trained_on(spark, monkeypatch):
    """Past the driver's draw the rounds take each window of each text once, whatever the number of windows."""
    monkeypatch.setattr(attention_lm, "FIRST_WINDOWS", 8)
    monkeypatch.setattr(attention_lm, "HELD_WINDOWS", 50)
    rng = np.random.default_rng(6)
    texts = [rng.integers(0, 50, n).astype("<u2") for n in (2, 3, 33, 34, 900, *rng.integers(2, 4000, 25).tolist())]
    learned = spark.createDataFrame([(i, i, bytearray(d.tobytes())) for i, d in enumerate(texts)], "doc_id long, th long, ids binary").repartition(3)
    want = sum(len(attention_lm.windows(len(d) - 1)) for d in texts)
    assert attention_lm.n_windows(learned, "<u2") == want and len(attention_lm.first_windows(learned, "<u2", want)) <= 8
    seen, add = [], attention_lm.summed
    monkeypatch.setattr(attention_lm, "summed", lambda rows, size: seen.append(add(rows, size)) or seen[-1])
    slots = attention_lm.Slots(np.bincount(np.concatenate(texts), minlength=60).astype(float))
    model = attention_lm.train(learned, slots, "<u2")
    assert len(seen) == attention_lm.ROUNDS and sum(t[-1] for t in seen) == want and all(np.isfinite(v).all() for v in model.p.values())


def test_outputs_are_made_for_counted_places_only(monkeypatch):
    """Places that windows share, and places past a text's end, take no part in the loss and cost no output."""
    _, model, rng = small_model(5)
    ids, targets, other = rng.integers(0, attention_lm.SLOTS + 1, (3, 40, attention_lm.WINDOW))
    weight = (rng.random(ids.shape) < 0.6).astype(np.float32)
    seen, levels = [], attention_lm.AttentionLM._levels
    monkeypatch.setattr(attention_lm.AttentionLM, "_levels", staticmethod(lambda target: seen.append(len(target)) or levels(target)))
    loss, grad = model.loss_and_grad(ids, targets, weight)
    assert seen == [int(weight.sum())]
    again, same = model.loss_and_grad(ids, np.where(weight > 0, targets, other), weight)
    assert again == loss and all(np.array_equal(grad[k], same[k]) for k in grad)
    nothing, none = model.loss_and_grad(ids, targets, np.zeros_like(weight))
    assert nothing == 0 and all(not g.any() for g in none.values())


@pytest.mark.parametrize(("low", "high"), [(0, None), (0, 20), (40, 50), (0, 1)])
def test_network_equals_the_plain_form(low, high):
    """The graph's loss, gradient and log probabilities, with and without rows in each level and class, and past the last slot."""
    _, model, rng = small_model(7)
    ids = rng.integers(0, attention_lm.SLOTS + 1, (30, attention_lm.WINDOW))
    targets = rng.integers(low, attention_lm.SLOTS + 1 if high is None else high, ids.shape)
    for weight in ((rng.random(ids.shape) < 0.7).astype(np.float32), np.eye(30, attention_lm.WINDOW, dtype=np.float32), np.zeros(ids.shape, np.float32)):
        loss, grad = model.loss_and_grad(ids, targets, weight)
        again, same = model.step(ids, targets, weight)
        assert math.isclose(loss, again, rel_tol=1e-5, abs_tol=1e-6) and grad.keys() == same.keys()
        for k, g in grad.items():
            assert g.shape == same[k].shape == model.p[k].shape
            np.testing.assert_allclose(same[k], g, rtol=1e-3, atol=1e-5 * max(float(np.abs(g).max()), 1e-6), err_msg=k)
        at = weight.reshape(-1).nonzero()[0]
        if len(at):
            want = model.log_probs(model.body(ids)[0][at], targets.reshape(-1)[at])
            np.testing.assert_allclose(model.outputs(ids, targets.reshape(-1)[at], at)[0], want, rtol=1e-4, atol=1e-4)


def test_training_takes_the_graph_alone(monkeypatch):
    """No step makes the network's output class by class in Python."""
    slots, model, rng = small_model(8)
    ids, targets = rng.integers(0, attention_lm.SLOTS + 1, (2, 200, attention_lm.WINDOW))
    plain = attention_lm.AttentionLM(slots, 8)
    monkeypatch.setattr(plain, "step", plain.loss_and_grad)
    monkeypatch.setattr(model, "loss_and_grad", None)
    weight = np.ones(ids.shape, np.float32)
    assert math.isclose(model.fit(ids, targets, weight, 2, 0.01), plain.fit(ids, targets, weight, 2, 0.01), rel_tol=1e-4)


def test_windows_as_arrays_are_all_windows(monkeypatch):
    """Each window once, in the order of the texts and cut into equal parts, whatever the texts' lengths."""
    monkeypatch.setattr(attention_lm, "HELD_WINDOWS", 20)
    slots, _, rng = small_model(9)
    texts = [rng.integers(0, 6000, n).astype("<u2") for n in (2, 3, 32, 33, 34, 61, 3000, 2, *rng.integers(2, 200, 40).tolist())]
    seeds = rng.integers(-(2**63), 2**63, len(texts))
    batches = [pa.RecordBatch.from_pydict({"seed": seeds[a : a + 7], "ids": [t.tobytes() for t in texts[a : a + 7]]}) for a in range(0, len(texts), 7)]
    for chosen in (lambda h: h >= 0, lambda h: h % np.uint64(3) == 1, lambda h: h < 0):
        rows = list(attention_lm.windows_of(batches, "<u2", chosen))
        parts = list(attention_lm.held_windows(batches, "<u2", chosen))
        assert [len(p[0]) for p in parts] == [min(20, len(rows) - a) for a in range(0, len(rows), 20)]
        for a, part in zip(range(0, len(rows), 20), parts, strict=True):
            for x, y in zip(attention_lm.as_batch(slots, rows[a : a + 20], "<u2"), attention_lm.framed(slots, *part), strict=True):
                assert x.dtype == y.dtype and np.array_equal(x, y)


def test_common_words_are_found_in_their_table():
    """Words that share their hash's last bits are found all the same, and others are not."""
    rng = np.random.default_rng(11)
    common = np.unique(np.concatenate([rng.integers(-(2**63), 2**63, 500), np.arange(60) << 40, (np.arange(60) << 40) - 1]))
    encoder = attention_lm.Encoder(byte_bpe.ByteBPE(open(RANKS, "rb").read(), public_tokenizers.PATTERN), common)
    own = Words([""])
    own.hash = rng.permutation(np.concatenate([common, common, rng.integers(-(2**63), 2**63, 3000), (np.arange(60) << 40) + 1, np.arange(60, 90) << 40]))
    at, known = encoder.find(own)
    assert known.tolist() == np.isin(own.hash, common).tolist() and np.array_equal(common[at[known]], own.hash[known])
    assert len(encoder.table) >= 2 * len(common) and at.min() >= 0
