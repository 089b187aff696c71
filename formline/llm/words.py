"""Subword ids of white-space separated words, looked up word by word in a bounded cache.

For tokenizers that drop white space and never merge across it (``word_bpe_49k.json`` is one),
a text's ids are its words' ids in a row, so common words need the library once per worker.  New
words go through the library many at a time; plain lower-case letters need no normalisation and
take the library's own model without it.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
from tokenizers import Tokenizer

from formline.llm.common import Cache

_CODECS: dict[int, "WordCodec"] = {}
#: Symbols that end a word as a piece of their own: never an apostrophe, which may belong to what is before it.
_MARKS = ".,!?;:*$%&#|<>()[]{}\"-_/\\+=~^`@"
#: Letters that are one code point when normalised and are lowered alone, then such marks.
_SHAPE = re.compile("([a-zA-ZÀ-ÖØ-öø-įı-ɏ]+)([%s]*)" % re.escape(_MARKS)).fullmatch
#: New words that are joined for one call of the library.
_JOINED = 256


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte, as byte-level vocabularies name them; the space stays, to part words."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other) if b != 32} | {32: " "}


class WordCodec:
    """Ids of a text as a numpy array, equal to the untouched library's over the whole text.

    The library gives ids to the vocabulary's special tokens wherever their strings stand in a text, so
    texts are cut there first; what only becomes such a string by lower-casing is ordinary text.
    """

    def __init__(self, tokenizer_json: bytes) -> None:
        self.library = Tokenizer.from_buffer(tokenizer_json)
        self.ordinary = Tokenizer.from_buffer(tokenizer_json)
        self.ordinary.encode_special_tokens = True  # for parts of a text between special tokens
        said = json.loads(tokenizer_json)
        self.plain = Tokenizer.from_str(json.dumps(said | {"normalizer": None, "added_tokens": [], "post_processor": None, "pre_tokenizer": {"type": "WhitespaceSplit"}}))
        self.letters = _byte_letters()
        self.vocab_size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocab_size <= 65536 else "<u4")
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.special_raw = {s: np.array([i], self.kind).tobytes() for s, i in self.special.items()} | {"": b""}
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.tails = Cache(lambda t: self._library(t.encode()), 10_000)
        self.words = Cache(self._library, 400_000)
        self.ends_word = np.zeros(self.vocab_size, bool)
        for token, i in self.library.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")

    @staticmethod
    def shared(tokenizer_json: bytes) -> "WordCodec":
        key = hash(tokenizer_json)
        if key not in _CODECS:
            _CODECS[key] = WordCodec(tokenizer_json)
        return _CODECS[key]

    def _library(self, word: bytes) -> bytes:
        return np.array(self.ordinary.encode(word.decode("utf-8"), add_special_tokens=False).ids, self.kind).tobytes()

    def _cores(self, cores: list[str]) -> list[bytes]:
        """Ids of words of plain letters, each of which ends with an id that ends a word."""
        low = " ".join(cores).lower().encode().decode("latin-1").translate(self.letters).split(" ")
        joined = [" ".join(low[i : i + _JOINED]) for i in range(0, len(low), _JOINED)]
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)])
        raw, size = ids.tobytes(), self.kind.itemsize
        stops = ((self.ends_word[ids].nonzero()[0] + 1) * size).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def many(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; no word is empty."""
        if not words:
            return []
        shapes = list(map(_SHAPE, b" ".join(words).decode("utf-8").split(" ")))
        cores = list(dict.fromkeys([m[1] for m in shapes if m]))
        known = dict(zip(cores, self._cores(cores) if cores else [], strict=True))
        return [self._library(w) if m is None else known[m[1]] + self.tails[m[2]] if m[2] else known[m[1]] for m, w in zip(shapes, words, strict=True)]

    def raws(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``kind``; new words of all texts are learned together."""
        parts, out = [], []
        for text in texts:
            ends = [m.span() for m in self.cut.finditer(text)] if any(s in text for s in self.special) else []
            edge = [0, *(x for e in ends for x in e), len(text)]
            for a, b, c in zip(edge[::2], edge[1::2], [*edge[2::2], len(text)], strict=True):
                words = text[a:b].encode("utf-8").lower().split()
                parts.append((len(out), words, list(map(self.words.get, words)), self.special_raw[text[b:c]]))
            out.append([])
        new = list({w for _, words, found, _ in parts for w, x in zip(words, found, strict=True) if x is None})
        made = dict(zip(new, self.many(new), strict=True))
        for i, words, found, after in parts:
            out[i] += [made[w] if x is None else x for w, x in zip(words, found, strict=True)] if made else found
            out[i].append(after)
        for item in made.items():
            self.words.put(*item)
        return [b"".join(x) for x in out]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raws([text])[0], self.kind)
