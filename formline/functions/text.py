"""Name normalisation and similarity, in Arrow batches where no built-in function exists."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def decomposed(names: pd.Series) -> pd.Series:
    """HTML entities as characters, and these in their decomposed form: the two steps that have no built-in function."""
    return names.map(lambda n: unicodedata.normalize("NFKD", html.unescape(n)), na_action="ignore")


def normalised(name: Column) -> Column:
    """Accents stripped, lower case, hyphens and dots as spaces, no apostrophes, single spaces."""
    letters = F.lower(F.regexp_replace(decomposed(name), r"\p{Mn}", ""))
    return F.trim(F.regexp_replace(F.translate(letters, "-.'", "  "), r"\s+", " "))


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over the summed lengths."""
    return 100.0 if not a and not b else 200.0 * subsequence(a, b) / (len(a) + len(b))


def sorted_ratio(a: str, b: str) -> float:
    """Ratio of the names with their words in order."""
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def shared_ratio(a: str, b: str) -> float:
    """The best ratio among the shared words and either name's words, so that a name inside another scores in full."""
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max([ratio(one, two)] + [ratio(both, one), ratio(both, two)] * bool(both))


#: What a match of shared words alone counts less, so that whole agreement wins.
SHARED_DISCOUNT = 2.0


def token_score(a: str, b: str) -> float:
    """The larger of the sorted-words ratio and the discounted shared-words ratio."""
    return max(sorted_ratio(a, b), shared_ratio(a, b) - SHARED_DISCOUNT)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """``token_score`` of a name against the better of two others (the second may be null); null where one of the first is."""
    scores = [None if x is None or y is None else max(token_score(x, n) for n in (y, z) if n is not None) for x, y, z in zip(a, b, c, strict=True)]
    return pd.Series(scores, dtype="float64")


@F.pandas_udf(DoubleType())
def sorted_similarity(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    """As ``similarity``, by sorted words only."""
    scores = [None if x is None or y is None else max(sorted_ratio(x, n) for n in (y, z) if n is not None) for x, y, z in zip(a, b, c, strict=True)]
    return pd.Series(scores, dtype="float64")
