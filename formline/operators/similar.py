"""Exact candidates for name scores, from inverted indexes of rare parts instead of all pairs of a block.

A name's score against another is the better of two: the ratio of both with their words in order, and the
ratio of their shared words with either one, or of both with the shared words first, less a discount
(``functions.text.token_score``).  A ratio of at least t lets names of m and n letters differ by at
most (1 - t) (m + n) letters, x taken out of one and y put in from the other, x - y = m - n.  Hence:

* a few letters: where at most ``NEAR`` letters need be taken out of either name, both leave the same words, whatever their order,
  so names meet by all that can be left of them and a name's keys do not depend on how many others there are. A space that is
  taken out makes two words one. Words that both names have stay as they are, so this holds for either ratio.
* letter pairs inside words, where names may be further apart: each letter taken out breaks at most two and each put in at most one, so all
  but 2 x + y of a name's pairs are also the other's.  Of both names' rarest 2 x + y + 2, two must then
  be the same, so names meet by two pairs at once.  Repeated pairs are numbered, so the rule holds for sets.
* names with fewer pairs than that (initials, very short words) are looked up by their letters, of which
  a letter taken out breaks one: the rarest x + 1 letters must meet.
* shared words that alone score make up most of a name's letters: the rarest words of a name that leave
  too few letters to the others must hold one of them.  They meet all words of the other side.

Nothing that scores ``least`` is missed; what the indexes bring together is scored once for each pair of
different names, whatever the number of rows and blocks that have them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from formline.functions.text import SHARED_DISCOUNT, similarity
from formline.sources.staging import written

_EPS = 1e-9
#: Letters that near names give up at most: NEAR up to SHORT letters, one up to LONG letters, none beyond, so that no name has many keys.
NEAR, SHORT, LONG = 2, 32, 128


def _words(name: Column) -> Column:
    """The words as Python splits them."""
    return F.filter(F.split(name, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _numbered(parts: Column) -> Column:
    """(part, which of its kind) of an array."""
    return F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda q: q == p)).alias("k")))


def _broken(n: Column, least: float, out: int, into: int) -> Column:
    """The most parts of a name of n letters that a partner of any length can leave out."""
    bound = least / (200.0 - least)
    partner = F.sequence(F.ceil(n * bound - _EPS).cast("int"), F.floor(n / bound + _EPS).cast("int"))

    def parts(m: Column) -> Column:
        apart = F.floor((1 - least / 100) * (n + m) + _EPS)
        x = F.floor((apart + n - m) / 2)
        return F.when((x >= 0) & (apart - x >= 0), out * x + into * F.floor((apart - n + m) / 2)).otherwise(0)

    return F.array_max(F.transform(partner, parts))


def _pairs_inside(form: Column) -> Column:
    letters = lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substr(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(_words(form), letters))


def _letters(form: Column) -> Column:
    return F.filter(F.split(form, ""), lambda c: (c != " ") & (c != ""))


#: Kinds of keys: two letter pairs; a letter, where the left (LA) or the right (LB) name is a short one; a shared word that
#: tells of the left (WA) or the right (WB) name.
_PAIRS, _SHORT, _WORD = "P", ("LA", "LB"), ("WA", "WB")


def _names(side: DataFrame, which: int) -> DataFrame:
    """Each different (block, name) with its words and its bags of them: all words in order, and without repeated ones where it has some."""
    words = F.array_sort(_words(F.col("name")))
    known = side.where(F.col("block").isNotNull() & F.col("name").isNotNull()).select("block", "name").distinct()
    made = known.select(F.lit(which).alias("side"), F.xxhash64(F.lit(which), "block", "name").alias("id"), "block", "name", words.alias("ws"))
    return made.withColumns({"set": F.array_distinct("ws"), "bags": F.array_distinct(F.array("ws", F.array_distinct("ws")))})


def _reach(m: Column, n: Column, least: float) -> tuple[Column, Column, Column]:
    """Of names of m and n letters that score ``least``: how many letters the first gives up at most, whether there can be any, and
    whether both give up few enough to be near."""
    apart = F.floor((1 - least / 100) * (m + n) + _EPS)
    own, other = F.floor((apart + m - n) / 2), F.floor((apart - m + n) / 2)
    most = F.when(F.greatest(m, n) <= SHORT, NEAR).when(F.greatest(m, n) <= LONG, 1).otherwise(0)
    return own.cast("int"), (own >= 0) & (other >= 0), F.greatest(own, other) <= most


def _forms(names: DataFrame) -> DataFrame:
    """(side, id, block, name, bag, form, m): every form of m letters."""
    forms = names.select("side", "id", "block", "name", F.explode("bags").alias("bag"))
    return forms.withColumn("form", F.array_join("bag", " ")).withColumn("m", F.length("form"))


def left_over(words: Sequence[str], letters: int) -> list[str]:
    """What can be left of some words when at most so many letters, or spaces between any two of them, are taken out; words in order."""
    fresh = {tuple(sorted(words))}
    seen = set(fresh)
    for _ in range(letters):
        made = set()
        for bag in fresh:
            for i, w in enumerate(bag):
                rest = bag[:i] + bag[i + 1:]
                made.update(tuple(sorted((*rest, w[:j] + w[j + 1:]))) if len(w) > 1 else rest for j in range(len(w)))
                made.update(tuple(sorted((*rest[:k], *rest[k + 1:], w + v))) for k, v in enumerate(rest))
        fresh = made - seen
        seen |= fresh
    return [" ".join(bag) for bag in seen]


@F.pandas_udf(ArrayType(StringType()))
def _left(bags: pd.Series, letters: pd.Series) -> pd.Series:
    return pd.Series([left_over(b, n) for b, n in zip(bags, letters, strict=True)], dtype="object")


def _near_keys(forms: DataFrame, lengths: DataFrame, least: float, side: int) -> DataFrame:
    """(id, key) of one side: all that can be left of each form, for each length of the other side in its block that is near."""
    others = lengths.where(F.col("side") == 1 - side).select("block", F.col("m").alias("n"))
    own, can, near = _reach(F.col("m"), F.col("n"), least)
    ways = forms.where(F.col("side") == side).join(others, "block").where(can & near)
    ways = ways.select("id", "block", "bag", "form", own.alias("own"), F.array(*["m", "n"][::1 - 2 * side]).alias("mn"))
    whole = ways.where("own = 0").select("id", "block", "mn", F.col("form").alias("left"))
    less = ways.where("own > 0").select("id", "block", "mn", F.explode(_left("bag", "own")).alias("left"))
    return whole.unionByName(less).select("id", F.xxhash64("block", "mn", "left").alias("key"))


def _near(names: DataFrame, forms: DataFrame, lengths: DataFrame, least: float) -> DataFrame:
    """(block, name, other) of near names.  They meet by hashes, and names of one hash are told apart when they are scored."""
    a, b = (_near_keys(forms, lengths, least, side).withColumnRenamed("id", n) for side, n in enumerate(("_a", "_b")))
    met = a.join(b, "key").select("_a", "_b").distinct()
    left = names.where("side = 0").select(F.col("id").alias("_a"), "block", "name")
    right = names.where("side = 1").select(F.col("id").alias("_b"), F.col("block").alias("_block"), F.col("name").alias("other"))
    return met.join(left, "_a").join(right, "_b").where(F.col("block") == F.col("_block")).select("block", "name", "other")


def _part_keys(forms: DataFrame, lengths: DataFrame, least: float) -> DataFrame:
    """(side, block, name, kind, key): the rarest parts of every form that others than near ones can score with, pairs two at a time and
    letters one by one."""
    name = ["side", "block", "name"]
    _, can, near = _reach(F.col("m"), F.col("n"), least)
    others = lengths.select((1 - F.col("side")).alias("side"), "block", F.col("m").alias("n"))
    forms = forms.join(others, ["side", "block"]).where(can & ~near).select(*name, "form").distinct()
    n = F.length("form")
    forms = forms.withColumns({"P": _pairs_inside(F.col("form")), "L": _letters(F.col("form")), "mp": _broken(n, least, 2, 1) + 2, "ml": _broken(n, least, 1, 0) + 1})
    forms = forms.withColumn("odd", F.size("P") < F.col("mp"))
    kinds = F.array(F.struct(F.lit("P").alias("kind"), _numbered(F.col("P")).alias("parts"), F.col("mp").alias("most")), F.struct(F.lit("L").alias("kind"), _numbered(F.col("L")).alias("parts"), F.col("ml").alias("most")))
    rows = forms.select(*name, "form", "odd", F.explode(kinds).alias("k")).select(*name, "form", "odd", "k.kind", "k.most", F.explode("k.parts").alias("x"))
    rows = written(rows.select(*name, "form", "odd", "kind", "most", F.concat("x.p", F.lit("#"), F.col("x.k").cast("string")).alias("p")), "similar-parts")
    common = rows.groupBy("kind", "p").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy(*name, "form", "kind").orderBy("n", "p")  # ties by the part
    kept = rows.join(common, ["kind", "p"]).withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= F.col("most"))
    several = kept.groupBy(*name, "form", "kind", "odd").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    two = F.expr("CASE WHEN size(ps) > 1 THEN flatten(transform(sequence(1, size(ps) - 1), i -> transform(slice(ps, i + 1, size(ps) - i), q -> concat(ps[i - 1], ' ', q)))) ELSE array() END")
    own, other = F.element_at(F.array(*[F.lit(k) for k in _SHORT]), F.col("side") + 1), F.element_at(F.array(*[F.lit(k) for k in _SHORT]), 2 - F.col("side"))
    under = F.when(F.col("kind") == "P", F.array(F.lit(_PAIRS))).when(F.col("odd"), F.array(own, other)).otherwise(F.array(other))
    keys = several.select(*name, F.explode(under).alias("kind"), F.when(F.col("kind") == "P", two).otherwise(F.col("ps")).alias("keys"))
    return keys.select(*name, "kind", F.explode("keys").alias("key"))


def _word_keys(names: DataFrame, least: float) -> DataFrame:
    """(side, block, name, kind, key): all words for the other side's telling ones, and a name's own telling words: its rarest,
    until those left make up too few of its letters to score by themselves."""
    name = ["side", "block", "name"]
    score = least + SHARED_DISCOUNT
    rows = names.select(*name, F.length(F.array_join("set", " ")).alias("_all"), F.explode("set").alias("key"))
    common = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = Window.partitionBy(*name).orderBy("n", "key").rowsBetween(0, Window.unboundedFollowing)
    left = F.sum(F.length("key") + 1).over(rarest) - 1  # letters of this word and those after it, joined
    told = rows.join(common, "key").withColumn("_tells", left >= score / (200.0 - score) * F.col("_all") - _EPS)
    own, other = F.element_at(F.array(*[F.lit(k) for k in _WORD]), F.col("side") + 1), F.element_at(F.array(*[F.lit(k) for k in _WORD]), 2 - F.col("side"))
    return told.select(*name, F.explode(F.when(F.col("_tells"), F.array(own, other)).otherwise(F.array(other))).alias("kind"), "key")


def _meet(keys: DataFrame, names: DataFrame, kept: Callable[[Column, Column], Column], label: str) -> DataFrame:
    """(block, name, other) of the names that share a key, where ``kept`` holds of what is seen of them."""
    keys = written(keys.distinct(), label)
    a, b = keys.where("side = 0").drop("side"), keys.where("side = 1").drop("side").withColumnRenamed("name", "other")
    met = a.join(b, ["block", "kind", "key"]).select("block", "name", "other").distinct()
    left = names.where("side = 0").select("block", "name", F.col("x").alias("l"))
    right = names.where("side = 1").select("block", F.col("name").alias("other"), F.col("x").alias("r"))
    return met.join(left, ["block", "name"]).join(right, ["block", "other"]).where(kept(F.col("l"), F.col("r"))).select("block", "name", "other")


def candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, name, other): different pairs of a block's names, with all that ``token_score`` gives ``least`` or more.

    Both sides have ``block`` and ``name``; rows with a null name or block meet nothing.
    """
    names = written(_names(left, 0).unionByName(_names(right, 1)), "similar-names")
    forms = _forms(names)
    lengths = written(forms.select("side", "block", "m").distinct(), "similar-lengths")
    met = _near(names, forms, lengths, least)
    seen = F.struct("set", F.length(F.array_join("set", " ")).alias("u"))
    if least + SHARED_DISCOUNT <= 100:
        met = met.unionByName(_meet(_word_keys(names, least), names.withColumn("x", seen), lambda a, b: _words_score(a, b, least), "similar-words"))
    _, can, near = _reach(F.col("m"), F.col("n"), least)
    both = lengths.where("side = 0").select("block", "m").join(lengths.where("side = 1").select("block", F.col("m").alias("n")), "block")
    if not both.where(can & ~near).isEmpty():
        letters = _numbered(_letters(F.array_join("ws", " ")))
        whole = F.struct("set", seen["u"].alias("u"), F.length(F.array_join("ws", " ")).alias("n"), F.transform(letters, lambda x: F.concat(x["p"], x["k"].cast("string"))).alias("letters"))
        met = met.unionByName(_meet(_part_keys(forms, lengths, least), names.withColumn("x", whole), lambda a, b: _may_score(a, b, least), "similar-keys"))
    return met.distinct()


def _words_score(a: Column, b: Column, least: float) -> Column:
    """False only for pairs whose shared words alone cannot reach ``least``, by their length."""
    both = F.length(F.array_join(F.array_intersect(a["set"], b["set"]), " "))
    return (both > 0) & (200.0 * both / (both + F.least(a["u"], b["u"])) >= least + SHARED_DISCOUNT - _EPS)


def _may_score(a: Column, b: Column, least: float) -> Column:
    """False only for pairs that cannot reach ``least``: by the letters that both have, and by the length of their shared words."""
    shared = F.size(F.array_intersect(a["letters"], b["letters"])) 
    spaces = F.least(a["n"] - F.size(a["letters"]), b["n"] - F.size(b["letters"]))
    letters = 200.0 * (shared + spaces) / F.greatest(a["u"] + b["u"], F.lit(1)) >= least - _EPS
    return letters | _words_score(a, b, least)


#: Marked so that no filter on the score is moved below it, where pairs would be scored again.
_score = F.pandas_udf(similarity.func, DoubleType()).asNondeterministic()


def scored(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(block, name, other, score) of the candidates that score ``least`` or more; each pair of names is scored once."""
    pairs = written(candidates(left, right, least), "similar-pairs")
    null = F.lit(None).cast("string")
    once = pairs.select("name", "other").distinct().withColumn("score", _score(F.col("name"), F.col("other"), null)).where(F.col("score") >= least)
    return pairs.join(once, ["name", "other"]).select("block", "name", "other", "score")
