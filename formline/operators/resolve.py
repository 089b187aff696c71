"""Entity resolution by a ladder of blocked matches: no pair is scored outside a block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.functions.text import sorted_similarity
from formline.operators import similar
from formline.operators.spread import null_safe_join
from formline.sources.staging import written


#: By how much at least the score that is asked for goes down in a step.
STEP = 3.0


def _candidates(right: DataFrame, name: str, code: str, keep: Sequence[str], second: str | None, role: str | None) -> DataFrame:
    """The right side's names, second names and roles under names of their own; missing ones are null."""
    null = F.lit(None).cast("string")
    return right.select(
        *keep, F.col(name).alias("_name"), F.col(code).alias("_code"), (F.col(second) if second else null).alias("_second"),
        (F.col(role) if role else null).alias("_role")
    )


def _sane(df: DataFrame, role: str | None) -> Column:
    """True where roles agree or the left one is unknown."""
    return F.coalesce(F.col(role) == F.col("_role"), F.lit(True)) if role and role in df.columns else F.lit(True)


def _close(name: Column, least: float) -> Column:
    """False only for pairs that cannot reach ``least``: a ratio bounds how lengths differ."""
    bound = least / (200.0 - least)
    a, b = F.length(name), F.length("_name")
    return F.least(a, b) >= bound * F.greatest(a, b) - 1e-9


def _asked(left: DataFrame, block: str, name: str, role: str | None) -> list[str]:
    """The columns that decide what a left row is matched with: rows that agree in them have the same answer."""
    return [block, name, *([role] if role and role in left.columns else [])]


def _known(left: DataFrame, found: DataFrame, keys: Sequence[str], block: str, name: str, role: str | None) -> DataFrame:
    """(keys, _exact, _alone): of each asked name the smallest code in its block, and the code where all its rows have one."""
    asks = left.where(F.col(name).isNotNull()).select(*keys).distinct()
    codes = [F.min("_code").alias("_lo"), F.max("_code").alias("_hi")]
    everywhere = asks.join(found.groupBy(F.col("_name").alias(name), "_role").agg(*codes), name).where(_sane(asks, role))
    here = asks.join(found.groupBy(F.col("_name").alias(name), block, "_role").agg(*codes), [name, block]).where(_sane(asks, role))
    none = F.lit(None)
    both = everywhere.select(*keys, "_lo", "_hi", none.alias("_here")).unionByName(here.select(*keys, none.alias("_lo"), none.alias("_hi"), F.col("_lo").alias("_here")))
    return both.groupBy(*keys).agg(F.min("_here").alias("_exact"), F.when(F.min("_lo") == F.max("_hi"), F.min("_lo")).alias("_alone"))


def _sure(left: DataFrame, found: DataFrame, keys: Sequence[str], block: str, name: str, least: float, margin: float, role: str | None) -> DataFrame:
    """(keys, _code, score): each asked name's best candidate of its block and role where its score is high enough and far enough
    ahead of the next candidate's.

    Only different names meet, and of the candidates that share a name, block and role the two smallest codes: any other has two
    ahead of it, so it is neither the best nor the next.  Scores are asked for from the top down, step by step: a name whose best and
    next are known is asked no more, so low scores, which much of a large block can have, are looked for by few names.
    """
    asks = written(left.where(F.col(block).isNotNull() & F.col(name).isNotNull()).select(*keys).distinct(), "resolve-asked")
    called = found.select(block, "_code", "_role", F.explode(F.array_distinct(F.array_compact(F.array("_name", "_second")))).alias("_other")).distinct()
    first = Window.partitionBy(block, "_other", "_role").orderBy("_code")
    called = called.withColumn("_r", F.row_number().over(first)).where("_r <= 2").drop("_r")
    called = written(called.join(asks.select(block).distinct(), block, "left_semi"), "resolve-called")
    asks = asks.join(called.select(block).distinct(), block, "left_semi")
    step = max(margin, STEP)
    sure, down = [], max(least - margin, 100.0 - 2 * step)
    while True:
        sides = [x.select(F.col(block).alias("block"), F.col(n).alias("name")) for x, n in ((asks, name), (called, "_other"))]
        scores = similar.scored(*sides, down).select(F.col("block").alias(block), F.col("name").alias(name), F.col("other").alias("_other"), "score")
        pairs = asks.join(scores, [block, name]).join(called, [block, "_other"]).where(_sane(asks, role))
        by = pairs.groupBy(*keys, "_code").agg(F.max("score").alias("score"))
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "_code")
        best = by.withColumns({"_r": F.row_number().over(w), "_next": F.lead("score").over(w)}).where("_r = 1")
        ahead = F.col("score") - F.coalesce("_next", F.lit(0.0))
        if down <= least - margin:
            sure.append(best.where((F.col("score") >= least) & (ahead >= margin)).select(*keys, "_code", "score"))
            break
        # what is next is known, or so low that it can't matter
        known = written(best.where(F.col("_next").isNotNull() | (F.col("score") - down >= margin)), "resolve-known")
        sure.append(known.where((F.col("score") >= least) & (ahead >= margin)).select(*keys, "_code", "score"))
        asks = written(null_safe_join(asks, known.select(*keys), keys, "left_anti"), "resolve-asked")
        if asks.isEmpty():
            break
        down = max(least - margin, down - step)
    out = sure[0]
    for s in sure[1:]:
        out = out.unionByName(s)
    return out


def resolve(left: DataFrame, right: DataFrame, overrides: DataFrame, block: str = "team", name: str = "name", uid: str = "uid", code: str = "code",
            least: float = 88.0, margin: float = 3.0, second: str | None = None, role: str | None = None) -> DataFrame:
    """(uid, code, method, confidence) for every left row.

    In turn: an override; an exact name in the block (1.0; of several the smallest code); a name that one
    right row has (0.95); the best score within the block, against the name or the ``second`` one, if at
    least ``least`` and ``margin`` ahead of the runner-up (score / 100 - 0.05, two places); else unmatched.
    Where ``role`` is given, rows of another known role are no candidates.  Only rows that nothing exact
    matched are scored, against those of their block that an index of rare parts says can reach ``least - margin``.
    """
    found = _candidates(right, name, code, [block], second, role)
    keys = _asked(left, block, name, role)
    over = overrides.select(F.col(uid), F.col(code).alias("_over"))
    ladder = null_safe_join(left.join(over, uid, "left"), _known(left, found, keys, block, name, role), keys)
    method = F.when(F.col("_over").isNotNull(), "override").when(F.col("_exact").isNotNull(), "exact").when(F.col("_alone").isNotNull(), "unique_name")
    ladder = written(ladder.select(uid, *keys, F.coalesce("_over", "_exact", "_alone").alias("_code"), method.alias("method")), "resolve-ladder")
    done = ladder.where("method is not null").select(uid, F.col("_code").alias("code"), "method", F.when(F.col("method") == "unique_name", 0.95).otherwise(1.0).alias("confidence"))
    rest = ladder.where("method is null").select(uid, *keys)
    fuzzy = _sure(rest, found, keys, block, name, least, margin, role).select(*keys, F.col("_code").alias("code"), F.lit("fuzzy").alias("method"), F.round(F.col("score") / 100 - 0.05, 2).alias("confidence"))
    out = null_safe_join(rest, fuzzy, keys).select(uid, "code", F.coalesce("method", F.lit("unmatched")).alias("method"), "confidence")
    return done.unionByName(out)


def claim(left: DataFrame, right: DataFrame, matched: DataFrame, block: str, name: str = "name", uid: str = "uid", code: str = "code",
          least: float = 93.0, margin: float = 3.0, second: str | None = None, role: str | None = None) -> DataFrame:
    """(uid, code, score) between rows that ``matched`` has on neither side: the best of each left row, then the best claimant of each right one."""
    a = left.join(matched.select(uid), uid, "left_anti")
    b = _candidates(right.join(matched.select(code), code, "left_anti"), name, code, [block], second, role)
    keys = _asked(a, block, name, role)
    first = a.groupBy(*keys).agg(F.min(uid).alias(uid))  # of rows with one answer the first claims it
    claims = null_safe_join(first, _sure(a, b, keys, block, name, least, margin, role), keys, "inner")
    v = Window.partitionBy("_code").orderBy(F.desc("score"), uid)
    return claims.withColumn("_c", F.row_number().over(v)).where("_c = 1").select(uid, F.col("_code").alias("code"), "score")


#: Names of at most LETTERS letters that are at most NEAR letters apart meet by what is left when letters are taken out.
NEAR, LETTERS = 2, 32


def _form(name: Column) -> Column:
    """The name with its words in order and single spaces, as its score reads it."""
    return F.array_join(F.array_sort(F.filter(F.split(name, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")), " ")


def _without(form: Column, letters: int) -> Column:
    """The different strings that are left when so many letters are taken out."""
    one = lambda s: F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))).otherwise(F.array().cast("array<string>"))
    out = F.array(form)
    for _ in range(letters):
        out = F.array_distinct(F.flatten(F.transform(out, one)))
    return out


def _left_over(forms: DataFrame, distance: int, least: float, side: int) -> DataFrame:
    """The forms' columns with (x, key): what is left of a form when it gives up its part of ``distance`` letters, x of them being the left
    side's; only where a partner at that distance can score ``least``."""
    parts = []
    for x in range(distance + 1):
        own, other = (x, distance - x) if side == 0 else (distance - x, x)
        can = distance <= (1 - least / 100) * (2 * F.length("form") - own + other) + 1e-9
        parts.append(forms.where(can).select("*", F.lit(x).alias("x"), F.explode(_without(F.col("form"), own)).alias("key")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _nearest(asked: DataFrame, called: DataFrame, distance: int, least: float) -> DataFrame:
    """(form, _code) of the asked forms whose nearest called one is ``distance`` letters away and scores ``least``; none may be nearer.

    Forms so far apart have a string in common after x letters of the asked one and the rest of the other are taken out.
    All that is asked of a string is its smallest code, so no pair of forms is made.
    """
    lengths = asked.select(F.length("form").alias("_n")).distinct()  # no more than the longest form has letters
    known = _left_over(called, distance, least, 1).withColumn("_n", F.length("form") - distance + 2 * F.col("x"))
    known = known.join(F.broadcast(lengths), "_n", "left_semi").groupBy("x", "key").agg(F.min("_code").alias("_code"))
    n = F.length("form")
    both = 2 * n + distance - 2 * F.col("x")  # letters of the two forms
    score = F.when(both > 0, 200.0 * (n - F.col("x")) / F.greatest(both, F.lit(1))).otherwise(100.0)
    met = _left_over(asked.select("form"), distance, least, 0).withColumn("score", score).join(known, ["x", "key"])
    return met.where(F.col("score") >= least).groupBy("form").agg(F.min(F.struct((-F.col("score")).alias("s"), "_code")).alias("b")).select("form", "b._code")


def _grams(name: Column) -> Column:
    """Distinct three-letter runs of a form; a shorter one is one run."""
    n = F.length(name)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substr(name, i, F.lit(3)))
    return F.array_distinct(runs)


def _rarest(df: DataFrame, key: Sequence[str], name: str, common: DataFrame, least: float) -> DataFrame:
    """(key, gram): of each name as many of its rarest runs as guarantee that names of ``least`` share one of them.

    Such names are apart by at most d letters in or out, d being a share of their lengths, and each of these
    breaks three runs, so all but 3 d of a name's runs are shared: the 3 d + 1 rarest of both hold a shared one.
    """
    apart = 1 - least / 100
    most = F.floor(3 * F.floor(apart * (1 + 1 / (least / (200 - least))) * F.length(name) + 1e-9)) + 1
    rows = df.select(*key, most.alias("_most"), F.explode(_grams(F.col(name))).alias("gram")).join(common, "gram", "left")
    w = Window.partitionBy(*key).orderBy(F.coalesce("n", F.lit(0)), "gram")
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("_most")).select(*key, "gram")


def _by_runs(asked: DataFrame, called: DataFrame, least: float) -> DataFrame:
    """(form, _code): the best called form of ``least`` by shared runs, for forms that are long or further apart than ``NEAR``."""
    other = called.select("_code", F.col("form").alias("_name"))
    common = other.select(F.explode(_grams(F.col("_name"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    pairs = _rarest(asked, ["form"], "form", common, least).join(_rarest(other, ["_code", "_name"], "_name", common, least), "gram").select("form", "_code", "_name").distinct()
    pairs = pairs.withColumn("_second", F.lit(None).cast("string")).where(_close(F.col("form"), least))
    scored = pairs.withColumn("score", sorted_similarity(F.col("form"), F.col("_name"), F.col("_second")))
    return scored.where(F.col("score") >= least).groupBy("form").agg(F.min(F.struct((-F.col("score")).alias("s"), "_code")).alias("b")).select("form", "b._code")


def _best_form(asked: DataFrame, called: DataFrame, least: float) -> DataFrame:
    """(form, _code) of each asked form that a called one scores ``least`` (90 or more) against: the best, ties to the smaller code.

    By distance, nearest first: at these scores any form d letters away beats every one further away, as d (d + 1) is less
    than the form's letters, so a form that is found is asked no more.
    """
    short = asked.where(F.length("form") <= LETTERS - NEAR)  # all within NEAR letters of them have at most LETTERS
    near = called.where(F.length("form") <= LETTERS)
    found = []
    for distance in range(NEAR + 1):
        found.append(written(_nearest(short, near, distance, least), "alias-near"))
        short = written(short.join(found[-1], "form", "left_anti"), "alias-rest")
        if short.isEmpty():
            break
    further = NEAR + 1 <= (1 - least / 100) * (2 * F.length("form") + NEAR + 1) + 1e-9
    far = written(short.where(further).unionByName(asked.where(F.length("form") > LETTERS - NEAR)), "alias-far")
    if not far.isEmpty():
        found.append(_by_runs(far, called, least))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def alias(names: DataFrame, known: DataFrame, name: str = "name", code: str = "code", second: str | None = None, least: float = 93.0) -> DataFrame:
    """(name, code, method) of each distinct name: the one known row of that very name; none where several have it
    (``ambiguous``); else the best sorted-words score of at least ``least`` (90 or more), ties to the smaller code.

    Short names meet what they are nearest to by the strings left when letters are taken out; long ones, and those further off, are
    scored with what they share rare three-letter runs with.  Neither leaves a pair of ``least`` out.
    """
    asked = names.select(F.col(name).alias("name")).where(F.col(name).isNotNull()).distinct()
    found = _candidates(known, name, code, [], second, None)
    exact = found.groupBy(F.col("_name").alias("name")).agg(F.count(F.lit(1)).alias("_n"), F.min("_code").alias("_code"))
    told = asked.join(exact, "name", "left")
    method = F.when(F.col("_n") == 1, "exact").otherwise("ambiguous")
    sure = told.where("_n is not null").select("name", F.when(F.col("_n") == 1, F.col("_code")).alias("code"), method.alias("method"))
    rest = written(told.where("_n is null").select("name", _form(F.col("name")).alias("form")), "alias-asked")
    other = found.select("_code", F.explode(F.array_distinct(F.array_compact(F.array("_name", "_second")))).alias("_name"))
    called = written(other.groupBy(_form(F.col("_name")).alias("form")).agg(F.min("_code").alias("_code")), "alias-called")
    best = _best_form(rest.select("form").distinct(), called, least)
    fuzzy = rest.join(best.withColumnRenamed("_code", "code"), "form", "left")
    return sure.unionByName(fuzzy.select("name", "code", F.when(F.col("code").isNotNull(), "fuzzy").otherwise("unmatched").alias("method")))


def match_rate(df: DataFrame, season: str, weight: str, matched: str) -> DataFrame:
    """Weighted share of matched rows per season."""
    hit = F.when(F.col(matched), F.col(weight)).otherwise(0)
    return df.groupBy(season).agg(F.sum(weight).alias("weight"), F.try_divide(F.sum(hit), F.sum(weight)).alias("rate"))


def top_unmatched(df: DataFrame, weight: str, matched: str, tie: str, n: int = 20) -> DataFrame:
    """The n unmatched rows of most weight."""
    return df.where(~F.coalesce(F.col(matched), F.lit(False))).orderBy(F.desc_nulls_last(weight), tie).limit(n)
