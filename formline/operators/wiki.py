"""Page markup to rows: squads, appearances, goals and the dates of countries.

Every line is read once into its parts, whatever they are: templates with their arguments, links, a field's name and
value, bold words, table cells.  What a part means is looked up in ``ROLES``; what a line means follows from the
latest part of some kind before it, which a running window over the page's lines carries along.  A page is
a few thousand lines, so a window over one page is small; pages are spread.  Nothing that is read from a match block
follows from lines before it, so larger pages may come as rows of parts, cut where blocks start: ``page`` then
names several columns, that of the page and those that tell its parts apart, and ``block`` counts inside a part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names of templates, from the markup's documentation, and what they stand for.
ROLES = {
    "football box": "match", "#invoke:football box/main": "match", "football kit": "kit", "start date": "date", "goal": "goal", "og": "own goal", "subon": "on", "suboff": "off",
    "nat fs player": "member", "nat fs g player": "member",
}
# Words that mark an own goal once all but letters is taken away, and minutes of a match without and with extra time.
OWN_GOAL = ("og", "owngoal")
FULL, EXTRA = 90, 120
# What a parse must reach to be trusted.
LEAST_PARSED, SLOTS, GOALS = 0.95, (24, 42), (1.5, 4.0)

_CLOSED = r"\{\{([^{}]*)\}\}"
_MINUTE = r"^[0-9]+(\+[0-9]+)?$"


def _names(page: str | Sequence[str]) -> list[str]:
    return [page] if isinstance(page, str) else list(page)


def _template(raw: Column) -> Column:
    """(role, args) of what stands between a template's braces."""
    parts = F.transform(F.split(raw, r"\|"), lambda x: F.trim(x))
    name = F.lower(F.get(parts, 0))
    name = F.when(name.startswith("#"), F.concat_ws("/", name, F.lower(F.get(parts, 1)))).otherwise(name)
    name = F.regexp_replace(name, r":\s+", ":")
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.struct(F.try_element_at(known, name).alias("role"), F.slice(parts, 2, 1000).alias("args"))


def lines(df: DataFrame, page: str | Sequence[str] = "page", text: str = "wikitext") -> DataFrame:
    """(page, line_no, line, templates, links, field, value, bold): every line with its parts.

    ``templates`` has those that close on their line and those that open on it, ``links`` the names that links show (the
    label, or the target without a last part in brackets); ``field`` is the name in ``| name = value`` or null.
    """
    rows = df.select(*_names(page), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    opened = F.regexp_extract_all(F.regexp_replace("line", _CLOSED, ""), F.lit(r"\{\{([^{}]*)"), 1)
    whole = F.concat(F.regexp_extract_all("line", F.lit(_CLOSED), 1), opened)
    shown = F.transform(
        F.regexp_extract_all("line", F.lit(r"\[\[([^\[\]]+)\]\]"), 1),
        lambda x: F.trim(F.when(x.contains("|"), F.substring_index(x, "|", -1)).otherwise(F.regexp_replace(x, r"\s*\([^()]*\)\s*$", ""))),
    )
    named = lambda i: F.regexp_extract("line", r"^\s*\|\s*([A-Za-z_]+[0-9]*)\s*=(.*)$", i)
    return rows.withColumns({
        "templates": F.transform(whole, _template), "links": shown, "field": F.lower(F.nullif(named(1), F.lit(""))), "value": F.trim(named(2)),
        "bold": F.transform(F.regexp_extract_all("line", F.lit("'''([^']+)'''"), 1), lambda x: F.lower(F.trim(x))),
    })


def _of(role: str) -> Column:
    return F.filter("templates", lambda t: t["role"] == role)


def _has(role: str) -> Column:
    return F.exists("templates", lambda t: t["role"] == role)


def _latest(mark: Column, keys: Sequence[str]) -> Column:
    """The mark of the latest line, this one included, that has one."""
    return F.last(mark, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("line_no"))


def squads(df: DataFrame, page: str = "page", text: str = "wikitext") -> DataFrame:
    """(page, country, name, line_no): each player line under the country heading before it."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("line", r"^===([^=].*?)===\s*$", 1), _CLOSED, ""), r"[\[\]]", ""))
    rows = lines(df, page, text).withColumn("country", _latest(F.nullif(title, F.lit("")), [page]))
    given = F.get(F.filter(F.flatten(F.transform(_of("member"), lambda t: t["args"])), lambda a: a.startswith("name=")), 0)
    name = F.coalesce(F.get("links", 0), F.trim(F.substring(given, 6, 1000)))
    return rows.where(_has("member") & F.col("country").isNotNull()).withColumn("name", name).where("name != ''").select(page, "country", "name", "line_no")


def match_lines(df: DataFrame, page: str | Sequence[str] = "page", text: str = "wikitext") -> DataFrame:
    """Lines of match blocks with ``block`` (1, 2, ... on the page), ``match_date`` and ``full_time``; blocks without a date are left out."""
    block = F.sum(_has("match").cast("int")).over(Window.partitionBy(*_names(page)).orderBy("line_no"))
    rows = lines(df, page, text).withColumn("block", block).where("block > 0")
    one = Window.partitionBy(*_names(page), "block")
    part = lambda i: F.get(F.get(_of("date"), 0)["args"], i).try_cast("int")
    day = F.when(F.col("field") == "date", F.try_to_date(F.format_string("%04d-%02d-%02d", part(0), part(1), part(2))))
    extra = F.max(((F.col("field") == "aet") & F.lower("value").startswith("y")).cast("int")).over(one)
    rows = rows.withColumns({"match_date": F.min_by(day, F.when(day.isNotNull(), F.col("line_no"))).over(one), "full_time": F.when(extra == 1, EXTRA).otherwise(FULL)})
    return rows.where("match_date is not null")


def appearances(df: DataFrame, page: str | Sequence[str] = "page", text: str = "wikitext") -> DataFrame:
    """(page, block, match_date, name, started, minutes): one row per player who was on the pitch.

    The substitutions' heading makes the rows after it substitutes, a manager's ends a team; what follows the second
    team is no line-up.  An off-mark ends a player's time, an on-mark starts a substitute's; substitutes without
    one did not play.  Of two rows with one name in a block the later counts.
    """
    rows = match_lines(df, page, text)
    keys = [*_names(page), "block"]
    manager, bench = F.exists("bold", lambda b: b.startswith("manager")), F.exists("bold", lambda b: b.startswith("substitut"))
    so_far = Window.partitionBy(*keys).orderBy("line_no")
    mark = F.when(bench, True).when(manager | F.col("line").startswith("{|"), False)
    rows = rows.withColumns({"_bench": F.coalesce(_latest(mark, keys), F.lit(False)), "_teams": F.sum(manager.cast("int")).over(so_far)})
    cells = F.transform(F.split("line", r"\|\|"), lambda x: F.trim(x))
    rows = rows.where((F.col("_teams") < 2) & F.get(cells, 0).rlike(r"^\|\s*[A-Z]{2}$") & F.get(cells, 1).rlike(r"^('''|)[0-9]+('''|)$"))
    minute = lambda role: F.get(F.get(_of(role), 0)["args"], 0).try_cast("int")
    rows = rows.withColumns({"name": F.get("links", 0), "on": minute("on"), "off": minute("off")}).where("name is not null and (not _bench or on is not null)")
    came = F.when(F.col("_bench"), F.col("on")).otherwise(0)
    played = F.struct((~F.col("_bench")).alias("started"), F.greatest(F.coalesce("off", "full_time") - came, F.lit(0)).alias("minutes"))
    by = rows.groupBy(*keys, "match_date", "name").agg(F.max_by(played, "line_no").alias("p"))
    return by.select(*keys, "match_date", "name", "p.started", "p.minutes")


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def _credited() -> Column:
    """Goals that a bullet credits its player with: the minutes of its goal marks, or bare minutes where it has none.

    A mark with an own-goal word among its arguments counts nothing, nor do bare minutes beside such a word.
    """
    own = lambda args: F.exists(args, lambda a: _letters(a).isin(*OWN_GOAL))
    scored = F.transform(F.filter(_of("goal"), lambda t: ~own(t["args"])), lambda t: F.size(F.filter(t["args"], lambda a: a.rlike(_MINUTE))))
    words = F.split(F.regexp_replace("line", r"\[\[[^\[\]]*\]\]", " "), r"[\s|{}]+")
    pairs = F.transform(words, lambda w, i: F.concat(_letters(w), F.coalesce(_letters(F.get(words, i + 1)), F.lit(""))))
    spoilt = _has("own goal") | F.exists(words, lambda w: _letters(w).isin(*OWN_GOAL)) | F.exists(pairs, lambda w: w.isin(*OWN_GOAL))
    bare = F.size(F.regexp_extract_all("line", F.lit(r"([0-9]+(?:\+[0-9]+)?)'"), 1))
    return F.when(_has("goal"), F.aggregate(scored, F.lit(0), lambda a, n: a + n)).when(spoilt, 0).otherwise(bare)


def goals(df: DataFrame, page: str | Sequence[str] = "page", text: str = "wikitext") -> DataFrame:
    """(page, block, name, goals) from the bullets in the two goal fields of each block, players without a goal left out."""
    rows = match_lines(df, page, text)
    keys = [*_names(page), "block"]
    mark = F.when(F.col("field").isNotNull(), F.col("field")).when(F.ltrim("line").startswith("}}"), "")
    bullet = F.when(F.col("field").isNotNull(), F.col("value")).otherwise(F.ltrim("line")).startswith("*")
    rows = rows.withColumn("_in", _latest(mark, keys)).where(F.col("_in").isin("goals1", "goals2") & bullet & (F.size("links") > 0))
    by = rows.groupBy(*keys, F.get("links", 0).alias("name")).agg(F.sum(_credited()).cast("int").alias("goals"))
    return by.where("goals > 0")


def country_dates(df: DataFrame, page: str | Sequence[str] = "page", text: str = "wikitext") -> DataFrame:
    """(country, last_match): the latest match of each country, by the titles of a block's first two kits; blocks without line-ups don't count."""
    rows = match_lines(df, page, text)
    keys = [*_names(page), "block"]
    opens = F.when(F.size("templates") > 0, F.get(F.filter("templates", lambda t: t["role"].isin("kit", "match")), 0)["role"])
    inline = F.get(F.filter(F.flatten(F.transform(_of("kit"), lambda t: t["args"])), lambda a: a.rlike(r"^title\s*=")), 0)
    title = F.coalesce(F.regexp_replace(inline, r"^title\s*=\s*", ""), F.when((F.col("field") == "title") & (_latest(opens, keys) == "kit"), F.regexp_extract("value", r"^([^<|}]*)", 1)))
    rows = rows.withColumn("country", F.nullif(F.trim(title), F.lit(""))).where("country is not null")
    first_two = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("line_no"))).where("_r <= 2")
    parsed = appearances(df, page, text).select(*keys).distinct()
    return first_two.join(parsed, keys, "left_semi").groupBy("country").agg(F.max("match_date").alias("last_match"))


def tournament_totals(seen: DataFrame, scored: DataFrame, page: str | Sequence[str] = "page") -> DataFrame:
    """Per name: minutes, matches, starts, goals and the last match date."""
    keyed = seen.join(scored, [*_names(page), "block", "name"], "left")
    return keyed.groupBy("name").agg(
        F.sum("minutes").alias("minutes"), F.count(F.lit(1)).alias("matches"), F.count_if("started").alias("starts"),
        F.sum(F.coalesce("goals", F.lit(0))).alias("goals"), F.max("match_date").alias("last_match")
    )


def health(seen: DataFrame, scored: DataFrame, expected: Column, page: str | Sequence[str] = "page") -> DataFrame:
    """One row: blocks parsed, players and goals per parsed block, the parsed share of the ``expected`` number, and whether all are plausible."""
    blocks = seen.groupBy(*_names(page), "block").agg(F.count(F.lit(1)).alias("slots"))
    marks = scored.join(blocks.select(*_names(page), "block"), [*_names(page), "block"], "left_semi").agg(F.coalesce(F.sum("goals"), F.lit(0)).alias("goals"))
    both = blocks.agg(F.count(F.lit(1)).alias("parsed"), F.coalesce(F.sum("slots"), F.lit(0)).alias("slots")).crossJoin(F.broadcast(marks))  # one row each
    some = F.greatest("parsed", F.lit(1))
    both = both.select("parsed", (F.col("slots") / some).alias("slots"), (F.col("goals") / some).alias("goals"), F.try_divide(F.col("parsed"), expected).alias("share"))
    return both.withColumn("healthy", F.coalesce((F.col("share") >= LEAST_PARSED) & F.col("slots").between(*SLOTS) & F.col("goals").between(*GOALS), F.lit(False)))


def enrich(squad: DataFrame, totals: DataFrame, name: str = "name", country: str = "country", dates: DataFrame | None = None) -> DataFrame:
    """Squad rows with their totals; who did not appear gets zeros and the country's last match date: that of ``dates``
    (country, last_match) where given, else the latest of its members'."""
    joined = squad.join(totals, name, "left")
    if dates is None:
        last = F.max("last_match").over(Window.partitionBy(country))
    else:
        joined = joined.join(dates.select(F.col("country").alias(country), F.col("last_match").alias("_last")), country, "left")
        last = F.col("_last")
    made = joined.withColumn("last_match", F.coalesce("last_match", last)).fillna(0, ["minutes", "matches", "starts", "goals"])
    return made.drop("_last")
