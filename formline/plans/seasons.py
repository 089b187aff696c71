"""Season totals, priors, shrinkage and parameter fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.operators import fits, seasons as A
from formline.plans.tables import query, r6, yearly

_TOTALS = """{fy}, t AS (SELECT entity, year, sum(points) AS points, sum(minutes) AS exposure, count(points) AS games, count(*) FILTER (minutes >= 60) AS starts,
  sum(stat) AS stat_sum, sum(CASE WHEN stat IS NOT NULL THEN minutes END) AS stat_exposure FROM fy GROUP BY entity, year)"""


def _totals(spark, d):
    return A.season_totals(yearly(spark, d), ["entity"], "year", "points", "minutes", ["stat"], 60)


@query(f"""WITH {_TOTALS} SELECT entity, year::INTEGER AS year, round(points, 2) AS points, exposure::BIGINT AS exposure, games, starts,
  round(stat_sum, 4) AS stat_sum, stat_exposure::BIGINT AS stat_exposure FROM t""")
def a1_season_totals(spark, d):
    return _totals(spark, d).select(
        "entity", "year", F.round("points", 2).alias("points"), "exposure", "games", "starts", F.round("stat_sum", 4).alias("stat_sum"),
        "stat_exposure"
    )


@query(f"""WITH {_TOTALS} SELECT entity, year::INTEGER AS year, round(CASE WHEN sum(exposure) OVER w2 >= 200 THEN sum(points) OVER w2 / sum(games) OVER w2 END,
  4) AS ppg2, round(CASE WHEN sum(exposure) OVER w3 >= 200 THEN sum(points) OVER w3 / sum(games) OVER w3 END, 4) AS ppg3 FROM t
WINDOW w2 AS (PARTITION BY entity ORDER BY year RANGE BETWEEN 2 PRECEDING AND 1 PRECEDING),
  w3 AS (PARTITION BY entity ORDER BY year RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def a2_trailing_years(spark, d):
    return _totals(spark, d).select(
        "entity", "year", F.round(A.trailing_rate(["entity"], "year", 2, least=200), 4).alias("ppg2"),
        F.round(A.trailing_rate(["entity"], "year", 3, least=200), 4).alias("ppg3")
    )


@query(f"""WITH {_TOTALS} SELECT a.entity, a.year::INTEGER AS year, round(b.points / b.games, 4) AS prev_ppg, round(b.exposure / 3420, 6) AS prev_share,
  b.starts AS prev_starts, round(c.points / c.games, 4) AS ppg_two_back,
  count(*) OVER (PARTITION BY a.entity ORDER BY a.year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS experience
FROM t a LEFT JOIN t b ON b.entity = a.entity AND b.year = a.year - 1 LEFT JOIN t c ON c.entity = a.entity AND c.year = a.year - 2""")
def a3_j8_previous_season(spark, d):
    t = _totals(spark, d).withColumn("ppg", F.col("points") / F.col("games"))
    two = F.max("ppg").over(A.Window.partitionBy("entity").orderBy("year").rangeBetween(-2, -2))
    seen = F.count(F.lit(1)).over(A.Window.partitionBy("entity").orderBy("year").rangeBetween(A.Window.unboundedPreceding, -1))
    return t.select(
        "entity", "year", F.round(A.previous("ppg", ["entity"], "year"), 4).alias("prev_ppg"),
        F.round(A.previous("exposure", ["entity"], "year") / 3420, 6).alias("prev_share"),
        A.previous("starts", ["entity"], "year").alias("prev_starts"), F.round(two, 4).alias("ppg_two_back"), seen.alias("experience")
    )


_LADDER = """l AS (SELECT entity, year, CASE WHEN e1 >= 90 THEN s1 / e1 * 90 WHEN e3 >= 40 THEN s3 / e3 * 90 ELSE s1 / nullif(e1, 0) * 90 END AS prior FROM
(SELECT entity, year, sum(stat_sum) OVER w1 AS s1, sum(stat_exposure) OVER w1 AS e1, sum(stat_sum) OVER w3 AS s3, sum(stat_exposure) OVER w3 AS e3
  FROM t WINDOW w1 AS (PARTITION BY entity ORDER BY year RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING),
  w3 AS (PARTITION BY entity ORDER BY year RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING)))"""


@query(f"WITH {_TOTALS}, {_LADDER} SELECT entity, year::INTEGER AS year, round(prior, 4) AS prior FROM l")
def a4_prior_ladder(spark, d):
    return _totals(spark, d).select("entity", "year", F.round(A.prior_ladder("stat_sum", "stat_exposure", ["entity"], "year", 90, 90, 40), 4).alias("prior"))


_LEAGUE = """cells AS (SELECT year, grp, bucket, sum(stat) AS s, count(stat) AS n FROM fy WHERE stat IS NOT NULL
  GROUP BY ALL), spine AS (SELECT y.year, g.grp, g.bucket, coalesce(s, 0) AS s, coalesce(n, 0) AS n FROM (SELECT DISTINCT year FROM fy) y
  CROSS JOIN (SELECT DISTINCT grp, bucket FROM fy) g LEFT JOIN cells c ON c.year = y.year AND c.grp = g.grp AND c.bucket = g.bucket),
b AS (SELECT year, grp, bucket, sum(s) OVER w AS s, sum(n) OVER w AS n, sum(s) OVER v AS gs, sum(n) OVER v AS gn FROM spine
  WINDOW w AS (PARTITION BY grp, bucket ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  v AS (PARTITION BY grp ORDER BY year RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lp AS (SELECT year, grp, bucket, CASE WHEN n >= 20 THEN s / n WHEN gn > 0 THEN gs / gn END AS prior FROM b)"""


@query(f"WITH {{fy}}, {_LEAGUE} SELECT year::INTEGER AS year, grp, bucket, round(prior, 5) AS prior FROM lp")
def a5_league_prior(spark, d):
    return A.league_prior(yearly(spark, d), "year", "grp", "bucket", "stat").select("year", "grp", "bucket", F.round("prior", 5).alias("prior"))


_BLEND = f"""{{fy}}, {_LEAGUE}, o AS (SELECT id, entity, year, grp, bucket, stat, coalesce(count(stat) OVER w, 0) AS n, avg(stat) OVER w AS cur FROM fy
  WINDOW w AS (PARTITION BY entity, year ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), x AS (SELECT o.*, lp.prior FROM o
  LEFT JOIN lp USING (year, grp, bucket))"""


def _blend_frame(spark, d):
    f = yearly(spark, d)
    w = A.Window.partitionBy("entity", "year").orderBy("id").rowsBetween(A.Window.unboundedPreceding, -1)
    cur = f.withColumns({"n": F.count("stat").over(w), "cur": F.avg("stat").over(w)})
    return cur.join(A.league_prior(f, "year", "grp", "bucket", "stat"), ["year", "grp", "bucket"], "left")


@query(f"""WITH {_BLEND} SELECT id, round(coalesce(n / (n + 6.0) * cur + (1 - n / (n + 6.0)) * prior, cur, prior), 5) AS eb, round(n / (n + 6.0), 6) AS w FROM x""")
def w9_shrinkage_blend(spark, d):
    b, w = A.blend(F.col("cur"), F.col("prior"), F.col("n"), 6)
    return _blend_frame(spark, d).select("id", F.round(b, 5).alias("eb"), r6(w).alias("w"))


@query(f"""WITH {_BLEND}, g AS (SELECT unnest([1.0, 3.0, 10.0, 30.0, 100.0]) AS k),
  u AS (SELECT k, round(sum(pow(stat - coalesce(n / (n + k) * cur + (1 - n / (n + k)) * prior, prior), 2)), 6) AS loss, count(*) AS c FROM x, g
  WHERE prior IS NOT NULL AND stat IS NOT NULL GROUP BY k)
SELECT CASE WHEN max(c) >= 500 THEN arg_min(k, (loss, k)) ELSE 10.0 END::DOUBLE AS k, max(c) AS n_rows FROM u""")
def a25_fit_shrinkage(spark, d):
    return A.fit_strength(_blend_frame(spark, d), [1, 3, 10, 30, 100], "cur", "prior", "n", "stat")


@query("""WITH {fy}, s AS (SELECT entity, year, sum(minutes) AS m, sum(points * c.coef) AS p, max_by(c.coef, id) AS last_coef FROM fy
  JOIN (SELECT grp, 0.5 + row_number() OVER (ORDER BY grp) / 10 AS coef FROM (SELECT DISTINCT grp FROM fy)) c USING (grp) GROUP BY entity, year)
SELECT a.entity, a.year::INTEGER AS year,
  round(CASE WHEN coalesce(b.m, 0) + coalesce(c.m, 0) >= 100 THEN (coalesce(b.p, 0) + coalesce(c.p, 0)) / (coalesce(b.m, 0) + coalesce(c.m,
  0)) * 90 END, 3) AS career, round(coalesce(b.last_coef, c.last_coef), 6) AS coef FROM s a
  LEFT JOIN s b ON b.entity = a.entity AND b.year = a.year - 1 LEFT JOIN s c ON c.entity = a.entity AND c.year = a.year - 2""")
def a6_weighted_career(spark, d):
    f = yearly(spark, d)
    coef = f.select("grp").distinct().withColumn("coef", 0.5 + F.row_number().over(A.Window.orderBy("grp")) / 10)  # five rows
    s = f.join(F.broadcast(coef), "grp").groupBy("entity", "year").agg(
        F.sum("minutes").alias("m"), F.sum(F.col("points") * F.col("coef")).alias("p"), F.max_by("coef", "id").alias("c")
    )
    back = lambda c, n: F.max(c).over(A.Window.partitionBy("entity").orderBy("year").rangeBetween(-n, -n))
    two = lambda c: F.coalesce(back(c, 1), F.lit(0)) + F.coalesce(back(c, 2), F.lit(0))
    return s.select("entity", "year", F.round(F.when(two("m") >= 100, two("p") / two("m") * 90), 3).alias("career"), r6(F.coalesce(back("c", 1), back("c", 2))).alias("coef"))


@query("""WITH a AS (SELECT n_regionkey AS league, avg(s_acctbal) AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
  SELECT league, round(least(greatest(pow(10, (level - (SELECT level FROM a WHERE league = 0)) / 4000), 0.5), 1.0), 6) AS coef FROM a""")
def a7_league_coefficients(spark, d):
    from formline.plans.tables import table

    a = table(spark, d, "supplier").join(
        F.broadcast(table(spark, d, "nation")), F.expr("s_nationkey = n_nationkey")
    ).groupBy(F.col("n_regionkey").alias("league")).agg(F.avg("s_acctbal").alias("level"))
    base = a.where("league = 0").select(F.col("level").alias("base"))
    return a.crossJoin(F.broadcast(base)).select(
        "league", r6(F.least(F.greatest(F.pow(F.lit(10.0), (F.col("level") - F.col("base")) / 4000), F.lit(0.5)), F.lit(1.0))).alias("coef")
    )  # base is one row


@query("""WITH g AS (SELECT l_linenumber % 4 + 1 AS position, floor(l_quantity / 10)::INTEGER AS y, 2.0 + l_discount * 10 AS mu
  FROM lineitem), a AS (SELECT unnest([0.02, 0.1, 0.3, 1.0]) AS alpha),
l AS (SELECT position, alpha, sum(lgamma(y + 1 / alpha) - lgamma(1 / alpha) - lgamma(y + 1) + 1 / alpha * ln(1 / alpha / (1 / alpha + mu)) + y * ln(mu / (1 / alpha + mu))) AS ll,
  count(*) AS n FROM g, a GROUP BY ALL)
SELECT position::INTEGER AS position, arg_max(alpha, ll)::DOUBLE AS alpha, max(n) AS n_rows, round(max(ll), 2) AS ll FROM l GROUP BY position
  HAVING max(n) >= 500""")
def a26_fit_dispersion(spark, d):
    from formline.plans.tables import table

    g = table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 4 + 1).cast("int").alias("position"), F.floor(F.col("l_quantity") / 10).cast("int").alias("y"),
        (2.0 + F.col("l_discount") * 10).alias("mu")
    )
    return fits.fit_dispersion(g, "position", "y", "mu", [0.02, 0.1, 0.3, 1.0]).select("position", "alpha", "n_rows", F.round("ll", 2).alias("ll"))


def _map_sql(diff: str, hfa: str, c: str, s: str) -> str:
    """The rating map's home, draw and away shares in SQL, as a list."""
    draw = f"greatest(least({c} * exp(-pow({diff} + {hfa}, 2) / (2 * {s} * {s})), 0.6), 1e-6)"
    home = f"greatest(1 / (1 + pow(10, -({diff} + {hfa}) / 400)) - {draw} / 2, 1e-6)"
    away = f"greatest(1 - {home} - {draw}, 1e-6)"
    return f"[{home} / ({home} + {draw} + {away}), {draw} / ({home} + {draw} + {away}), {away} / ({home} + {draw} + {away})]"


def _fit_sql(where: str, levels: int = 34) -> str:
    """CTEs that end in ``m`` (hfa, c, s, loss): the least cross-entropy by a grid of five steps a side that closes in, level by level."""
    steps = "(VALUES (-1.0), (-0.5), (0.0), (0.5), (1.0))"
    out = [f"""g AS MATERIALIZED (SELECT o_orderkey AS k, o_totalprice / 1000 - 200 AS diff, (o_totalprice / 1000 - 200) * 0.8 + (o_orderkey % 7 - 3) * 20 AS seen FROM orders),
t AS MATERIALIZED (SELECT k, diff, {_map_sql("seen", "60", "0.26", "250")} AS t FROM g), f AS MATERIALIZED (SELECT * FROM t WHERE {where}),
m0 AS MATERIALIZED (SELECT 50.0::DOUBLE AS hfa, 0.3::DOUBLE AS c, 300.0::DOUBLE AS s, 0.0::DOUBLE AS loss)"""]
    for i in range(levels):
        w = 0.7**i
        grid = f"SELECT hfa + a * {80 * w!r} AS hfa, greatest(c + b * {0.15 * w!r}, 0.01) AS c, greatest(s + d * {150 * w!r}, 10) AS s FROM m{i}, {steps} x(a), {steps} y(b), {steps} z(d)"
        p = _map_sql("diff", "hfa", "c", "s")
        inner = f"SELECT hfa, c, s, t, {p} AS p FROM f, ({grid})"
        out.append(f"m{i + 1} AS MATERIALIZED (SELECT hfa, c, s, avg(-(t[1] * ln(p[1] + 1e-6) + t[2] * ln(p[2] + 1e-6) + t[3] * ln(p[3] + 1e-6))) AS loss FROM ({inner}) GROUP BY hfa, c, s ORDER BY loss, hfa, c, s LIMIT 1)")
    return ",\n".join(out) + f",\nm AS (SELECT * FROM m{levels})"


def _rated(spark, d):
    """Orders as matches: a rating difference and the probabilities that odds on a shifted, noisy difference imply."""
    from formline.operators import scoring as S
    from formline.plans.tables import table

    k, diff = F.col("o_orderkey"), F.col("o_totalprice") / 1000 - 200
    home, draw, away = S.elo_probabilities(diff * 0.8 + (k % 7 - 3) * 20, 60.0, 0.26, 250.0)
    odds = [1 / (1.05 * p) for p in (home, draw, away)]
    return table(spark, d, "orders").select(k.alias("k"), diff.alias("diff"), *[p.alias(n) for p, n in zip(S.implied(*odds), ("home", "draw", "away"), strict=True)])


@query(f"WITH {_fit_sql('true')} SELECT round(hfa, 2) AS hfa, round(c, 4) AS c, round(s, 2) AS s, round(loss, 6) AS loss FROM m")
def a27_fit_elo_map(spark, d):
    """The rating map of least cross-entropy against what odds imply."""
    hfa, c, s, loss = fits.fit_elo_map(_rated(spark, d), "diff", ["home", "draw", "away"])
    one = spark.createDataFrame([(hfa, c, s, loss)], "hfa double, c double, s double, loss double")
    return one.select(F.round("hfa", 2).alias("hfa"), F.round("c", 4).alias("c"), F.round("s", 2).alias("s"), r6("loss").alias("loss"))


_RATES = """fy4 AS (SELECT id, entity, year, grp, minutes, stat, points * 0.001 AS pts, (id % 7 % 3)::INTEGER AS goals, CASE WHEN id % 11 = 0 THEN NULL ELSE (id // 7) % 5 END AS saves FROM fy),
cells AS (SELECT grp, year, sum(stat) AS s1, count(stat) AS n1, sum(pts) AS s2, count(pts) AS n2, sum(goals) AS s3, sum(saves) AS s4, sum(minutes) AS m FROM fy4 GROUP BY ALL),
pri AS (SELECT grp, year, sum(s1) OVER w / sum(n1) OVER w AS p1, sum(s2) OVER w / sum(n2) OVER w AS p2, sum(s3) OVER w / sum(m) OVER w * 90 AS p3, sum(s4) OVER w / sum(m) OVER w * 90 AS p4 FROM cells
  WINDOW w AS (PARTITION BY grp ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT o.*, p1, p2, p3, p4, count(stat) OVER w AS n1, avg(stat) OVER w AS c1, count(pts) OVER w AS n2, avg(pts) OVER w AS c2, coalesce(sum(minutes) OVER w, 0) / 90 AS e,
  sum(goals) OVER w / nullif(sum(minutes) OVER w, 0) * 90 AS c3, sum(saves) OVER w / nullif(sum(minutes) OVER w, 0) * 90 AS c4 FROM fy4 o LEFT JOIN pri USING (grp, year)
  WINDOW w AS (PARTITION BY entity ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT unnest([{'stat': 'stat', 'cur': c1, 'prior': p1, 'n': n1::DOUBLE, 'y': stat, 'ex': NULL}, {'stat': 'points', 'cur': c2, 'prior': p2, 'n': n2::DOUBLE, 'y': pts, 'ex': NULL},
  {'stat': 'goals', 'cur': c3, 'prior': p3, 'n': e, 'y': goals::DOUBLE, 'ex': minutes / 90}, {'stat': 'saves', 'cur': c4, 'prior': p4, 'n': e, 'y': saves::DOUBLE, 'ex': minutes / 90}]) AS u FROM x WHERE minutes >= 1),
v AS (SELECT u.stat AS stat, k, u.y AS y, u.ex AS ex, coalesce(u.n / (u.n + k) * u.cur + (1 - u.n / (u.n + k)) * u.prior, u.cur, u.prior) AS g FROM u, (VALUES (1.0), (3.0), (10.0), (30.0), (100.0)) t(k)),
l AS (SELECT stat, k, count(*) AS n, round(avg(CASE WHEN ex IS NULL THEN pow(y - g, 2) ELSE 2 * (CASE WHEN y > 0 THEN y * ln(y / greatest(greatest(g, 0) * ex, 1e-6)) ELSE 0 END - (y - greatest(greatest(g, 0) * ex, 1e-6))) END), 9) AS loss
  FROM v WHERE g IS NOT NULL AND y IS NOT NULL GROUP BY stat, k)"""


@query(f"""WITH {{fy}}, {_RATES} SELECT stat, CASE WHEN max(n) >= 500 THEN arg_min(k, (loss, k)) ELSE 10.0 END::DOUBLE AS k, round(CASE WHEN max(n) >= 500 THEN min(loss) END, 5) AS loss, max(n) AS n_rows FROM l GROUP BY stat""")
def a25_fit_strengths(spark, d):
    """Strengths of four statistics in one scan: two by squared error, two rates by Poisson deviance."""
    i = F.col("id")
    f = yearly(spark, d).withColumns({"pts": F.col("points") * 0.001, "goals": (i % 7 % 3).cast("int"), "saves": F.when(i % 11 != 0, F.floor(i / 7) % 5)})
    f = f.select("id", "entity", "year", "grp", "minutes", "stat", "pts", "goals", "saves")
    cells = f.groupBy("grp", "year").agg(*[F.sum(c).alias(f"s_{c}") for c in ("stat", "pts", "goals", "saves", "minutes")], *[F.count(c).alias(f"n_{c}") for c in ("stat", "pts")])
    w = A.Window.partitionBy("grp").orderBy("year").rowsBetween(A.Window.unboundedPreceding, -1)  # a row per group and year
    so_far = lambda c: F.sum(c).over(w)
    prior = cells.select("grp", "year", *[(so_far(f"s_{c}") / so_far(f"n_{c}")).alias(f"p_{c}") for c in ("stat", "pts")], *[(so_far(f"s_{c}") / so_far("s_minutes") * 90).alias(f"p_{c}") for c in ("goals", "saves")])
    v = A.Window.partitionBy("entity").orderBy("id").rowsBetween(A.Window.unboundedPreceding, -1)
    played = F.sum("minutes").over(v)
    x = f.withColumns({
        **{f"n_{c}": F.count(c).over(v) for c in ("stat", "pts")}, **{f"c_{c}": F.avg(c).over(v) for c in ("stat", "pts")}, "n_90": F.coalesce(played, F.lit(0)) / 90,
        **{f"c_{c}": F.sum(c).over(v) / F.nullif(played, F.lit(0)) * 90 for c in ("goals", "saves")}, "e": F.col("minutes") / 90,
    }).join(prior, ["grp", "year"], "left").where("minutes >= 1")
    stats = [A.Stat("stat", "c_stat", "p_stat", "n_stat", "stat"), A.Stat("points", "c_pts", "p_pts", "n_pts", "pts"), A.Stat("goals", "c_goals", "p_goals", "n_90", "goals", "e"), A.Stat("saves", "c_saves", "p_saves", "n_90", "saves", "e")]
    return A.fit_strengths(x, stats, [1, 3, 10, 30, 100]).select("stat", "k", F.round("loss", 5).alias("loss"), "n_rows")


_COUNTS = """g AS (SELECT l_linenumber % 4 + 1 AS position, l_orderkey, floor(l_quantity / 10)::INTEGER AS y, 2.0 + l_discount * 10 AS mu
  FROM lineitem), a AS (SELECT unnest([0.02, 0.1, 0.3, 1.0]) AS alpha),
l AS (SELECT position, alpha, sum(lgamma(y + 1 / alpha) - lgamma(1 / alpha) - lgamma(y + 1) + 1 / alpha * ln(1 / alpha / (1 / alpha + mu)) + y * ln(mu / (1 / alpha + mu))) AS ll,
  count(*) AS n FROM g, a WHERE l_orderkey % 5 <> 0 GROUP BY ALL),
b AS (SELECT position, arg_max(alpha, ll) AS alpha FROM l GROUP BY position HAVING max(n) >= 500)"""


@query(f"""WITH {_COUNTS}, h AS (SELECT position, round(avg(y * ln(mu) - mu - lgamma(y + 1)), 9) AS po,
 round(avg(lgamma(y + 1 / alpha) - lgamma(1 / alpha) - lgamma(y + 1) + 1 / alpha * ln(1 / alpha / (1 / alpha + mu)) + y * ln(mu / (1 / alpha + mu))),
  9) AS nb FROM g JOIN b USING (position) WHERE l_orderkey % 5 = 0 GROUP BY position)
SELECT position::INTEGER AS position, round(po, 6) AS poisson, round(nb, 6) AS negbin, CASE WHEN nb > po THEN 'negbin' ELSE 'poisson' END AS family
  FROM h""")
def a26_choose_family(spark, d):
    """Dispersion fitted on four fifths of the orders, the family chosen on the rest."""
    from formline.plans.tables import table

    g = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") % 4 + 1).cast("int").alias("position"), F.floor(F.col("l_quantity") / 10).cast("int").alias("y"),
        (2.0 + F.col("l_discount") * 10).alias("mu")
    )
    held = F.col("l_orderkey") % 5 == 0
    fitted = fits.fit_dispersion(g.where(~held), "position", "y", "mu", [0.02, 0.1, 0.3, 1.0])
    return fits.choose_family(g.where(held), fitted, "position", "y", "mu").select("position", r6("poisson").alias("poisson"), r6("negbin").alias("negbin"), "family")


@query(f"""WITH {_fit_sql("k % 4 <> 0")}, h AS (SELECT (k % 3)::INTEGER AS res, {_map_sql("diff", "hfa", "c", "s")} AS e, t FROM t, m WHERE k % 4 = 0)
SELECT 'elo' AS route, round(avg(-ln(e[res + 1] + 1e-6)), 5) AS loss FROM h UNION ALL SELECT 'odds', round(avg(-ln(t[res + 1] + 1e-6)), 5) FROM h""")
def a27_held_out_losses(spark, d):
    """Log loss on held-out rows of the map fitted on the others, against what the odds imply."""
    from formline.operators import scoring as S

    g = _rated(spark, d)
    hfa, c, s, _ = fits.fit_elo_map(g.where("k % 4 <> 0"), "diff", ["home", "draw", "away"])
    held = g.where("k % 4 = 0").withColumn("res", (F.col("k") % 3).cast("int"))
    routes = {"elo": S.elo_probabilities(F.col("diff"), hfa, c, s), "odds": (F.col("home"), F.col("draw"), F.col("away"))}
    return fits.held_out_losses(held, "res", routes).select("route", F.round("loss", 5).alias("loss"))
