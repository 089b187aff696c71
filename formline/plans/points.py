"""Points matrix, distributions, expectations and probability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from formline.functions.numeric import bins
from formline.operators import scoring as S
from formline.plans.tables import fact, query, r6, table

SEASONS = {"2024-25": S.RULES, "2025-26": S.RULES_WITH_DC}


def counts(spark, d):
    """Line items as event counts of a match: every count is a function of the row."""
    c = lambda e: F.expr(f"cast({e} as int)")
    return table(spark, d, "lineitem").select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("line"), c("l_suppkey").alias("entity"), c("l_partkey").alias("pk"), F.when(F.year("l_shipdate") % 2 == 0, "2024-25").otherwise("2025-26").alias("season"),
        c("l_linenumber % 4 + 1").alias("position"), c("least(l_quantity * 2, 90)").alias("minutes"), c("l_partkey % 3").alias("goals"), c("l_suppkey % 2").alias("assists"),
        c("if(l_partkey % 4 = 0, 1, 0)").alias("clean_sheets"), c("if(l_orderkey % 7 = 0, null, l_orderkey % 5)").alias("goals_conceded"), c("l_suppkey % 8").alias("saves"),
        c("l_partkey % 2").alias("yellow_cards"), c("l_orderkey % 4").alias("bonus"), c("l_partkey % 20").alias("defensive_contribution"),
    )


_COUNTS = """c AS (SELECT l_orderkey::INTEGER AS id, l_linenumber::INTEGER AS line, l_suppkey::INTEGER AS entity, l_partkey::INTEGER AS pk,
  CASE WHEN year(l_shipdate) % 2 = 0 THEN '2024-25' ELSE '2025-26' END AS season,
(l_linenumber % 4 + 1)::INTEGER AS position, trunc(least(l_quantity * 2, 90))::INTEGER AS minutes, l_partkey % 3 AS goals, l_suppkey % 2 AS assists,
  CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END AS clean_sheets,
CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_orderkey % 5 END AS gc, l_suppkey % 8 AS saves, l_partkey % 2 AS yellow, l_orderkey % 4 AS bonus,
  l_partkey % 20 AS dc FROM lineitem),
p AS (SELECT *, (CASE WHEN minutes >= 60 THEN 2 WHEN minutes > 0 THEN 1 ELSE 0 END + goals * CASE position WHEN 3 THEN 5 WHEN 4 THEN 4
  ELSE 6 END + 3 * assists
 + clean_sheets * CASE position WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 4 END - CASE WHEN position <= 2 THEN gc // 2
  ELSE 0 END + saves // 3 - yellow + bonus) AS base,
 CASE WHEN season = '2025-26' AND position > 1 AND dc >= CASE WHEN position = 2 THEN 10 ELSE 12 END THEN 2 ELSE 0 END AS award FROM c)"""


@query(f"WITH {_COUNTS} SELECT id, line, entity, pk, (base + award)::DOUBLE AS priced FROM p")
def p18_points_matrix(spark, d):
    return S.price(counts(spark, d), S.rules_table(spark, SEASONS)).select("id", "line", "entity", "pk", "priced")


@query(f"WITH {_COUNTS} SELECT season, count(*) AS n, count(*) FILTER (pk % 50 = 0) AS mismatches FROM p GROUP BY season")
def p19_reconstruction_audit(spark, d):
    rules = S.rules_table(spark, SEASONS)
    recorded = S.price(counts(spark, d), rules, "total_points").withColumn("total_points", F.col("total_points") + F.when(F.col("pk") % 50 == 0, 1).otherwise(0))
    return S.audit(recorded, rules)


@query(f"""WITH {_COUNTS} SELECT position, min(dc) FILTER (award = 2)::INTEGER AS threshold, max(dc) FILTER (award = 0)::INTEGER AS quiet_to,
  coalesce(max(dc) FILTER (award = 0) >= min(dc) FILTER (award = 2), false) AS overlap FROM p WHERE season = '2025-26' AND position > 1
  GROUP BY position""")
def a23_recovered_thresholds(spark, d):
    rules = S.rules_table(spark, SEASONS)
    recorded = S.price(counts(spark, d).where("season = '2025-26'"), rules, "total_points")
    return S.recovered_thresholds(recorded, rules).select("position", "threshold", "quiet_to", "overlap")


@query("""WITH {f}, k AS (SELECT unnest(range(0, 11)) AS k), g AS (SELECT DISTINCT round(points / 40, 1) AS lam FROM f),
q AS (SELECT lam, k, exp(-lam) * pow(lam, k) / factorial(k::INTEGER) AS a,
  exp(lgamma(k + 4) - lgamma(4) - lgamma(k + 1)) * pow(4 / (4 + lam), 4) * pow(lam / (4 + lam), k) AS b FROM g, k)
SELECT lam, k::INTEGER AS k, round(a / sum(a) OVER (PARTITION BY lam), 6) AS poisson, round(b / sum(b) OVER (PARTITION BY lam), 6) AS negbin FROM q""")
def p24_count_pmf(spark, d):
    g = fact(spark, d).select(F.round(F.col("points") / 40, 1).alias("lam")).distinct()
    both = g.select("lam", S.count_pmf(F.col("lam")).alias("a"), S.count_pmf(F.col("lam"), alpha=0.25).alias("b"))
    return both.select("lam", F.posexplode(F.arrays_zip("a", "b")).alias("k", "x")).select("lam", "k", r6("x.a").alias("poisson"), r6("x.b").alias("negbin"))


def _rates(spark, d):
    f = fact(spark, d).select("event_id", "entity", (F.col("event_id") % 4 + 1).cast("int").alias("position"), F.lit("2025-26").alias("season"), "minutes", "points")
    p = F.col("minutes") / 100
    return f.select(
        "event_id", "entity", "position", "season", (p * 0.3).alias("p_cameo"), (p * 0.7).alias("p_start"), (F.col("points") % 7 / 10).alias("goals_rate"), (F.col("points") % 5 / 10).alias("assists_rate"),
        F.when(F.col("position") == 1, F.col("points") % 6).otherwise(0.0).alias("saves_rate"), (F.col("points") % 1).alias("p_dc"), F.lit(0.1).alias("p_yellow"), F.lit(0.01).alias("p_red"),
        (F.col("points") % 3 / 3).alias("bonus_if_start"), (F.col("points") % 3 / 9).alias("bonus_if_cameo"), S.count_pmf(F.col("points") % 4, 6).alias("pmf"),
    )


POOL = {"start": 81.0, "cameo": 27.0, "dc_start": 0.9, "dc_cameo": 0.2}
_EV = """{f}, g AS (SELECT event_id, (event_id % 4 + 1)::INTEGER AS pos, minutes / 100 * 0.3 AS pc, minutes / 100 * 0.7 AS ps, points % 7 / 10 AS gr,
  points % 5 / 10 AS ar, CASE WHEN event_id % 4 = 0 THEN points % 6 ELSE 0.0 END AS sr,
 points % 1 AS pdc, points % 3 AS b3, points % 4 AS lam FROM f),
w AS (SELECT g.*, k, CASE WHEN lam = 0 THEN (k = 0)::INT::DOUBLE ELSE exp(-lam) * pow(lam, k) / factorial(k::INTEGER) END AS raw
  FROM g, (SELECT unnest(range(0, 7)) AS k)),
v AS (SELECT *, raw / sum(raw) OVER (PARTITION BY event_id) AS pm FROM w),
h AS (SELECT event_id, sum(pm * (k // 2)) AS whole, max(CASE WHEN k = 0 THEN pm END) AS p0,
  sum(pm * (SELECT coalesce(sum((j // 2) * factorial(k::INTEGER) / (factorial(j::INTEGER) * factorial((k - j)::INTEGER)) * pow(0.3, j) * pow(0.7,
  k - j)), 0) FROM range(0, 7) t(j) WHERE j <= k)) AS thin FROM v GROUP BY event_id),
s AS (SELECT event_id, (SELECT sum((j // 3) * exp(-sr * 0.9) * pow(sr * 0.9, j) / factorial(j::INTEGER)) / sum(exp(-sr * 0.9) * pow(sr * 0.9,
  j) / factorial(j::INTEGER)) FROM range(0, 21) t(j)) AS s9,
  (SELECT sum((j // 3) * exp(-sr * 0.3) * pow(sr * 0.3, j) / factorial(j::INTEGER)) / sum(exp(-sr * 0.3) * pow(sr * 0.3, j) / factorial(j::INTEGER))
  FROM range(0, 21) t(j)) AS s3 FROM g),
e AS (SELECT g.event_id, ps * 2 + pc AS ev_minutes, CASE pos WHEN 3 THEN 5 WHEN 4 THEN 4 ELSE 6 END * gr * (pc * 0.3 + ps * 0.9) AS ev_goals,
  3 * ar * (pc * 0.3 + ps * 0.9) AS ev_assists, CASE pos WHEN 3 THEN 1 WHEN 4 THEN 0 ELSE 4 END * p0 * ps AS ev_clean_sheet,
 CASE WHEN pos <= 2 THEN -1 ELSE 0 END * (ps * whole + pc * thin) AS ev_conceded, ps * s9 + pc * s3 AS ev_saves,
  CASE WHEN pos = 1 THEN 0 ELSE 2 END * pdc * (ps * 0.9 + pc * 0.2) AS ev_dc, (-0.1 - 0.03) * (ps + pc) + ps * b3 / 3 + pc * b3 / 9 AS ev_cards_bonus
  FROM g JOIN h USING (event_id) JOIN s USING (event_id))"""


@query(f"""WITH {_EV} SELECT event_id, round(ev_minutes + ev_goals + ev_assists + ev_clean_sheet + ev_conceded + ev_saves + ev_dc + ev_cards_bonus, 5) AS ev
  FROM e""")
def p25_closed_form_expectation(spark, d):
    ev = S.expected_points(_rates(spark, d), S.rules_table(spark, SEASONS), POOL, pmf_most=6)
    return ev.select("event_id", F.round("ev", 5).alias("ev"))


@query(f"""WITH {_EV} SELECT event_id, round(ev_minutes, 5) AS ev_minutes, round(ev_goals, 5) AS ev_goals, round(ev_assists, 5) AS ev_assists,
  round(ev_clean_sheet, 5) AS ev_clean_sheet, round(ev_conceded, 5) + 0.0 AS ev_conceded, round(ev_saves, 5) AS ev_saves, round(ev_dc, 5) AS ev_dc,
  round(ev_cards_bonus, 5) AS ev_cards_bonus FROM e""")
def p26_component_split(spark, d):
    ev = S.expected_points(_rates(spark, d), S.rules_table(spark, SEASONS), POOL, pmf_most=6)
    return ev.select("event_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ev.columns if c.startswith("ev_")])


@query("""WITH {f} SELECT event_id, CASE WHEN minutes >= 60 THEN 1.0 WHEN minutes >= 30 THEN 0.4 WHEN minutes >= 1 THEN 0.1 ELSE 0.0 END::DOUBLE AS curve,
  round(least(minutes / 90, 1.0), 6) AS plain FROM f""")
def p27_minutes_scaling(spark, d):
    m = F.col("minutes")
    return fact(spark, d).select("event_id", S.step_scale(m, [(1, 0.1), (30, 0.4), (60, 1.0)]).alias("curve"), r6(S.step_scale(m, None)).alias("plain"))


@query("WITH {f} SELECT event_id, round(points - 30 + 0.5 * minutes / 100, 6) AS upside, greatest(points - 30, 0.0) AS predicted FROM f")
def p28_upside(spark, d):
    ev = F.col("points") - 30
    return fact(spark, d).select("event_id", r6(ev + 0.5 * F.col("minutes") / 100).alias("upside"), F.greatest(ev, F.lit(0.0)).alias("predicted"))


@query("""WITH {f}, m AS (SELECT kind, avg(points) AS cameo FROM f WHERE minutes BETWEEN 1 AND 59 GROUP BY kind)
  SELECT event_id, round(minutes / 100 * 0.7 * points + minutes / 100 * 0.3 * coalesce(cameo, 0), 6) AS combined FROM f LEFT JOIN m USING (kind)""")
def p23_a20_two_stage(spark, d):
    f = fact(spark, d)
    means = f.where("minutes between 1 and 59").groupBy("kind").agg(F.avg("points").alias("cameo"))
    p = F.col("minutes") / 100
    return f.join(F.broadcast(means), "kind", "left").select("event_id", r6(S.two_stage(p * 0.7, F.col("points"), p * 0.3, F.col("cameo"))).alias("combined"))  # one row per kind


@query("""WITH {f} SELECT event_id, CASE WHEN kind = 'error' THEN 0.0 ELSE points END AS predicted,
  CASE WHEN kind = 'error' THEN 1.0 ELSE round(1 - minutes / 100, 6) END AS p_blank FROM f""")
def p20_availability_gate(spark, d):
    f = fact(spark, d).select("event_id", "kind", F.col("points").alias("predicted"), r6(1 - F.col("minutes") / 100).alias("p_blank"))
    return S.gate(f, F.col("kind") == "error", ["predicted"]).select("event_id", "predicted", "p_blank")


@query("""WITH {f}, s AS (SELECT entity, round, event_id % 8 AS draw, sum(points) AS x FROM f GROUP BY ALL)
SELECT entity, round, round(avg(x), 6) AS mean, round(avg((x <= 20)::INT), 6) AS p_blank, round(avg((x >= 50)::INT), 6) AS p_return,
  round(avg((x >= 100)::INT), 6) AS p_haul, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50,
  round(quantile_cont(x, 0.9), 6) AS p90 FROM s GROUP BY entity, round""")
def a32_distribution_summary(spark, d):
    f = fact(spark, d).withColumn("draw", F.col("event_id") % 8)
    out = S.sample_summary(f, ["entity", "round"], "draw", "points", (20, 50, 100))
    return out.select("entity", F.col("round").cast("timestamp_ntz").alias("round"), *[r6(c).alias(c) for c in ("mean", "p_blank", "p_return", "p_haul", "p10", "p50", "p90")])


@query("""WITH {f}, g AS (SELECT CASE WHEN event_id % 10 < 8 THEN 'all' ELSE kind END AS g, event_id % 9001 AS draw, CASE WHEN event_id % 6 = 0 THEN 50.0 WHEN event_id % 13 = 0 THEN -1e6 ELSE points END AS p FROM f),
s AS (SELECT g, draw, sum(p) AS x FROM g GROUP BY ALL)
SELECT g, round(avg(x), 5) AS mean, round(avg((x <= 20)::INT), 6) AS p_blank, round(avg((x >= 50)::INT), 6) AS p_return, round(avg((x >= 100)::INT), 6) AS p_haul,
  round(quantile_cont(x, 0.1), 5) AS p10, round(quantile_cont(x, 0.5), 5) AS p50, round(quantile_cont(x, 0.9), 5) AS p90 FROM s GROUP BY g""")
def a32_large_groups(spark, d):
    """Exact quantiles of groups too large to sort, with values that many rows share and some far outside, in narrowing passes."""
    e = F.col("event_id")
    p = F.when(e % 6 == 0, 50.0).when(e % 13 == 0, -1e6).otherwise(F.col("points"))
    f = fact(spark, d).withColumns({"g": F.when(e % 10 < 8, "all").otherwise(F.col("kind")), "draw": e % 9001, "p": p})
    out = S.sample_summary(f, ["g"], "draw", "p", (20, 50, 100), finish=100)
    return out.select("g", F.round("mean", 5).alias("mean"), *[r6(c).alias(c) for c in ("p_blank", "p_return", "p_haul")], *[F.round(c, 5).alias(c) for c in ("p10", "p50", "p90")])


@query("""WITH {f}, g AS (SELECT (event_id % 8 + 1)::INTEGER AS bucket, least(minutes // 40, 2)::INTEGER AS returns,
  CASE WHEN minutes = 99 THEN 3 ELSE event_id % 4 END AS bonus, * FROM f),
c AS (SELECT bucket, returns, count(*) n, avg(bonus) m FROM g GROUP BY 1, 2), b AS (SELECT bucket, count(*) n, avg(bonus) m FROM g
  GROUP BY 1), r AS (SELECT returns, count(*) n, avg(bonus) m FROM g GROUP BY 1)
SELECT x.bucket, y.returns, round(coalesce(CASE WHEN c.n >= 420 THEN c.m END, CASE WHEN b.n >= 420 THEN b.m END, CASE WHEN r.n >= 420 THEN r.m END,
  0), 6) AS expectation FROM (SELECT DISTINCT bucket FROM g) x CROSS JOIN (SELECT DISTINCT returns FROM g) y
  LEFT JOIN c ON c.bucket = x.bucket AND c.returns = y.returns LEFT JOIN b ON b.bucket = x.bucket LEFT JOIN r ON r.returns = y.returns""")
def a21_conditional_distribution(spark, d):
    f = fact(spark, d).select(
        (F.col("event_id") % 8 + 1).cast("int").alias("bucket"), F.least(F.floor(F.col("minutes") / 40), F.lit(2)).cast("int").alias("returns"),
        F.when(F.col("minutes") == 99, 3).otherwise(F.col("event_id") % 4).alias("bonus")
    )
    return S.conditional_distribution(f, "bucket", "returns", "bonus", least=420).select("bucket", "returns", r6("expectation").alias("expectation"))


@query("""WITH {f}, g AS (SELECT CASE WHEN minutes < 1 THEN 0 WHEN minutes < 30 THEN 1 WHEN minutes < 60 THEN 2 ELSE 3 END AS b, (points >= 40)::INT AS hit
  FROM f), h AS (SELECT b, count(*) AS n, avg(hit) AS rate FROM g GROUP BY b)
SELECT b::INTEGER AS b, n, round(CASE WHEN b = 3 THEN 1.0 WHEN n < 100 THEN 0.0 ELSE rate / (SELECT rate FROM h WHERE b = 3) END, 6) AS scale FROM h""")
def a22_hit_scaling(spark, d):
    f = fact(spark, d).withColumn("b", bins(F.col("minutes"), [0, 1, 30, 60, 1000]))
    return S.hit_scaling(f, "b", F.col("points") >= 40, 3).select("b", "n", r6("scale").alias("scale"))


@query("""WITH {f} SELECT CASE WHEN minutes >= 60 THEN 'start' ELSE 'cameo' END AS class, minutes, count(*) AS n FROM f WHERE minutes > 0 GROUP BY ALL""")
def a24_minutes_pool(spark, d):
    return fact(spark, d).where("minutes > 0").groupBy(F.when(F.col("minutes") >= 60, "start").otherwise("cameo").alias("class"), "minutes").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH g AS (SELECT o_orderkey, o_totalprice / 1000 - 200 + 50 AS gap
  FROM orders), p AS (SELECT o_orderkey, greatest(least(0.27 * exp(-gap * gap / (2 * 270.0 * 270.0)), 0.6), 1e-6) AS d,
  1 / (1 + pow(10, -gap / 400)) AS e FROM g),
q AS (SELECT o_orderkey, d, greatest(e - d / 2, 1e-6) AS h FROM p), r AS (SELECT *, greatest(1 - h - d, 1e-6) AS a FROM q)
  SELECT o_orderkey, round(h / (h + d + a), 6) AS home, round(d / (h + d + a), 6) AS draw, round(a / (h + d + a), 6) AS away FROM r""")
def p15_elo_probabilities(spark, d):
    h, dr, a = S.elo_probabilities(F.col("o_totalprice") / 1000 - 200, 50.0, 0.27, 270.0)
    return table(spark, d, "orders").select("o_orderkey", r6(h).alias("home"), r6(dr).alias("draw"), r6(a).alias("away"))


@query("""WITH g AS (SELECT o_orderkey, 1.5 + o_orderkey % 7 / 2 AS h, 3.0 + o_orderkey % 3 / 4 AS d, 1.8 + o_orderkey % 5 AS a, o_orderkey % 4 AS hs,
  o_custkey % 4 AS aw FROM orders)
SELECT o_orderkey, round(1 / h / (1 / h + 1 / d + 1 / a), 6) AS home, round(1 / d / (1 / h + 1 / d + 1 / a), 6) AS draw,
  round(1 / a / (1 / h + 1 / d + 1 / a), 6) AS away, CASE WHEN hs > aw THEN 0 WHEN hs = aw THEN 1 ELSE 2 END AS result FROM g""")
def p16_implied_probabilities(spark, d):
    k = F.col("o_orderkey")
    h, dr, a = S.implied(1.5 + k % 7 / 2, 3.0 + k % 3 / 4, 1.8 + (k % 5))
    return table(spark, d, "orders").select("o_orderkey", r6(h).alias("home"), r6(dr).alias("draw"), r6(a).alias("away"), S.outcome(k % 4, F.col("o_custkey") % 4).alias("result"))
