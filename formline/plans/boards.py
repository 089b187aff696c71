"""Board, ranking and evaluation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formline.operators import boards as B, evaluate as E, ranking as R, ranks, windows as W
from formline.plans.tables import fact, query, r6, table

K, O = ["entity"], ["ts", "event_id"]


@query("""SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS bal FROM customer ORDER BY bal DESC NULLS LAST, c_custkey LIMIT 200""")
def t1_sort_nulls_last(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("bal"))
    return R.sort_nulls_last(c, "bal", True, ["c_custkey"], 200)


@query("""WITH {f} SELECT round::TIMESTAMP AS round, event_id, points FROM f QUALIFY row_number() OVER (PARTITION BY round ORDER BY points DESC, event_id) <= 50""")
def t2_top_per_group(spark, d):
    f = fact(spark, d).select(F.col("round").cast("timestamp_ntz").alias("round"), "event_id", "points")
    return R.top_n(f, ["round"], [F.desc("points"), F.col("event_id")], 50).drop("place")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_retailprice AS total, p_size * 10.0 AS peak, p_partkey % 97 AS cost FROM part)
SELECT p_partkey, p_brand FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY total DESC,
  p_partkey) <= 5 OR row_number() OVER (PARTITION BY p_brand ORDER BY peak DESC, p_partkey) <= 3 OR row_number() OVER (PARTITION BY p_brand
  ORDER BY cost, p_partkey) <= 2""")
def t3_candidate_pruning(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", "p_brand", F.col("p_retailprice").alias("total"), (F.col("p_size") * 10.0).alias("peak"), (F.col("p_partkey") % 97).alias("cost")
    )
    return R.prune(p, "p_brand", "total", "peak", "cost", "p_partkey", (5, 3, 2)).select("p_partkey", "p_brand")


@query("""WITH {f}, g AS (SELECT entity, coalesce(sum(points) FILTER (kind = 'click'), 0) AS click, coalesce(sum(points) FILTER (kind = 'view'), 0) AS view,
  coalesce(sum(points) FILTER (kind = 'purchase'), 0) AS purchase FROM f GROUP BY entity)
SELECT entity, round(click, 6) AS click, round(view, 6) AS view, round(purchase, 6) AS purchase, round(click + view + purchase, 6) AS total,
  round(greatest(click, view, purchase), 6) AS peak FROM g""")
def t4_pivot_slots(spark, d):
    wide = R.spread(fact(spark, d), K, "kind", "points", ["click", "view", "purchase"])
    return wide.select("entity", *[r6(c).alias(c) for c in ("click", "view", "purchase", "total", "peak")])


@query("""WITH {f} SELECT entity, event_id, kind FROM f WHERE ts >= TIMESTAMP '2024-01-20'
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) <= 6""")
def t5_upcoming_limit(spark, d):
    f = fact(spark, d).where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"))
    return R.top_n(f, K, [F.col("ts"), F.col("event_id")], 6).select("entity", "event_id", "kind")


@query("""SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE year(o_orderdate) = 1997 AND o_orderpriority = '1-URGENT' AND c_mktsegment = 'MACHINERY' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def t6_predictions_listing(spark, d):
    o = table(spark, d, "orders").where((F.year("o_orderdate") == 1997) & (F.col("o_orderpriority") == "1-URGENT"))
    c = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_name")
    return o.join(c, F.expr("o_custkey = c_custkey")).select("o_orderkey", "o_totalprice", "c_name").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("""SELECT o_custkey, o_orderkey, year(o_orderdate)::INTEGER AS season,
  (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER AS place FROM orders""")
def t7_history_order(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("season"))
    return B.ordered_history(o, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""SELECT s_suppkey, s_nationkey % 5 + s_suppkey % 7 AS attack, round(s_acctbal / 100, 4) AS defence,
  round(s_nationkey % 5 + s_suppkey % 7 + s_acctbal / 100, 4) AS total FROM supplier ORDER BY total DESC, s_suppkey""")
def t8_strength_ranking(spark, d):
    ranked = B.strength_ranking(table(spark, d, "supplier"), "s_suppkey", F.col("s_nationkey") % 5 + F.col("s_suppkey") % 7, F.col("s_acctbal") / 100)
    return ranked.select("s_suppkey", "attack", F.round("defence", 4).alias("defence"), F.round("total", 4).alias("total"))


_SQUADS = """{f}, s AS (SELECT entity % 20 AS owner, date_diff('week', DATE '2024-01-01', ts::DATE) AS week, entity AS member, bool_or(minutes >= 90) AS starts
  FROM f GROUP BY ALL)"""


@query(f"""WITH {_SQUADS}, n AS (SELECT owner, week, member, starts AS now FROM s), b AS (SELECT owner, week + 1 AS week, member, starts AS was
  FROM s), j AS (SELECT * FROM n FULL JOIN b USING (owner, week, member))
SELECT owner, week::INTEGER AS week, member,
  CASE WHEN was IS NULL THEN 'in' WHEN now IS NULL THEN 'out' WHEN now AND NOT was THEN 'promoted' ELSE 'demoted' END AS change FROM j
  WHERE (owner, week) IN (SELECT owner, week FROM s) AND week > (SELECT min(week) FROM s x
  WHERE x.owner = j.owner) AND (was IS NULL OR now IS NULL OR now <> was)""")
def t9_week_diff(spark, d):
    f = fact(spark, d)
    week = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7).cast("int")
    s = f.groupBy((F.col("entity") % 20).alias("owner"), week.alias("week"), F.col("entity").alias("member")).agg(F.max(F.col("minutes") >= 90).alias("starts"))
    return R.changes(s, "owner", "week", "member", "starts")


_BOARD = """{f}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM f),
form AS (SELECT entity, avg(points) AS form, sum(minutes) AS form_min FROM r WHERE rn <= 5 GROUP BY entity),
rec AS (SELECT entity, array_to_string(list(points::VARCHAR ORDER BY rn DESC), ';') AS recent FROM r WHERE rn <= 10 GROUP BY entity),
sp AS (SELECT entity, max(round) AS round FROM f
  GROUP BY entity), sa AS (SELECT entity, sum(points) AS day_points, sum(minutes) AS day_min, count(*) FILTER (minutes >= 60) AS starts FROM f
  JOIN sp USING (entity, round) GROUP BY entity),
nx AS (SELECT entity, string_agg(kind, ', ' ORDER BY ts, event_id) AS next_kinds, round(avg(minutes), 4) AS next_diff
  FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS k FROM f WHERE ts >= TIMESTAMP '2024-01-25') WHERE k <= 3
  GROUP BY entity),
board AS (SELECT entity, round(CASE WHEN form_min >= 200 THEN form END, 6) AS form, recent, round(day_points, 6) AS day_points,
  day_min::BIGINT AS day_min, starts, next_kinds, next_diff FROM form JOIN rec USING (entity) JOIN sa USING (entity) LEFT JOIN nx USING (entity))"""


def _board(spark, d):
    """The wide row per entity of the events; what comes after the 25th stands for what is still to be played."""
    b = B.player_board(fact(spark, d), "entity", O, "round", "points", "minutes", "kind", F.col("ts") >= F.lit("2024-01-25").cast("timestamp"))
    return b.withColumns({"form": r6("form"), "day_points": r6("day_points")})


@query(f"WITH {_BOARD} SELECT * FROM board")
def a18_wide_board(spark, d):
    return _board(spark, d)


@query(f"WITH {_BOARD} SELECT * FROM board WHERE day_min <> 0 AND starts >= 1 ORDER BY form DESC NULLS LAST, entity LIMIT 25")
def t11_board_preset(spark, d):
    return R.sort_nulls_last(R.row_filter(_board(spark, d).where("day_min <> 0"), {"starts": (1, None)}), "form", True, ["entity"], 25)


@query("""WITH {f}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM f WHERE TRUE)
  SELECT entity, round(avg(points) FILTER (rn <= 5), 6) AS avg5, round(sum(points) FILTER (rn <= 10), 6) AS sum10, count(*) FILTER (rn <= 10) AS n
  FROM r GROUP BY entity""")
def a12_filtered_form(spark, d):
    r = fact(spark, d).withColumn("rn", W.recency(K, O)).where("rn <= 10")
    return r.groupBy("entity").agg(r6(F.avg(F.when(F.col("rn") <= 5, F.col("points")))).alias("avg5"), r6(F.sum("points")).alias("sum10"), F.count(F.lit(1)).alias("n"))


@query("""WITH {f}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM f)
  SELECT entity, array_to_string(list(points::VARCHAR ORDER BY rn DESC), ';') AS recent FROM r WHERE rn <= 10 GROUP BY entity""")
def a13_recent_array(spark, d):
    r = B.recent_values(fact(spark, d), "entity", O, "points")
    return r.select("entity", B.values_text(F.col("recent"), "points").alias("recent"))


@query("""WITH {f}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS k FROM f WHERE ts >= TIMESTAMP '2024-01-25')
  SELECT entity, string_agg(kind, ', ' ORDER BY k) AS next_kinds, round(avg(minutes), 4) AS diff FROM n WHERE k <= 3 GROUP BY entity""")
def a14_next_opponents(spark, d):
    n = R.top_n(fact(spark, d).where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp")), K, [F.col("ts"), F.col("event_id")], 3, "k")
    return n.groupBy("entity").agg(F.expr("listagg(kind, ', ') WITHIN GROUP (ORDER BY k)").alias("next_kinds"), F.round(F.avg("minutes"), 4).alias("diff"))


@query("""SELECT o_custkey, max(year(o_orderdate))::INTEGER AS season, count(*) FILTER (y = m) AS n, round(sum(o_totalprice) FILTER (y = m), 2) AS spent
  FROM (SELECT *, year(o_orderdate) AS y, max(year(o_orderdate)) OVER (PARTITION BY o_custkey) AS m FROM orders) GROUP BY o_custkey""")
def a15_latest_season(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("spent"))
    return B.latest_season(o, "o_custkey", "season", ["spent"]).withColumn("spent", F.round("spent", 2))


@query("""SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) - 1
  FROM orders) GROUP BY o_custkey""")
def a16_last_completed_season(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("spent"))
    return B.last_completed(o, "o_custkey", "season", ["spent"]).withColumn("spent", F.round("spent", 2))


@query("""WITH s AS (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q, round(sum(l_extendedprice) / greatest(sum(l_quantity), 1) * 90.37, 4) AS per90
  FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_partkey, per90 FROM s QUALIFY row_number() OVER (PARTITION BY l_suppkey
  ORDER BY q DESC, l_partkey) = 1""")
def a17_first_choice(spark, d):
    s = B.first_choice(table(spark, d, "lineitem"), "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", 90.37)
    return s.select("l_suppkey", "l_partkey", F.round("rate", 4).alias("per90"))


@query("""WITH {f}, c AS (SELECT kind, minutes >= 50 AS played, CASE WHEN points < 5 THEN 0 WHEN points < 40 THEN 1 ELSE 2 END AS class
  FROM f), n AS (SELECT played, class, count(*) AS n FROM c GROUP BY ALL)
  SELECT played, class::INTEGER AS class, n, round(n / sum(n) OVER (PARTITION BY played), 6) AS share FROM n""")
def a19_class_distribution(spark, d):
    c = fact(spark, d).select((F.col("minutes") >= 50).alias("played"), F.when(F.col("points") < 5, 0).when(F.col("points") < 40, 1).otherwise(2).alias("class"))
    return B.class_shares(c, "played", "class").withColumn("share", r6("share"))


@query("""WITH {f} SELECT entity, round::TIMESTAMP AS round, round(sum(points), 6) AS points, max(minutes) AS top_minutes,
  round(avg(minutes), 6) AS mean_minutes, arg_min(kind, (ts, event_id)) AS first_kind FROM f GROUP BY entity, round""")
def a11_double_round_rollup(spark, d):
    f = fact(spark, d).withColumn("round", F.col("round").cast("timestamp_ntz"))
    r = B.round_rollup(f, ["entity", "round"], O, ["points"], ["minutes"], ["minutes"], ["kind"])
    return r.withColumns({"points": r6("points"), "mean_minutes": r6("mean_minutes")})


@query("""WITH {f} SELECT entity, round::TIMESTAMP AS round, round(sum(CASE WHEN kind = 'click' THEN points ELSE 0 END), 6) AS click,
  round(sum(CASE WHEN kind = 'view' THEN points ELSE 0 END), 6) AS view FROM f GROUP BY entity, round""")
def a31_component_sums(spark, d):
    f = fact(spark, d).withColumn("round", F.col("round").cast("timestamp_ntz"))
    return B.component_sums(f, ["entity", "round"], "kind", "points", ["click", "view"]).withColumns({"click": r6("click"), "view": r6("view")})


@query("""WITH {f} SELECT count(DISTINCT round) AS rounds, min(round)::TIMESTAMP AS first_round, count(*) AS n, count(DISTINCT entity) AS pool FROM f""")
def a30_distinct_rounds(spark, d):
    return B.pool_report(fact(spark, d).withColumn("round", F.col("round").cast("timestamp_ntz")), "round", "entity")


# -- evaluation ----------------------------------------------------------------------------------

_PRED = """{f}, e AS (SELECT event_id, entity, kind, round, minutes, points AS actual,
  round(avg(points) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 9) AS predicted FROM f), x AS (SELECT *
  FROM e WHERE predicted IS NOT NULL)"""


def _pred(spark, d):
    e = fact(spark, d).withColumn("predicted", F.round(W.rolling(F.col("points"), K, O, 5), 9)).withColumnRenamed("points", "actual")
    return e.where("predicted is not null").select("event_id", "entity", "kind", "round", "minutes", "actual", "predicted")


_FOLDS = (("1997", 1997, None), ("1998", 1998, None), ("1998 H2", 1998, 3))
_FOLDS_SQL = "(VALUES ('1997', 1997, NULL), ('1998', 1998, NULL), ('1998 H2', 1998, 3)) f(fold, y, split)"


@query(f"""WITH o AS (SELECT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)
SELECT fold, CASE WHEN o.y = f.y AND (split IS NULL OR m > split) THEN 'test' WHEN o.y = f.y - 1 THEN 'valid' ELSE 'fit' END AS part, count(*) AS n
FROM o, {_FOLDS_SQL} WHERE o.y < f.y OR o.y = f.y GROUP BY ALL""")
def e1_walk_forward_folds(spark, d):
    """Fit, valid and test rows of each fold; where a season is split its first part joins the fit side."""
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"))
    parts = o.select(F.explode(E.fold_parts("y", "m", _FOLDS)).alias("x"))
    return parts.groupBy("x.fold", "x.part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {{f}}, {_PRED[5:] if _PRED.startswith("{f}, ") else _PRED}, d AS (SELECT *, dayofmonth(round) AS gw, CASE WHEN month(round) = 1 THEN kind ELSE kind || '/' || month(round) END AS part FROM x),
s AS (SELECT * FROM d WHERE gw <= 8), m AS (SELECT part, count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg(pow(predicted - actual, 2))) AS rmse FROM s GROUP BY part HAVING count(*) >= 100),
t AS (SELECT part, avg(abs(predicted - actual)) AS top FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY part ORDER BY predicted DESC, event_id) <= 50) GROUP BY part)
SELECT part, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(top, 6) AS top_mae FROM m JOIN t USING (part)""".replace("WITH {f}, {f}, ", "WITH {f}, "))
def e2_early_rounds(spark, d):
    """Point metrics over the first eight rounds of each part, where it has a hundred rows of them."""
    x = _pred(spark, d).withColumns({"gw": F.dayofmonth("round"), "part": F.when(F.month("round") == 1, F.col("kind")).otherwise(F.concat_ws("/", "kind", F.month("round")))})
    return E.early_metrics(x, ["part"], "gw", "predicted", "actual", "event_id").select("part", "n", *[r6(c).alias(c) for c in ("mae", "rmse", "top_mae")])


@query(f"""WITH {_PRED}, m AS (SELECT kind, count(*) AS n, avg(abs(predicted - actual)) AS mae, sqrt(avg(pow(predicted - actual, 2))) AS rmse FROM x
  GROUP BY kind), t AS (SELECT kind, avg(abs(predicted - actual)) AS top
  FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY kind ORDER BY predicted DESC, event_id) <= 50) GROUP BY kind)
SELECT kind, n, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(top, 6) AS top_mae FROM m JOIN t USING (kind)""")
def e2_point_metrics(spark, d):
    x = _pred(spark, d)
    both = E.point_metrics(x, ["kind"], "predicted", "actual").join(E.top_mae(x, ["kind"], "predicted", "actual", "event_id"), "kind")
    return both.select("kind", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"), r6("top_mae").alias("top_mae"))


@query(f"""WITH {_PRED}, r AS (SELECT kind, round, rank() OVER (PARTITION BY kind, round ORDER BY predicted) + (count(*) OVER (PARTITION BY kind, round,
  predicted) - 1) / 2 AS a, rank() OVER (PARTITION BY kind, round ORDER BY actual) + (count(*) OVER (PARTITION BY kind, round, actual) - 1) / 2 AS b
  FROM x),
g AS (SELECT kind, round, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM r GROUP BY kind, round)
  SELECT kind, round(avg(rho), 6) AS spearman, count(rho) AS rounds FROM g WHERE rho IS NOT NULL GROUP BY kind""")
def e3_spearman(spark, d):
    return E.spearman(_pred(spark, d), ["kind"], "round", "predicted", "actual").select("kind", r6("spearman").alias("spearman"), "rounds")


@query(f"""WITH {_PRED}, y AS (SELECT *, CASE WHEN event_id % 10 < 9 THEN 'all' ELSE kind END AS g FROM x),
r AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY predicted) + (count(*) OVER (PARTITION BY g, predicted) - 1) / 2 AS a,
  rank() OVER (PARTITION BY g ORDER BY actual) + (count(*) OVER (PARTITION BY g, actual) - 1) / 2 AS b FROM y)
SELECT g, round(corr(a, b), 6) AS rho FROM r GROUP BY g HAVING stddev_pop(a) > 0 AND stddev_pop(b) > 0""")
def e3_spread_spearman(spark, d):
    """Rank correlation in groups of which one has nine tenths of the rows: ranks run along ranges of values."""
    x = _pred(spark, d).withColumn("g", F.when(F.col("event_id") % 10 < 9, "all").otherwise(F.col("kind")))
    return ranks.rank_correlation(x, ["g"], "predicted", "actual", run_values=300).select("g", r6("rho").alias("rho"))


@query(f"""WITH {_PRED} SELECT kind, mark::DOUBLE AS mark, count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae,
  round(sqrt(avg(pow(predicted - actual, 2))), 6) AS rmse FROM x, (VALUES (80), (150)) v(mark) WHERE actual >= mark GROUP BY kind, mark
  HAVING count(*) >= 20""")
def e4_tail_metrics(spark, d):
    t = E.tail_metrics(_pred(spark, d), ["kind"], "predicted", "actual", [80, 150])
    return t.select("kind", "mark", "n", r6("mae").alias("mae"), r6("rmse").alias("rmse"))


_PROB = _PRED + ", y AS (SELECT kind, round(predicted / (predicted + 40), 9) AS p, (actual >= 50)::INT AS hit FROM x)"


def _prob(spark, d):
    return _pred(spark, d).select("kind", F.round(F.col("predicted") / (F.col("predicted") + 40), 9).alias("p"), (F.col("actual") >= 50).cast("int").alias("hit"))


@query(f"""WITH {_PROB} SELECT kind, count(*) AS n, round(avg(pow(p - hit, 2)), 6) AS brier,
  round(avg(-(hit * ln(greatest(least(p, 1 - 1e-9), 1e-9)) + (1 - hit) * ln(1 - greatest(least(p, 1 - 1e-9), 1e-9)))), 6) AS log_loss,
  round(avg(p), 6) AS mean_p, round(avg(hit), 6) AS rate FROM y GROUP BY kind""")
def e5_probability_metrics(spark, d):
    m = E.probability_metrics(_prob(spark, d), ["kind"], "p", "hit")
    return m.select("kind", "n", *[r6(c).alias(c) for c in ("brier", "log_loss", "mean_p", "rate")])


@query(f"""WITH {_PROB} SELECT least(floor(p / ((SELECT max(p) FROM y) / 10)), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p,
  round(avg(hit), 6) AS rate FROM y GROUP BY 1 HAVING count(*) >= 50""")
def e5_reliability_curve(spark, d):
    return E.reliability(_prob(spark, d), "p", "hit").select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query(f"""WITH {_PRED}, q AS (SELECT kind, actual, predicted * 0.2 AS p10, predicted AS p50, predicted * 2 AS p90 FROM x)
  SELECT kind, round(avg(greatest(0.1 * (actual - p10), -0.9 * (actual - p10))), 6) AS pinball_p10,
  round(avg(greatest(0.5 * (actual - p50), -0.5 * (actual - p50))), 6) AS pinball_p50,
  round(avg(greatest(0.9 * (actual - p90), -0.1 * (actual - p90))), 6) AS pinball_p90, round(avg((actual BETWEEN p10 AND p90)::INT), 6) AS coverage
  FROM q GROUP BY kind""")
def e6_quantile_metrics(spark, d):
    q = _pred(spark, d).select("kind", "actual", (F.col("predicted") * 0.2).alias("p10"), F.col("predicted").alias("p50"), (F.col("predicted") * 2).alias("p90"))
    m = E.quantile_metrics(q, ["kind"], "actual", {0.1: "p10", 0.5: "p50", 0.9: "p90"}, "p10", "p90")
    return m.select("kind", *[r6(c).alias(c) for c in ("pinball_p10", "pinball_p50", "pinball_p90", "coverage")])


@query(f"""WITH {_PRED} SELECT kind, round(-avg(ln(CASE WHEN minutes < 1 THEN 0.1 WHEN minutes < 60 THEN 0.3 ELSE predicted / (predicted + 40) END + 1e-9)),
  6) AS log_loss FROM x GROUP BY kind""")
def e7_class_log_loss(spark, d):
    x = _pred(spark, d).select(
        "kind", F.when(F.col("minutes") < 1, 0).when(F.col("minutes") < 60, 1).otherwise(2).alias("y"), F.lit(0.1).alias("p0"),
        F.lit(0.3).alias("p1"), (F.col("predicted") / (F.col("predicted") + 40)).alias("p2")
    )
    return E.class_log_loss(x, ["kind"], "y", ["p0", "p1", "p2"]).select("kind", r6("log_loss").alias("log_loss"))


@query(f"""WITH {_PRED}, g AS (SELECT unnest([0.0, 0.25, 0.5, 1.0]) AS weight),
  s AS (SELECT weight, kind, round, actual,
  row_number() OVER (PARTITION BY weight, kind, round ORDER BY predicted + weight * minutes DESC, event_id) AS r FROM x, g),
b AS (SELECT weight, avg(actual) AS points, avg((actual >= 100)::INT) AS haul, count(*) AS n FROM s WHERE r <= 3
  GROUP BY weight), z AS (SELECT max(points) AS best, arg_min(haul, weight) AS base, max(n) AS m FROM b)
SELECT weight::DOUBLE AS weight, round(points, 6) AS points, round(haul, 6) AS haul_rate, n,
  points >= best * 0.98 AND (weight = 0 OR haul >= base + sqrt(base * (1 - base) / m)) AS allowed FROM b, z""")
def e8_upside_weight(spark, d):
    out = E.pick_weight(_pred(spark, d), [0, 0.25, 0.5, 1.0], "kind", "round", "predicted", "minutes", "actual", "event_id", haul=100)
    return out.select("weight", r6("points").alias("points"), r6("haul_rate").alias("haul_rate"), "n", "allowed")


@query(f"""WITH {_PRED}, b AS (SELECT kind, avg(actual) AS mean FROM x
  GROUP BY kind), m AS (SELECT kind, avg(abs(predicted - actual)) AS last5, avg(abs(mean - actual)) AS flat FROM x JOIN b USING (kind) GROUP BY kind)
SELECT kind, round(last5, 6) AS last5, round(flat, 6) AS flat, last5 <= flat * 1.2 AS accepted FROM m""")
def e9_e10_baselines_and_gate(spark, d):
    x = _pred(spark, d).withColumn("mean", F.avg("actual").over(Window.partitionBy("kind")))
    m = x.groupBy("kind").agg(F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("last5"), F.avg(F.abs(F.col("mean") - F.col("actual"))).alias("flat"))
    return m.select("kind", r6("last5").alias("last5"), r6("flat").alias("flat"), (F.col("last5") <= F.col("flat") * 1.2).alias("accepted"))


_GATE = _PRED + """, y AS (SELECT kind, round, actual, unnest(['new', 'old']) AS model, unnest([predicted, minutes::DOUBLE]) AS p FROM x),
r AS (SELECT *, rank() OVER (PARTITION BY kind, model, round ORDER BY p) + (count(*) OVER (PARTITION BY kind, model, round, p) - 1) / 2 AS a,
             rank() OVER (PARTITION BY kind, model, round ORDER BY actual) + (count(*) OVER (PARTITION BY kind, model, round, actual) - 1) / 2 AS b
  FROM y),
g AS (SELECT kind, model, round, CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS rho FROM r GROUP BY ALL),
sp AS (SELECT kind, model, avg(rho) AS spearman FROM g GROUP BY ALL),
m AS (SELECT kind, model, avg(abs(p - actual)) AS mae, avg(pow(p / (p + 40) - (actual >= 50)::INT, 2)) AS brier,
  sqrt(avg(pow(p - actual, 2)) FILTER (actual >= 80)) AS tail_rmse FROM y GROUP BY ALL),
w AS (SELECT n.kind, n.mae AS n_mae, o.mae AS o_mae, n.brier AS n_brier, o.brier AS o_brier, n.tail_rmse AS n_tail, o.tail_rmse AS o_tail,
  ns.spearman AS n_sp, os.spearman AS o_sp,
             (n.kind IN ('click', 'view')) = (n.kind <> 'view') AS agree
      FROM m n JOIN m o ON o.kind = n.kind AND o.model = 'old' JOIN sp ns ON ns.kind = n.kind AND ns.model = 'new'
  JOIN sp os ON os.kind = n.kind AND os.model = 'old' WHERE n.model = 'new'),
z AS (SELECT bool_or(kind = 'click' AND n_sp > o_sp - 0.02) AS a, coalesce(bool_and(n_tail < o_tail) FILTER (agree), false) AS b,
  bool_or(kind = 'click' AND n_brier < o_brier) AS c, bool_or(kind = 'click' AND n_mae < o_mae + 0.05) AS d FROM w)"""


@query(f"""WITH {_GATE} SELECT unnest(['spearman_tolerance', 'tail_rmse', 'haul_calibration', 'mae_tolerance', 'all']) AS "check",
  unnest([a, b, c, d, a AND b AND c AND d]) AS passed FROM z""")
def e9_acceptance_gate(spark, d):
    """The last-five average against minutes as a prediction, kinds as folds; the late rule is said to be in some of them."""
    x = _pred(spark, d)
    models = F.array(F.struct(F.lit("new").alias("model"), F.col("predicted").alias("p")), F.struct(F.lit("old").alias("model"), F.col("minutes").cast("double").alias("p")))
    y = x.select("kind", "round", "actual", F.explode(models).alias("m")).select("kind", "round", "actual", "m.*").withColumns({
        "q": F.col("p") / (F.col("p") + 40), "hit": F.col("actual") >= 50
    })
    keys = ["kind", "model"]
    tail = E.tail_metrics(y, keys, "p", "actual", [80], least=1).select(*keys, F.col("rmse").alias("tail_rmse"))
    metrics = (
        E.point_metrics(y, keys, "p", "actual").select(*keys, "mae").join(E.spearman(y, keys, "round", "p", "actual").select(*keys, "spearman"), keys, "left")
        .join(E.probability_metrics(y, keys, "q", "hit").select(*keys, "brier"), keys).join(tail, keys, "left")
        .withColumns({"rule_in_test": F.col("kind").isin("click", "view"), "rule_fitted": F.col("kind") != "view"})
    )
    return E.acceptance(metrics, "kind", "model", "new", "old", "click", 0.05, 0.02)


@query(f"""WITH {_PRED}, h AS (SELECT kind, avg(abs(predicted - actual)) AS a, avg(abs(minutes - actual)) AS b FROM x WHERE event_id % 2 = 1 GROUP BY kind)
  SELECT kind, CASE WHEN a <= b THEN 'predicted' ELSE 'minutes' END AS route, round(least(a, b), 6) AS mae FROM h""")
def e11_best_route(spark, d):
    held = _pred(spark, d).where("event_id % 2 = 1").withColumn("minutes", F.col("minutes").cast("double"))
    return E.best_route(held, ["kind"], ["predicted", "minutes"], "actual").select("kind", "route", r6("mae").alias("mae"))


@query("SELECT unnest(['avg3', 'sum10', 'ewm3']) AS feature, unnest([0, 0, 0])::BIGINT AS n_changed")
def e12_leakage_audit(spark, d):
    """Features at or before a cut-off must not move when every later value is changed."""
    f = fact(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp")
    later = f.withColumn("points", F.when(F.col("ts") > cut, F.col("points") * 3 + 7).otherwise(F.col("points")))
    rolled = {"avg3": W.rolling(F.col("points"), K, O, 3), "sum10": W.rolling(F.col("points"), K, O, 10, "sum")}
    made = lambda x: W.with_lagged_ewma(x, F.col("points"), K, O, {"ewm3": 3}).withColumns(rolled).where(F.col("ts") <= cut)
    return E.differing(made(f), made(later), "event_id", ["avg3", "sum10", "ewm3"]).select("feature", "n_changed")


@query("""WITH {f}, g AS (SELECT event_id, ts, entity, points, CASE WHEN ts > TIMESTAMP '2024-01-15' THEN points * 3 + 7 ELSE points END AS later FROM f),
v AS (SELECT ts, avg(points) OVER own AS a, avg(later) OVER own AS b, avg(points) OVER ahead AS c, avg(later) OVER ahead AS d FROM g
      WINDOW own AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  ahead AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)),
c AS (SELECT count(*) FILTER (abs(a - b) > 1e-9) AS own, count(*) FILTER (abs(c - d) > 1e-9) AS ahead FROM v WHERE ts <= TIMESTAMP '2024-01-15')
SELECT unnest(['own_row', 'next_row']) AS feature, unnest([own, ahead])::BIGINT AS n_changed FROM c""")
def e12_leaking_feature(spark, d):
    """The audit must find a feature whose window reaches the next row, and clear one that ends at its own."""
    f = fact(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp")
    later = f.withColumn("points", F.when(F.col("ts") > cut, F.col("points") * 3 + 7).otherwise(F.col("points")))
    w = W.over(K, O)
    made = lambda x: x.select(
        "event_id", "ts", F.avg("points").over(w.rowsBetween(-2, 0)).alias("own_row"), F.avg("points").over(w.rowsBetween(-2, 1)).alias("next_row")
    ).where(F.col("ts") <= cut)
    return E.differing(made(f), made(later), "event_id", ["own_row", "next_row"]).select("feature", "n_changed")


@query("""WITH {f}, m AS (SELECT avg(points) FILTER (kind = 'click') AS a, avg(points) FILTER (kind = 'view') AS b FROM f)
  SELECT round(a, 6) AS a, round(b, 6) AS b, a > 3 * b AS sane FROM m""")
def e13_rate_sanity(spark, d):
    m = fact(spark, d).agg(F.avg(F.when(F.col("kind") == "click", F.col("points"))).alias("a"), F.avg(F.when(F.col("kind") == "view", F.col("points"))).alias("b"))
    return m.select(r6("a").alias("a"), r6("b").alias("b"), (F.col("a") > 3 * F.col("b")).alias("sane"))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('MACHINERY',
  'BUILDING') AND c_acctbal >= 100 AND c_acctbal <= 5000 AND contains(lower(c_name || ' ' || c_mktsegment), 'er#00000')""")
def p30_p31_search_and_bounds(spark, d):
    out = R.row_filter(table(spark, d, "customer"), {"c_acctbal": (100, 5000)}, {"c_mktsegment": ["MACHINERY", "BUILDING"]}, "ER#00000", ["c_name", "c_mktsegment"])
    return out.select("c_custkey", "c_name")


@query("""WITH v AS (SELECT event_id, unnest(['a', 'b', 'c']) AS name, unnest([value - 50, (event_id % 7 - 3) * 10.0, ts_minute - 30.0]) AS value
  FROM (SELECT *, minute(ts) AS ts_minute FROM events)),
t AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, name) AS r FROM v WHERE abs(value) > 0.01)
  SELECT e.event_id, coalesce(string_agg(name, ',' ORDER BY r) FILTER (r <= 2), '') AS top FROM events e LEFT JOIN t USING (event_id)
  GROUP BY e.event_id""")
def p22_row_top_values(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("value") - 50).alias("a"), ((F.col("event_id") % 7 - 3) * 10.0).alias("b"), (F.minute("ts") - 30.0).alias("c"))
    return e.select("event_id", F.array_join(F.transform(R.top_values(["a", "b", "c"], 2), lambda x: x["name"]), ",").alias("top"))
