"""Windowed form, as-of and interval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formline.operators import asof, intervals, ranks, spread, windows as W
from formline.plans.tables import fact, query, r6, table
from formline.sources import staging

K, O = ["entity"], ["ts", "event_id"]


@query("""WITH {f}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS rn FROM f),
a AS (SELECT entity, avg(points) FILTER (rn <= 5) AS form, list(points ORDER BY rn DESC) FILTER (rn <= 10) AS recent,
  sum(minutes) FILTER (rn <= 5) AS mins FROM r GROUP BY entity),
b AS (SELECT entity, CASE WHEN mins >= 90 THEN form END AS form, array_to_string(list_transform(recent, lambda x: printf('%.2f', x)), ';') AS recent,
  mins FROM a),
c AS (SELECT *, (rank() OVER (ORDER BY form) + (count(*) OVER (PARTITION BY form) - 1) / 2) / count(*) OVER () AS pct FROM b WHERE form IS NOT NULL)
SELECT entity, round(form, 6) AS form, recent, mins::BIGINT AS mins,
  CASE WHEN pct >= 0.9 THEN 'excellent' WHEN pct >= 0.65 THEN 'good' WHEN pct >= 0.35 THEN 'average' ELSE 'poor' END AS rating
FROM c ORDER BY form DESC, entity LIMIT 20""")
def slice_top_form(spark, d):
    """The flagship: recent form with a minimum sample, the last ten values, a rating, the best twenty."""
    ranked = fact(spark, d).withColumn("rn", W.recency(K, O)).where("rn <= 10")
    per = ranked.groupBy("entity").agg(
        F.avg(F.when(F.col("rn") <= 5, F.col("points"))).alias("form"), F.sum(F.when(F.col("rn") <= 5, F.col("minutes"))).alias("mins"),
        F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("o"), "points"))).alias("r"),
    )
    rated = W.rank_share(staging.written(per.where("mins >= 90"), "form"), "form").withColumn("rating", W.labelled(F.col("share")))
    recent = F.array_join(F.transform("r", lambda x: F.format_string("%.2f", x["points"])), ";")
    return rated.select("entity", r6("form").alias("form"), recent.alias("recent"), "mins", "rating").orderBy(F.desc("form"), "entity").limit(20)


@query("""WITH {f} SELECT event_id, round(avg(points) OVER w3, 6) AS avg3, round(sum(points) OVER w5, 6) AS sum5, round(avg(points) OVER w10, 6) AS avg10, sum(minutes) OVER w5 AS min5 FROM f
WINDOW w3 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), w5 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""".replace("sum(minutes) OVER w5", "(sum(minutes) OVER w5)::BIGINT"))
def w1_lagged_rolling(spark, d):
    return fact(spark, d).select(
        "event_id", r6(W.rolling(F.col("points"), K, O, 3)).alias("avg3"), r6(W.rolling(F.col("points"), K, O, 5, "sum")).alias("sum5"),
        r6(W.rolling(F.col("points"), K, O, 10)).alias("avg10"), W.rolling(F.col("minutes"), K, O, 5, "sum").alias("min5")
    )


@query("""WITH {f}, g AS (SELECT *, CASE WHEN minutes >= 20 THEN points END AS p FROM f)
SELECT event_id, round(CASE WHEN count(p) OVER w6 >= 3 THEN avg(p) OVER w6 END, 6) AS r6,
  round(CASE WHEN count(p) OVER w10 >= 5 THEN avg(p) OVER w10 END, 6) AS r10 FROM g
WINDOW w6 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
  w10 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w2_inclusive_rolling(spark, d):
    p = F.when(F.col("minutes") >= 20, F.col("points"))
    return fact(spark, d).select("event_id", r6(W.rolling(p, K, O, 6, min_obs=3, lagged=False)).alias("r6"), r6(W.rolling(p, K, O, 10, min_obs=5, lagged=False)).alias("r10"))


@query("""WITH {f}, g AS (SELECT *, CASE WHEN minutes >= 20 THEN points END AS p, CASE WHEN minutes >= 20 THEN (points < 10)::INT::DOUBLE END AS low FROM f)
SELECT event_id, round(CASE WHEN count(p) OVER w6 >= 2 THEN avg(p) OVER w6 END, 6) AS p6,
  round(CASE WHEN count(low) OVER w10 >= 3 THEN avg(low) OVER w10 END, 6) AS low10 FROM g
WINDOW w6 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w3_lagged_rolling_min_obs(spark, d):
    p = F.when(F.col("minutes") >= 20, F.col("points"))
    low = F.when(p.isNotNull(), (p < 10).cast("double"))
    return fact(spark, d).select("event_id", r6(W.rolling(p, K, O, 6, min_obs=2)).alias("p6"), r6(W.rolling(low, K, O, 10, min_obs=3)).alias("low10"))


@query("""WITH {f} SELECT event_id, round(sum(points) OVER w5 / greatest(sum(minutes) OVER w5, 1) * 90, 6) AS per90_5,
  round(sum(points) OVER w10 / greatest(sum(minutes) OVER w10, 1) * 90, 6) AS per90_10 FROM f
WINDOW w5 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING),
  w10 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w4_rolling_per90(spark, d):
    return fact(spark, d).select(
        "event_id", r6(W.rolling_rate(F.col("points"), F.col("minutes"), K, O, 5)).alias("per90_5"),
        r6(W.rolling_rate(F.col("points"), F.col("minutes"), K, O, 10)).alias("per90_10")
    )


@query("""WITH {f} SELECT event_id, round(sum(points) OVER w5 / greatest(sum(minutes) OVER w5, 1) * 90, 6) AS rate5,
  round(sum(points) OVER w20 / greatest(sum(minutes) OVER w20, 1) * 90, 6) AS rate20 FROM f
WINDOW w5 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
  w20 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def w5_inclusive_rates(spark, d):
    return fact(spark, d).select(
        "event_id", r6(W.rolling_rate(F.col("points"), F.col("minutes"), K, O, 5, lagged=False)).alias("rate5"),
        r6(W.rolling_rate(F.col("points"), F.col("minutes"), K, O, 20, lagged=False)).alias("rate20")
    )


@query("""WITH {f}, g AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS i, CASE WHEN minutes >= 10 THEN points END AS p FROM f)
SELECT event_id, round(sum(p * pow(2, i / 3.0)) OVER w / sum(CASE WHEN p IS NOT NULL THEN pow(2, i / 3.0) END) OVER w, 6) AS ewm3,
  round(sum(p * pow(2, i / 8.0)) OVER w / sum(CASE WHEN p IS NOT NULL THEN pow(2, i / 8.0) END) OVER w, 6) AS ewm8 FROM g
WINDOW w AS (PARTITION BY entity ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w6_lagged_ewma(spark, d):
    p = F.when(F.col("minutes") >= 10, F.col("points"))
    made = W.with_lagged_ewma(fact(spark, d), p, K, O, {"ewm3": 3, "ewm8": 8})
    return made.select("event_id", r6("ewm3").alias("ewm3"), r6("ewm8").alias("ewm8"))


@query("""WITH {f}, g AS (SELECT *, CASE WHEN minutes >= 10 THEN points END AS p FROM f)
SELECT event_id, round(CASE WHEN lag(p) OVER w IS NOT NULL THEN sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) / (row_number() OVER w - 1) END, 6) AS ppg FROM g
WINDOW w AS (PARTITION BY entity, kind ORDER BY ts, event_id)""".replace("sum(p) OVER (w ROWS", "sum(p) OVER (PARTITION BY entity, kind ORDER BY ts, event_id ROWS"))
def w7_season_to_date(spark, d):
    return fact(spark, d).select("event_id", r6(W.season_to_date(F.when(F.col("minutes") >= 10, F.col("points")), ["entity", "kind"], O)).alias("ppg"))


@query("""WITH {f}, g AS (SELECT *, CASE WHEN minutes >= 10 THEN points END AS p FROM f),
h AS (SELECT event_id, coalesce(sum(CASE WHEN p IS NOT NULL THEN minutes END) OVER w, 0) AS seen, sum(p) OVER w AS s FROM g
  WINDOW w AS (PARTITION BY entity, kind ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, seen::BIGINT AS seen, round(s / nullif(seen, 0) * 90, 6) AS rate FROM h""")
def w8_rate_to_date(spark, d):
    rate, seen = W.rate_to_date(F.when(F.col("minutes") >= 10, F.col("points")), F.col("minutes"), ["entity", "kind"], O)
    return fact(spark, d).select("event_id", seen.cast("long").alias("seen"), r6(rate).alias("rate"))


@query("""WITH {f}, g AS (SELECT event_id, coalesce(sum((minutes > 60)::INT) OVER (PARTITION BY entity, round ORDER BY ts,
  event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM f)
SELECT event_id, n::BIGINT AS n, (CASE WHEN n < 5 THEN 5 - n WHEN n < 10 THEN 10 - n WHEN n < 15 THEN 15 - n ELSE 4 END)::DOUBLE AS gap FROM g""")
def w10_p17_suspension_gap(spark, d):
    from formline.functions.numeric import gap_to_next

    n = W.total_to_date((F.col("minutes") > 60).cast("int"), ["entity", "round"], O)
    return fact(spark, d).select("event_id", n.alias("n")).select("event_id", "n", gap_to_next(F.col("n"), (5, 10, 15), 4.0).alias("gap"))


@query("""WITH {f} SELECT event_id, CASE WHEN lag(kind) OVER w IS NULL THEN 1.0 ELSE (lag(kind) OVER w <> kind)::INT END::DOUBLE AS new_kind,
  CASE WHEN lag(round) OVER w IS NULL THEN 1.0 ELSE (lag(round) OVER w <> round)::INT END::DOUBLE AS new_round FROM f
  WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)""")
def w11_change_flags(spark, d):
    return fact(spark, d).select("event_id", W.changed(F.col("kind"), K, O).alias("new_kind"), W.changed(F.col("round"), K, O).alias("new_round"))


@query("""WITH {f} SELECT event_id, coalesce(lag((minutes >= 60)::INT::DOUBLE) OVER w, 0.0) AS started_last,
round(avg((minutes >= 60)::INT) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS start5,
  round(avg((minutes >= 60)::INT) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS start10,
round(avg((minutes > 0)::INT) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS played5 FROM f
  WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id)""")
def w12_start_shares(spark, d):
    started, played = (F.col("minutes") >= 60).cast("double"), (F.col("minutes") > 0).cast("double")
    return fact(spark, d).select(
        "event_id", W.lagged_flag(F.col("minutes") >= 60, K, O).alias("started_last"), r6(W.rolling(started, K, O, 5)).alias("start5"),
        r6(W.rolling(started, K, O, 10)).alias("start10"), r6(W.rolling(played, K, O, 5)).alias("played5")
    )


@query("""WITH {f} SELECT event_id, round(avg(points) OVER w, 6) AS vs_mean, count(points) OVER w AS vs_n FROM f
  WINDOW w AS (PARTITION BY entity, kind ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def w13_versus_expanding(spark, d):
    mean, n = W.expanding(F.col("points"), ["entity", "kind"], O)
    return fact(spark, d).select("event_id", r6(mean).alias("vs_mean"), n.alias("vs_n"))


@query("""WITH {f} SELECT event_id, CASE WHEN lag(ts) OVER w IS NOT NULL THEN least((epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 86400000000,
  60) END::BIGINT AS rest FROM f WINDOW w AS (PARTITION BY entity, kind ORDER BY ts, event_id)""")
def w14_rest_days(spark, d):
    return fact(spark, d).select("event_id", W.rest_days(F.col("ts"), ["entity", "kind"], O).cast("long").alias("rest"))


@query("""WITH {f} SELECT event_id, (row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC))::INTEGER AS rn FROM f""")
def w15_recency_rank(spark, d):
    return fact(spark, d).select("event_id", W.recency(K, O).alias("rn"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  least(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey), 8)::INTEGER AS place FROM g""")
def w16_capped_rank(spark, d):
    g = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return g.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        W.capped_rank("l_extendedprice", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).alias("place")
    )


@query("""WITH g AS (SELECT o_orderkey, year(o_orderdate) AS y, o_orderpriority AS p, round(o_totalprice / 1000) AS v FROM orders),
c AS (SELECT *, (rank() OVER (PARTITION BY y, p ORDER BY v) + (count(*) OVER (PARTITION BY y, p, v) - 1) / 2) / count(*) OVER (PARTITION BY y,
  p) AS pct FROM g)
SELECT o_orderkey, CASE WHEN pct >= 0.9 THEN 'excellent' WHEN pct >= 0.65 THEN 'good' WHEN pct >= 0.35 THEN 'average' ELSE 'poor' END AS rating FROM c""")
def w17_percent_rank_rating(spark, d):
    g = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"), F.round(F.col("o_totalprice") / 1000).alias("v"))
    return g.select("o_orderkey", W.rating("v", ["y", "p"]).alias("rating"))


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 9 THEN 0 ELSE year(o_orderdate) END AS y, CASE WHEN o_orderkey % 5 = 0 THEN 100000.0 WHEN o_orderkey % 23 <> 0 THEN o_totalprice END AS v FROM orders),
c AS (SELECT *, (rank() OVER (PARTITION BY y ORDER BY v) + (count(*) OVER (PARTITION BY y, v) - 1) / 2) / count(*) OVER (PARTITION BY y) AS pct FROM g WHERE v IS NOT NULL)
SELECT g.o_orderkey, round(pct, 6) AS pct, CASE WHEN pct >= 0.9 THEN 'excellent' WHEN pct >= 0.65 THEN 'good' WHEN pct >= 0.35 THEN 'average' ELSE 'poor' END AS rating
FROM g LEFT JOIN c ON c.o_orderkey = g.o_orderkey""")
def w17_spread_rating(spark, d):
    """Ratings where one group has nine tenths of the rows and one value a fifth of them; nulls have no rank."""
    k = F.col("o_orderkey")
    g = table(spark, d, "orders").select("o_orderkey", F.when(k % 10 < 9, 0).otherwise(F.year("o_orderdate")).alias("y"), F.when(k % 5 == 0, 100000.0).when(k % 23 != 0, F.col("o_totalprice")).alias("v"))
    made = ranks.average_ranks(g, ["y"], "v", "rank", "size", run_values=200, hot_rows=100)
    share = F.col("rank") / F.col("size")
    return made.select("o_orderkey", r6(share).alias("pct"), W.labelled(share).alias("rating"))


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE l_orderkey END AS grp,
  CASE WHEN l_partkey % 9 <> 0 THEN l_quantity END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN v IS NULL THEN 8 ELSE least(row_number() OVER (PARTITION BY grp ORDER BY v DESC NULLS LAST, l_orderkey, l_linenumber, l_partkey, l_suppkey), 8) END::INTEGER AS place FROM g""")
def w16_spread_rank(spark, d):
    """Places in groups of which one has half of the rows: only each group's first eight are ever brought together."""
    g = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 2 == 0, -1).otherwise(F.col("l_orderkey")).alias("grp"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity")).alias("v"),
    )
    tie = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ranks.capped(g, ["grp"], "v", tie).select(*tie, "place")


@query("""WITH {f}, e AS (SELECT list_distinct(quantile_cont(points, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM f),
b AS (SELECT f.*, len(list_filter(edges, lambda x: x <= points)) AS bucket FROM f, e)
SELECT bucket::INTEGER AS bucket, count(*) AS n, round(avg((minutes >= 60)::INT), 6) AS rate FROM b GROUP BY bucket""")
def w18_quantile_buckets(spark, d):
    b = W.quantile_buckets(fact(spark, d), "points", [i / 10 for i in range(1, 10)])
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("minutes") >= 60).cast("int"))).alias("rate"))


def _sides(spark, d):
    f = fact(spark, d)
    left = f.where("kind = 'click'").select("event_id", "entity", "ts")
    right = f.where("kind = 'view'").select(
        "entity", F.date_trunc("hour", "ts").alias("rts"), "event_id", F.when(F.col("minutes") >= 10, F.col("points")).alias("elo")
    ).withColumnRenamed("event_id", "rid")
    return left.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts"))), right


_SIDES = """{f}, l AS (SELECT event_id, entity, CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts FROM f WHERE kind = 'click'),
r0 AS (SELECT entity, date_trunc('hour', ts) AS rts, event_id AS rid, CASE WHEN minutes >= 10 THEN points END AS elo FROM f WHERE kind = 'view'),
r AS (SELECT * FROM r0 QUALIFY row_number() OVER (PARTITION BY entity, rts ORDER BY rid DESC) = 1)"""


@query(f"WITH {_SIDES} SELECT event_id, round(elo, 6) AS elo FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts >= r.rts")
def j3_asof_exact(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_join(left, right, K, "ts", "rts", ["elo"], tie=["rid"]).select("event_id", r6("elo").alias("elo"))


@query(f"WITH {_SIDES} SELECT event_id, round(elo, 6) AS elo FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts > r.rts")
def j4_asof_strict(spark, d):
    left, right = _sides(spark, d)
    return asof.asof_join(left, right, K, "ts", "rts", ["elo"], exact=False, tie=["rid"], bucket_seconds=7 * 86_400).select("event_id", r6("elo").alias("elo"))


@query(f"""WITH {_SIDES}, j AS (SELECT event_id, (epoch_us(ts) - epoch_us(rts)) // 86400000000 AS days FROM l ASOF LEFT JOIN r ON l.entity = r.entity AND l.ts >= r.rts)
SELECT event_id, least(days, 1500)::BIGINT AS days, coalesce((days <= 1)::INT, 0)::DOUBLE AS recent FROM j""".replace("least(days, 1500)", "CASE WHEN days IS NOT NULL THEN least(days, 1500) END"))
def j5_asof_age(spark, d):
    left, right = _sides(spark, d)
    hit = asof.asof_join(left, right, K, "ts", "rts", ["elo"], tie=["rid"])
    return asof.with_age(hit, "ts", "rts_asof", recent=1).select("event_id", F.col("days").cast("long").alias("days"), F.col("days_recent").alias("recent"))


@query(f"""WITH {_SIDES}, x AS (SELECT event_id, entity, date_trunc('day', ts) - INTERVAL 1 DAY AS cut FROM l)
SELECT event_id, round(elo, 6) AS elo FROM x ASOF JOIN r ON x.entity = r.entity AND x.cut >= r.rts""")
def j6_asof_day_offset(spark, d):
    left, right = _sides(spark, d)
    cut = left.withColumn("cut", F.date_trunc("day", "ts") - F.expr("INTERVAL 1 DAY"))
    return asof.asof_join(cut, right, K, "cut", "rts", ["elo"], tie=["rid"]).where("rts_asof is not null").select("event_id", r6("elo").alias("elo"))


@query("""WITH {f} SELECT event_id, count(*) OVER (PARTITION BY entity ORDER BY epoch_us(ts) RANGE BETWEEN 172800000000 PRECEDING AND 1 PRECEDING) AS last2d,
  count(*) OVER (PARTITION BY entity ORDER BY epoch_us(ts) RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING) AS last7d,
round(least((epoch_us(ts) - max(epoch_us(ts)) OVER (PARTITION BY entity ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  / 86400000000.0, 60.0), 6) AS since FROM f""".replace("round(least((", "round(CASE WHEN count(*) OVER (PARTITION BY entity ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN least((").replace("60.0), 6)", "60.0) END, 6)"))
def j7_interval_counts(spark, d):
    return fact(spark, d).select(
        "event_id", asof.trailing_count("ts", K, 2).alias("last2d"), asof.trailing_count("ts", K, 7).alias("last7d"),
        r6(asof.days_since_last("ts", K)).alias("since")
    )


@query("""WITH {f}, h AS (SELECT event_id, ts, CASE WHEN event_id % 2 = 0 THEN -1 ELSE entity % 50 END AS entity FROM f WHERE kind <> 'view'),
r AS (SELECT CASE WHEN event_id % 2 = 0 THEN -1 ELSE entity % 50 END AS entity, ts FROM f WHERE kind = 'view'),
s AS (SELECT h.event_id, count(r.ts) FILTER (epoch_us(r.ts) >= epoch_us(h.ts) - 1209600000000) AS last14d, count(r.ts) FILTER (epoch_us(r.ts) >= epoch_us(h.ts) - 129600000000) AS last36h,
  (epoch_us(h.ts) - max(epoch_us(r.ts))) / 86400000000.0 AS days, any_value(k.entity) AS known
  FROM h LEFT JOIN r ON h.entity = r.entity AND r.ts < h.ts LEFT JOIN (SELECT DISTINCT entity FROM r) k ON k.entity = h.entity GROUP BY h.event_id, h.ts)
SELECT event_id, CASE WHEN known IS NOT NULL THEN last14d END AS last14d, CASE WHEN known IS NOT NULL THEN last36h END AS last36h,
  round(CASE WHEN days IS NOT NULL THEN least(days, 60.0) END, 6) AS since FROM s""")
def j7_other_table_counts(spark, d):
    """Days since, and counts of, another table's dates before each row; half of the rows have one key."""
    f = fact(spark, d).withColumn("entity", _hot_entity(F.col("entity") % 50))
    left, right = f.where("kind <> 'view'").select("event_id", "entity", "ts"), f.where("kind = 'view'").select("entity", "ts")
    made = intervals.trailing_counts(left, right, K, ["event_id"], "ts", "ts", {"last14d": 14, "last36h": 1.5}, since="since", bucket_seconds=86_400)
    return made.select("event_id", "last14d", "last36h", r6("since").alias("since"))


#: Half of the rows have one entity, so it is cut into runs of so many rows.
_CUTS = {"run_rows": 400, "bucket_seconds": 3600}
_HOT = """{f}, h AS (SELECT event_id, ts, kind, round, minutes, CASE WHEN minutes >= 10 THEN points END AS p, CASE WHEN event_id % 2 = 0 THEN -1 ELSE entity END AS entity FROM f)"""


def _hot_entity(entity):
    return F.when(F.col("event_id") % 2 == 0, -1).otherwise(entity)


def _hot(spark, d):
    p = F.when(F.col("minutes") >= 10, F.col("points"))
    return fact(spark, d).withColumn("p", p).select("event_id", "ts", "kind", "round", "minutes", "p", _hot_entity(F.col("entity")).alias("entity"))


@query(f"""WITH {_HOT} SELECT event_id, round(avg(p) OVER w3, 6) AS avg3, round(CASE WHEN count(p) OVER w10 >= 4 THEN sum(p) OVER w10 END, 6) AS sum10,
  round(sum(p) OVER w5 / greatest(sum(minutes) OVER w5, 1) * 90, 6) AS per90, round(avg((minutes >= 60)::INT) OVER w5, 6) AS start5,
  CASE WHEN lag(kind) OVER w IS NULL THEN 1.0 ELSE (lag(kind) OVER w <> kind)::INT END::DOUBLE AS new_kind, coalesce(lag((minutes >= 60)::INT::DOUBLE) OVER w, 0.0) AS started_last,
  CASE WHEN lag(ts) OVER w IS NOT NULL THEN least((epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 86400000000, 60) END::BIGINT AS rest FROM h
WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id), w3 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  w5 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), w10 AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)""")
def w1_spread_form(spark, d):
    """Bounded frames (form, rates, flags, rest) of an entity with half of the rows, cut into runs with halos."""
    p, m = F.col("p"), F.col("minutes")

    def build(k, o):
        return {
            "avg3": W.rolling(p, k, o, 3), "sum10": W.rolling(p, k, o, 10, "sum", 4), "per90": W.rolling_rate(p, m, k, o, 5), "start5": W.rolling((m >= 60).cast("int"), k, o, 5),
            "new_kind": W.changed(F.col("kind"), k, o), "started_last": W.lagged_flag(m >= 60, k, o), "rest": W.rest_days(F.col("ts"), k, o).cast("long"),
        }

    made = spread.bounded(_hot(spark, d), K, O, 10, build, **_CUTS)
    return made.select("event_id", *[r6(c).alias(c) for c in ("avg3", "sum10", "per90", "start5")], "new_kind", "started_last", "rest")


@query(f"""WITH {_HOT}, o AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, event_id) AS i FROM h),
x AS (SELECT a.event_id, sum(b.p * pow(2, (b.i - a.i) / 3.0)) / sum(CASE WHEN b.p IS NOT NULL THEN pow(2, (b.i - a.i) / 3.0) END) AS ewm3,
  sum(b.p * pow(2, (b.i - a.i) / 8.0)) / sum(CASE WHEN b.p IS NOT NULL THEN pow(2, (b.i - a.i) / 8.0) END) AS ewm8
  FROM o a LEFT JOIN (SELECT entity, i, p, unnest(range(i + 1, i + 301)) AS at FROM o) b ON b.entity = a.entity AND b.at = a.i GROUP BY a.event_id)
SELECT event_id, round(ewm3, 6) AS ewm3, round(ewm8, 6) AS ewm8 FROM x""")
def w6_spread_ewma(spark, d):
    """Decayed means of such an entity; the SQL looks back 300 rows, beyond which weights are under 2 ** -37."""
    made = spread.lagged_ewma(_hot(spark, d), F.col("p"), K, O, {"ewm3": 3, "ewm8": 8}, **_CUTS)
    return made.select("event_id", r6("ewm3").alias("ewm3"), r6("ewm8").alias("ewm8"))


@query(f"""WITH {_HOT}, g AS (SELECT event_id, lag(p) OVER w AS before, sum(p) OVER b AS s, coalesce(sum(CASE WHEN p IS NOT NULL THEN minutes END) OVER b, 0) AS seen,
  coalesce(sum((minutes > 60)::INT) OVER b, 0) AS late, count(p) OVER b AS n, row_number() OVER w AS i, count(*) OVER (PARTITION BY entity) AS m FROM h
WINDOW w AS (PARTITION BY entity ORDER BY ts, event_id), b AS (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, round(CASE WHEN before IS NOT NULL THEN s / (i - 1) END, 6) AS ppg, seen::BIGINT AS seen, round(s / nullif(seen, 0) * 90, 6) AS rate, late::BIGINT AS late,
  round(s / nullif(n, 0), 6) AS vs_mean, n::BIGINT AS vs_n, (m - i + 1)::BIGINT AS rn FROM g""")
def w7_spread_to_date(spark, d):
    """Season-to-date means, rates, totals, expanding means and recency of such an entity, in one pass over its runs."""
    p, m = F.col("p"), F.col("minutes")
    sums = {"s": p, "e": F.when(p.isNotNull(), m), "late": (m > 60).cast("long"), "n": p.isNotNull().cast("long")}
    made = spread.running(_hot(spark, d), K, O, sums, {"before": p}, left="later", **_CUTS)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rate = F.col("s") / F.nullif(F.col("e"), F.lit(0)) * 90
    return made.select(
        "event_id", r6(F.when(F.col("before").isNotNull(), F.col("s") / F.col("_place"))).alias("ppg"), zero("e").alias("seen"), r6(rate).alias("rate"), zero("late").alias("late"),
        r6(F.col("s") / F.nullif(F.col("n"), F.lit(0))).alias("vs_mean"), zero("n").alias("vs_n"), (F.col("later") + 1).cast("long").alias("rn"),
    )


@query("""WITH {f} SELECT event_id, round(avg(points) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form
  FROM f
UNION ALL SELECT -event_id - 1, round(avg(points) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) FROM f
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) = 1""")
def t10_history_with_stubs(spark, d):
    """A stub row after each entity's history goes through the same windows as history."""
    f = fact(spark, d).withColumn("is_inference", F.lit(False))
    stubs = f.groupBy("entity").agg(F.max(F.struct("ts", "event_id")).alias("m")).select(
        "entity", (F.col("m.ts") + F.expr("INTERVAL 1 SECOND")).alias("ts"), (-F.col("m.event_id") - 1).alias("event_id"),
        F.lit(True).alias("is_inference")
    )
    both = f.unionByName(stubs, allowMissingColumns=True)
    return both.select("event_id", r6(W.rolling(F.col("points"), K, O, 5)).alias("form"))
