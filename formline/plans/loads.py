"""Load, clean, join, upsert, resolution and parse queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formline.functions.numeric import bins, clip, flag
from formline.functions.text import normalised
from formline.operators import clean as C, joins as J, resolve, wiki, windows as W
from formline.sources import files, sinks, staging
from formline.plans.tables import fact, query, r6, table

K, O = ["entity"], ["ts", "event_id"]


@query("""SELECT o_orderkey, c_name, n_name, r_name, round(o_totalprice, 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey IS NOT NULL""")
def j1_star_join(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey").withColumnRenamed("c_nationkey", "n_nationkey")
    n, r = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), table(spark, d, "region")
    star = J.star(table(spark, d, "orders"), [(c, ["o_custkey"], "inner"), (n, ["n_nationkey"], "left"), (r, ["r_regionkey"], "left")])
    return star.select("o_orderkey", "c_name", "n_name", "r_name", F.round("o_totalprice", 2).alias("price"))


@query("""SELECT p_partkey, p_brand, o_orderkey, true AS is_inference FROM part JOIN (SELECT o_orderkey, 'Brand#' || (o_orderkey % 25 + 1)::VARCHAR AS p_brand
  FROM orders WHERE year(o_orderdate) = 1995 AND month(o_orderdate) = 1) USING (p_brand)""")
def j2_inference_stubs(spark, d):
    fx = table(spark, d, "orders").where((F.year("o_orderdate") == 1995) & (F.month("o_orderdate") == 1)).select(
        "o_orderkey", F.concat(F.lit("Brand#"), (F.col("o_orderkey") % 25 + 1).cast("string")).alias("p_brand")
    )
    return J.stubs(table(spark, d, "part").select("p_partkey", "p_brand"), fx, "p_brand")


_VIEWS = """v AS (SELECT l_orderkey, l_linenumber, l_suppkey AS team, l_partkey AS opponent, l_quantity AS scored, true AS was_home FROM lineitem UNION ALL
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax * 100, false FROM lineitem)"""


@query(f"WITH {_VIEWS} SELECT team, was_home, count(*) AS n, round(sum(scored), 4) AS scored FROM v GROUP BY ALL")
def p8_home_away_views(spark, d):
    li = table(spark, d, "lineitem").withColumn("away_goals", F.col("l_tax") * 100)
    v = J.both_views(li, ["l_orderkey", "l_linenumber"], {"team": ("l_suppkey", "l_partkey"), "opponent": ("l_partkey", "l_suppkey"), "scored": ("l_quantity", "away_goals")})
    return v.groupBy("team", "was_home").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("scored"), 4).alias("scored"))


@query("""WITH g AS (SELECT l_orderkey, l_shipdate, l_suppkey AS home, l_partkey AS away FROM lineitem), now AS (SELECT max(l_shipdate) - INTERVAL 60 DAY AS t FROM g),
n AS (SELECT s.s_suppkey, count(*) AS n, min(l_shipdate) AS first FROM supplier s JOIN g ON home = s_suppkey OR away = s_suppkey, now WHERE l_shipdate >= t AND (home <> away) GROUP BY 1
  UNION ALL SELECT home, 2 * count(*), min(l_shipdate) FROM g, now WHERE l_shipdate >= t AND home = away GROUP BY 1)
SELECT supplier.s_suppkey, sum(n)::BIGINT AS n, min(first)::DATE::VARCHAR AS first FROM supplier LEFT JOIN n USING (s_suppkey) GROUP BY 1""")
def j18_either_side_next(spark, d):
    """What comes next for every team, at home or away: fixtures of the last sixty days; teams with none stay."""
    li = table(spark, d, "lineitem").select("l_shipdate", "l_suppkey", "l_partkey")
    now = li.agg((F.max("l_shipdate") - F.expr("INTERVAL 60 DAY")).alias("now"))
    coming = li.crossJoin(F.broadcast(now)).where("l_shipdate >= now")  # one row
    v = J.both_views(coming, ["l_shipdate"], {"team": ("l_suppkey", "l_partkey")})
    n = v.groupBy(F.col("team").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.min("l_shipdate").alias("first"))
    return table(spark, d, "supplier").select("s_suppkey").join(n, "s_suppkey", "left").select("s_suppkey", "n", F.to_date("first").cast("string").alias("first"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE o_custkey END::DOUBLE AS picked FROM orders
  WHERE o_orderkey % 5 + 1 BETWEEN 1 AND 4""")
def p6_p7_position_and_side(spark, d):
    o = table(spark, d, "orders").withColumn("position", F.col("o_orderkey") % 5 + 1).where(F.col("position").between(1, 4))
    return o.select("o_orderkey", J.pick_side(F.col("o_orderkey") % 2 == 0, "o_totalprice", "o_custkey").cast("double").alias("picked"))


@query("""WITH k AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
SELECT CASE WHEN c_custkey IS NULL THEN 'unmatched' ELSE 'matched' END AS side, count(*) AS n FROM orders LEFT JOIN k ON c_custkey = o_custkey
  GROUP BY 1""")
def j9_match_report(spark, d):
    customers = table(spark, d, "customer")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    J.require_known(o, customers, ["c_custkey"])
    both = J.match_report(o, customers.where("c_acctbal > 0").select("c_custkey"), ["c_custkey"])
    return both.groupBy(F.when(F.col("matched"), "matched").otherwise("unmatched").alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH {f}, o AS (SELECT entity, round, points AS other FROM f WHERE kind = 'view'
  QUALIFY row_number() OVER (PARTITION BY entity, round ORDER BY ts, event_id) = 1)
SELECT event_id, CASE WHEN minutes < 30 AND round < TIMESTAMP '2024-01-20' THEN other WHEN minutes < 30 THEN NULL ELSE points END AS xg FROM f
  LEFT JOIN o USING (entity, round) WHERE kind = 'click'""")
def j10_same_day_fill(spark, d):
    f = fact(spark, d)
    click = f.where("kind = 'click'").withColumn("xg", F.when(F.col("minutes") >= 30, F.col("points")))
    filled = J.fill(click, f.where("kind = 'view'"), ["entity", "round"], "xg", "points", O, F.col("round") < F.lit("2024-01-20").cast("timestamp"))
    return filled.select("event_id", "xg")


@query("""WITH t AS (SELECT l_orderkey, l_suppkey AS team, sum(l_quantity) AS form FROM lineitem
  GROUP BY ALL), g AS (SELECT l_orderkey, team, form, CASE WHEN team = min(team) OVER w THEN max(team) OVER w ELSE min(team) OVER w END AS opponent
  FROM t WINDOW w AS (PARTITION BY l_orderkey))
SELECT a.l_orderkey, a.team, a.form, b.form AS opp_form FROM g a LEFT JOIN g b ON a.l_orderkey = b.l_orderkey AND a.opponent = b.team
  WHERE a.team IN (SELECT min(team) FROM g x WHERE x.l_orderkey = a.l_orderkey UNION SELECT max(team) FROM g x WHERE x.l_orderkey = a.l_orderkey)""")
def j11_opponent_form(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").alias("team")).agg(F.sum("l_quantity").alias("form"))
    w = Window.partitionBy("l_orderkey")
    g = t.withColumns({"lo": F.min("team").over(w), "hi": F.max("team").over(w)}).where("team in (lo, hi)").withColumn(
        "opponent", F.when(F.col("team") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    ).drop("lo", "hi")
    return J.opposite(g, ["l_orderkey"], "team", "opponent", ["form"]).select("l_orderkey", "team", "form", "opp_form")


@query("""WITH t AS (SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey % 4 <> 0), j AS (SELECT DISTINCT l_orderkey, l_suppkey, s_acctbal AS v
  FROM lineitem LEFT JOIN t ON l_suppkey = s_suppkey) SELECT l_orderkey, l_suppkey, round(coalesce(v, avg(v) OVER (), 1.4), 6) AS lam FROM j""")
def j12_lookup_with_fallback(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")).distinct()
    out = J.look_up(li, table(spark, d, "supplier").where("s_suppkey % 4 != 0"), ["s_suppkey"], "s_acctbal", 1.4, "lam")
    return out.select("l_orderkey", F.col("s_suppkey").alias("l_suppkey"), r6("lam").alias("lam"))


@query("WITH {f} SELECT event_id FROM f WHERE kind = 'click' AND (entity, round) IN (SELECT entity, round FROM f WHERE kind = 'view')")
def j17_semi_filter(spark, d):
    f = fact(spark, d)
    return J.on_both(f.where("kind = 'click'"), f.where("kind = 'view'"), ["entity", "round"]).select("event_id")


@query("""WITH v AS (SELECT l_orderkey, l_suppkey AS team, l_partkey % 100 AS other, l_quantity AS g, true AS was_home FROM lineitem UNION ALL
  SELECT l_orderkey, l_partkey % 100, l_suppkey, l_discount * 100, false FROM lineitem)
SELECT team, was_home, n_name, count(*) AS n, round(avg(g), 6) AS g FROM v JOIN supplier ON team = s_suppkey
  LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def j19_team_fixture_star(spark, d):
    li = table(spark, d, "lineitem").withColumns({"away": F.col("l_partkey") % 100, "ag": F.col("l_discount") * 100})
    v = J.both_views(li, ["l_orderkey"], {"s_suppkey": ("l_suppkey", "away"), "g": ("l_quantity", "ag")})
    s, n = table(spark, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(spark, d, "nation")
    out = J.star(v, [(s, ["s_suppkey"], "inner"), (n, ["n_nationkey"], "left")])
    return out.groupBy(F.col("s_suppkey").alias("team"), "was_home", "n_name").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("g")).alias("g"))


@query("""SELECT c_custkey, c_name, n_name, count(o_orderkey) AS orders_1998 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3
  LEFT JOIN orders ON o_custkey = c_custkey AND year(o_orderdate) = 1998 GROUP BY ALL""")
def j20_pool_detail(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").where(F.year("o_orderdate") == 1998).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("k"))
    out = J.star(table(spark, d, "customer"), [(n, ["c_nationkey"], "left"), (o, ["c_custkey"], "left")])
    return out.select("c_custkey", "c_name", "n_name", F.coalesce("k", F.lit(0)).alias("orders_1998"))


# -- cleaning ------------------------------------------------------------------------------------


@query("""SELECT o_custkey, year(o_orderdate)::INTEGER AS y, o_orderkey FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1""")
def p1_first_rows(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate"))
    return C.first_rows(o, ["o_custkey", "y"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "y", "o_orderkey")


@query("""SELECT count(*) FILTER (c_custkey IS NULL) AS n_dropped, count(c_custkey) AS n_kept FROM orders
  LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) ON o_custkey = c_custkey""")
def p2_id_mapping(spark, d):
    kept, dropped = C.map_ids(table(spark, d, "orders"), "o_custkey", table(spark, d, "customer").where("c_custkey % 10 != 0"), "c_custkey", "c_name", "code")
    return dropped.crossJoin(kept.agg(F.count(F.lit(1)).alias("n_kept")))  # one row each


@query("""SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS x,
  TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'soon' ELSE '2024-01-0' || (event_id % 9 + 1)::VARCHAR END AS DATE)::VARCHAR AS day FROM events""")
def p3_lenient_parses(spark, d):
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    day = F.when(F.col("event_id") % 7 == 0, "soon").otherwise(F.concat(F.lit("2024-01-0"), (F.col("event_id") % 9 + 1).cast("string")))
    return e.select("event_id", text.try_cast("double").alias("x"), day.try_cast("date").cast("string").alias("day"))


@query("""SELECT o_orderkey, year(o_orderdate)::VARCHAR || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS name,
  substr(year(o_orderdate)::VARCHAR, 3, 2) || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS code, year(o_orderdate)::INTEGER AS start
  FROM orders""")
def p4_season_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", C.season_name(F.col("o_orderdate")).alias("name"))
    return o.select("o_orderkey", "name", C.season_code(F.col("name")).alias("code"), C.start_year(F.col("name")).alias("start"))


@query("SELECT p_partkey, trim(regexp_replace(lower(strip_accents(p_name || ' Ünï-Côdé.x')), '[-. ]+', ' ', 'g')) AS name FROM part")
def p5_name_normalisation(spark, d):
    return table(spark, d, "part").select("p_partkey", normalised(F.concat("p_name", F.lit(" &Uuml;nï-Côdé.x"))).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 130 < 45 THEN 0 WHEN o_custkey % 130 < 55 THEN 1 WHEN o_custkey % 130 < 65 THEN 2
  WHEN o_custkey % 130 < 80 THEN 3 WHEN o_custkey % 130 < 100 THEN 4 ELSE 5 END AS bucket FROM orders""")
def p9_price_buckets(spark, d):
    return table(spark, d, "orders").select("o_orderkey", bins(F.col("o_custkey") % 130, [0, 45, 55, 65, 80, 100, 1000]).alias("bucket"))


@query("""WITH {f}, g AS (SELECT event_id, CASE WHEN minutes % 4 = 0 THEN NULL ELSE minutes * 5 END AS m, CASE WHEN minutes % 11 = 0 THEN NULL ELSE minutes % 9 END AS pr,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id % 20 + 1 END AS gw, event_id % 10 <> 7 AS there FROM f),
h AS (SELECT *, CASE WHEN gw IS NULL THEN 0 ELSE greatest(0, 1 - (gw - 1) / 8) END AS a, CASE WHEN gw IS NULL OR gw < 17 THEN 0 ELSE greatest(0, 1 - (gw - 17) / 8) END AS b,
  coalesce(m, [180, 270, 340, 420, 500, 580, 580][CASE WHEN pr BETWEEN 1 AND 7 THEN pr ELSE 1 END]) AS mm, CASE WHEN pr IS NULL OR pr = 0 THEN 1 ELSE pr END AS level FROM g)
SELECT event_id, CASE WHEN there THEN round(greatest(mm * a, mm * b), 6) ELSE 0 END::DOUBLE AS load, CASE WHEN there THEN round(greatest(level * a, level * b), 6) ELSE 0 END::DOUBLE AS progress FROM h""")
def p10_fading_load(spark, d):
    """Rows of one kind took no part; some minutes, levels and rounds are unknown, some levels out of range."""
    m, pr = F.when(F.col("minutes") % 4 != 0, F.col("minutes") * 5), F.when(F.col("minutes") % 11 != 0, F.col("minutes") % 9)
    gw, there = F.when(F.col("event_id") % 23 != 0, F.col("event_id") % 20 + 1), F.col("event_id") % 10 != 7
    (a, x), (b, y) = C.fading_load(m, pr, gw, there=there), C.fading_load(m, pr, gw, first=17, there=there)
    return fact(spark, d).select("event_id", r6(F.greatest(a, b)).alias("load"), r6(F.greatest(x, y)).alias("progress"))


@query("""WITH t AS (SELECT o_custkey, year(o_orderdate) + 1 AS y, sum(o_totalprice) AS m, count(*) AS n, max(o_orderdate) AS last FROM orders
  WHERE o_orderpriority = '1-URGENT' GROUP BY ALL)
SELECT o_orderkey, round(coalesce(m, 0), 2) AS minutes, coalesce(n, 0) AS n,
  CASE WHEN last IS NOT NULL THEN least(greatest(date_diff('day', last, o_orderdate), 0), 90) END::BIGINT AS rest FROM orders o
  LEFT JOIN t ON t.o_custkey = o.o_custkey AND t.y = year(o_orderdate)""")
def p11_bridge_features(spark, d):
    o = table(spark, d, "orders")
    t = o.where("o_orderpriority = '1-URGENT'").groupBy("o_custkey", (F.year("o_orderdate") + 1).alias("y")).agg(
        F.sum("o_totalprice").alias("m"), F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last")
    )
    j = o.withColumn("y", F.year("o_orderdate")).join(t, ["o_custkey", "y"], "left")
    return j.select(
        "o_orderkey", F.round(F.coalesce("m", F.lit(0.0)), 2).alias("minutes"), F.coalesce("n", F.lit(0)).alias("n"),
        clip(F.datediff("o_orderdate", "last"), 0, 90).cast("long").alias("rest")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce((CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_linenumber END = 1)::INT,
  0)::DOUBLE AS taker, (coalesce(CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_linenumber END, 9) <= 2)::INT::DOUBLE AS corner
  FROM lineitem""")
def p12_duty_flags(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = F.when(F.col("l_suppkey") % 6 != 0, F.col("l_linenumber"))
    return li.select("*", flag(order == 1).alias("taker"), (F.coalesce(order, F.lit(9)) <= 2).cast("double").alias("corner"))


@query("SELECT s_suppkey, CASE s_nationkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS level FROM supplier")
def p13_competition_level(spark, d):
    levels = spark.createDataFrame([(0, 2), (1, 1)], "k int, level int")  # fixed two-row dimension
    s = table(spark, d, "supplier").withColumn("k", F.col("s_nationkey") % 5).join(F.broadcast(levels), "k", "left")
    return s.select("s_suppkey", F.coalesce("level", F.lit(0)).alias("level"))


@query("""SELECT o_orderkey, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1970-03-01')) // 86400000000 / 365.25, 6) AS age FROM orders""")
def p14_age(spark, d):
    return table(spark, d, "orders").select("o_orderkey", r6(C.age_years(F.col("o_orderdate"), F.lit("1970-03-01"))).alias("age"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, round(value / 100, 4) AS p FROM events""")
def p21_json_round_trip(spark, d):
    e = table(spark, d, "events")
    doc = sinks.drivers_json(
        F.array(F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").cast("double").alias("points"))),
        F.round(F.col("value") / 100, 4), F.lit(0.0), F.lit(None).cast("double"), F.lit(False)
    )
    back = F.from_json(doc, "components array<struct<name string, points double>>, p_start double")
    return e.select("event_id", back.alias("b")).select("event_id", F.col("b.components")[0]["points"].cast("int").alias("k"), F.col("b.p_start").alias("p"))


@query("""SELECT p_partkey, round(p_retailprice / 10, 4) AS price, round(p_size / (p_retailprice / 10), 6) AS per_million,
  p_size - coalesce(nullif(p_partkey % 3, 0), 0) AS net FROM part""")
def p29_price_arithmetic(spark, d):
    price = F.col("p_retailprice") / 10
    return table(spark, d, "part").select(
        "p_partkey", F.round(price, 4).alias("price"), r6(F.col("p_size") / price).alias("per_million"),
        (F.col("p_size") - F.coalesce(F.nullif(F.col("p_partkey") % 3, F.lit(0)), F.lit(0))).alias("net")
    )


@query("""WITH c AS (SELECT l_suppkey, l_shipdate, l_linenumber, max(l_extendedprice) AS x FROM lineitem WHERE l_quantity >= 25 GROUP BY ALL)
  SELECT l_suppkey, l_shipdate, l_linenumber, x FROM c""")
def a8_team_max(spark, d):
    return table(spark, d, "lineitem").where("l_quantity >= 25").groupBy("l_suppkey", "l_shipdate", "l_linenumber").agg(F.max("l_extendedprice").alias("x"))


@query("""WITH {f}, c AS (SELECT kind, round, entity % 4 AS pos, avg(points) AS pts FROM f WHERE minutes >= 60 GROUP BY ALL)
  SELECT kind, round::TIMESTAMP AS round, pos, round(CASE WHEN count(pts) OVER w >= 5 THEN avg(pts) OVER w END, 6) AS conceded FROM c
  WINDOW w AS (PARTITION BY kind, pos ORDER BY round ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def a9_conceded_by_position(spark, d):
    c = fact(spark, d).where("minutes >= 60").groupBy(
        "kind", F.col("round").cast("timestamp_ntz").alias("round"), (F.col("entity") % 4).alias("pos")
    ).agg(F.avg("points").alias("pts"))
    return c.select("kind", "round", "pos", r6(W.rolling(F.col("pts"), ["kind", "pos"], ["round"], 10, min_obs=5, lagged=False)).alias("conceded"))


@query("""WITH s AS (SELECT o_custkey AS team, year(o_orderdate) AS y, CASE WHEN count(*) % 3 = 0 THEN 0 ELSE count(*) END AS strength FROM orders
  GROUP BY ALL), c AS (SELECT DISTINCT team FROM s),
b AS (SELECT team, max_by(strength, y) FILTER (strength > 0) AS last FROM s WHERE y < 2001 GROUP BY team), m AS (SELECT round(avg(strength)) AS mean
  FROM s WHERE strength > 0 AND y < 2001)
SELECT c.team, coalesce(nullif(n.strength, 0), b.last, m.mean)::BIGINT AS strength FROM c LEFT JOIN (SELECT * FROM s WHERE y = 2001) n USING (team)
  LEFT JOIN b USING (team), m""")
def a10_strength_backfill(spark, d):
    n = F.count(F.lit(1))
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("team"), F.year("o_orderdate").alias("y")).agg(F.when(n % 3 != 0, n).alias("strength"))
    by = s.groupBy("team").agg(
        F.max(F.when(F.col("y") == 2001, F.col("strength"))).alias("now"),
        F.max_by("strength", F.when((F.col("y") < 2001) & F.col("strength").isNotNull(), F.col("y"))).alias("last")
    )
    mean = s.where("y < 2001").agg(F.round(F.avg("strength")).alias("mean"))
    return by.crossJoin(F.broadcast(mean)).select("team", F.coalesce("now", "last", "mean").cast("long").alias("strength"))  # one row


# -- sources and sinks ---------------------------------------------------------------------------


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS season, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS xg,
  o_custkey::INTEGER AS points FROM orders""")
def s1_s2_drifting_columns(spark, d):
    """Two seasons' CSV files with different columns and names, read, conformed to one schema and united."""
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("xg", DoubleType()), StructField("points", IntegerType())])
    o = table(spark, d, "orders")
    text = lambda df, *c: df.select(*[x.cast("string").alias(n) for n, x in c])
    even = text(o.where("o_orderkey % 2 = 0"), ("element", F.col("o_orderkey")), ("expected_goals", F.col("o_totalprice")), ("pts", F.col("o_custkey")))
    odd = text(o.where("o_orderkey % 2 = 1"), ("element", F.col("o_orderkey")), ("pts", F.col("o_custkey")), ("extra", F.lit("x")))
    paths = {"even": staging.scratch(spark, "season-even"), "odd": staging.scratch(spark, "season-odd")}
    for season, rows in (("even", even), ("odd", odd)):
        rows.write.csv(paths[season], header=True)
    return files.season_csvs(spark, paths, schema, {"element": "id", "expected_goals": "xg", "pts": "points"})


@query("""SELECT conv_id, turn, length(text) AS n FROM conversations""")
def s3_nested_json(spark, d):
    """Conversations as nested JSON files, read by schema and exploded to a row per turn."""
    path = staging.scratch(spark, "nested")
    table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "text")).alias("history")).write.json(path)
    rows = files.json_table(spark, path, "conv_id long, history array<struct<turn long, text string>>", "history", ["conv_id"], lines=True)
    return rows.select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("""WITH l AS (SELECT n_name AS team, r_name AS league FROM nation JOIN region ON n_regionkey = r_regionkey
  WHERE n_nationkey % 4 <> 3), m AS (SELECT o_custkey AS uid, o_orderkey % 50 AS match_id, o_orderkey AS seq, year(o_orderdate) AS season,
  'NATION_' || (o_orderkey % 30) AS home, 'NATION_' || (o_custkey % 25) AS away FROM orders WHERE year(o_orderdate) >= 1998),
k AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY uid, match_id ORDER BY seq DESC) = 1)
  SELECT uid, match_id, season::INTEGER AS season, coalesce(h.league, a.league, 'unknown') AS league FROM k LEFT JOIN l h ON h.team = home
  LEFT JOIN l a ON a.team = away""")
def s4_match_rows(spark, d):
    leagues = table(spark, d, "nation").where("n_nationkey % 4 != 3").join(
        table(spark, d, "region"), F.expr("n_regionkey = r_regionkey")
    ).select(F.col("n_name").alias("team"), F.col("r_name").alias("league"))
    k = F.col("o_orderkey")
    m = table(spark, d, "orders").select(
        F.col("o_custkey").alias("uid"), (k % 50).alias("match_id"), k.alias("seq"), F.year("o_orderdate").alias("season"),
        F.concat(F.lit("NATION_"), (k % 30).cast("string")).alias("home"),
        F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("away")
    )
    return files.match_rows(m, leagues, 1998).select("uid", "match_id", "season", "league")


@query("""WITH p AS (SELECT o_orderkey AS seq, 'L' || (o_orderkey % 5) AS league,
  unnest(string_split('T' || (o_custkey % 40) || ', T' || (o_custkey % 7), ',')) AS team FROM orders)
  SELECT trim(team) AS team, max_by(league, seq) AS league FROM p GROUP BY 1""")
def s5_team_leagues(spark, d):
    k = F.col("o_custkey")
    p = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("L"), (F.col("o_orderkey") % 5).cast("string")).alias("league"),
        F.concat(F.lit("T"), (k % 40).cast("string"), F.lit(", T"), (k % 7).cast("string")).alias("team_title")
    )
    return files.team_leagues(p)


@query("""WITH c AS (SELECT o_orderkey, 'S' || year(o_orderdate) AS season_name
  FROM orders), s AS (SELECT DISTINCT 'S' || year(o_orderdate) AS name, year(o_orderdate) - 1990 AS id FROM orders WHERE year(o_orderdate) < 2000)
  SELECT 'known' AS side, count(*) AS n, sum(id)::BIGINT AS ids FROM c JOIN s ON name = season_name UNION ALL SELECT 'unknown', count(*), NULL FROM c
  WHERE season_name NOT IN (SELECT name FROM s)""")
def s6_known_seasons(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"))
    name = F.concat(F.lit("S"), F.col("y").cast("string"))
    seasons = o.where("y < 2000").select(name.alias("name"), (F.col("y") - 1990).alias("id")).distinct()
    known, unknown = files.with_known_season(o.select("o_orderkey", name.alias("season_name")), seasons)
    return known.agg(F.count(F.lit(1)).alias("n"), F.sum("season_id").alias("ids")).select(F.lit("known").alias("side"), "n", "ids").unionByName(
        unknown.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unknown").alias("side"), "n", F.lit(None).cast("long").alias("ids"))
    )


@query("""SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS valid_from, (o_orderdate + INTERVAL 30 DAY)::DATE::VARCHAR AS valid_to FROM orders
  WHERE o_orderdate + INTERVAL 30 DAY >= DATE '1999-06-01'""")
def s7_rating_history(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("valid_from"),
        F.date_add(F.to_date("o_orderdate"), 30).cast("string").alias("valid_to")
    )
    return files.rating_history(o, "1999-06-01").select("o_orderkey", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query("""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_totalprice * 2 END AS price FROM orders WHERE o_orderkey % 10 = 0
  UNION ALL SELECT o_orderkey + 1000000, 1.5 FROM orders WHERE o_orderkey % 100 = 1)
SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, t.o_orderstatus AS status,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.price ELSE t.o_totalprice END AS price FROM orders t FULL JOIN s ON s.o_orderkey = t.o_orderkey""")
def s8_upsert(spark, d):
    o = table(spark, d, "orders")
    target = o.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    changed = o.where("o_orderkey % 10 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 20 != 0, F.col("o_totalprice") * 2).alias("price"))
    new = o.where("o_orderkey % 100 = 1").select((F.col("o_orderkey") + 1000000).alias("o_orderkey"), F.lit(1.5).alias("price"))
    return sinks.upsert(target, changed.unionByName(new), ["o_orderkey"])


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'moved' WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'O' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN -1.0 ELSE o_totalprice END AS price FROM orders
UNION ALL SELECT o_orderkey + 100000000, 'new', 1.5 FROM orders WHERE o_orderkey % 100 = 1""")
def s8_moving_keys(spark, d):
    """Upserts into a table on disk by which rows change their partition, one of them run twice."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("double").alias("price"))
    path, k = staging.scratch(spark, "moving"), F.col("o_orderkey")
    sinks.write_partitioned(o, path, ["status"])
    sinks.upsert_table(spark, path, o.where("status = 'F' and o_orderkey % 2 = 0").select("o_orderkey", F.lit("O").alias("status")), ["o_orderkey"], ["status"])
    moved = o.where(k % 10 == 0).select("o_orderkey", F.lit("moved").alias("status"), F.lit(-1.0).alias("price"))
    new = o.where(k % 100 == 1).select((k + 100000000).alias("o_orderkey"), F.lit("new").alias("status"), F.lit(1.5).alias("price"))
    for _ in range(2):
        sinks.upsert_table(spark, path, moved.unionByName(new), ["o_orderkey"], ["status"])
    return spark.read.parquet(path).select("o_orderkey", "status", "price")


@query("""WITH s AS (SELECT c_custkey, 'X' || c_custkey AS seg FROM customer WHERE c_custkey % 7 = 0)
  SELECT customer.c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer LEFT JOIN s USING (c_custkey)""")
def s9_partial_update(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    rows = c.where("c_custkey % 7 = 0").select("c_custkey", F.concat(F.lit("X"), F.col("c_custkey").cast("string")).alias("c_mktsegment"))
    nobody = c.agg((F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("c_custkey")).select("c_custkey", F.lit("never").alias("c_mktsegment"))  # no such customer
    rows = rows.unionByName(nobody)
    return sinks.update(c, rows, ["c_custkey"], ["c_mktsegment"])


@query("SELECT r_regionkey, r_regionkey = 2 AS is_current FROM region")
def s10_flip_current(spark, d):
    return sinks.flip_current(table(spark, d, "region"), "r_regionkey", 2).select("r_regionkey", "is_current")


@query("""SELECT 'orders' AS "table", count(*) AS n_rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events""")
def s11_row_counts(spark, d):
    return sinks.row_counts({t: table(spark, d, t) for t in ("orders", "part", "events")})


@query("""WITH {f}, p AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v2' ELSE 'v3' END AS model_version, round(points, 6) AS predicted FROM f)
  SELECT event_id, model_version, predicted FROM p WHERE model_version = 'v3'""")
def s12_versioned_predictions(spark, d):
    p = fact(spark, d).select("event_id", F.when(F.col("event_id") % 2 == 0, "v2").otherwise("v3").alias("model_version"), r6("points").alias("predicted"))
    path = staging.scratch(spark, "predictions")
    sinks.write_partitioned(p, path, ["model_version"])
    return sinks.model_version(spark.read.parquet(path), "v3").select("event_id", "model_version", "predicted")


# -- resolution and parsing ----------------------------------------------------------------------


def _names(spark, d):
    """Customers under misspelt names against their own list, blocked by nation and segment."""
    c = table(spark, d, "customer").select(
        "c_custkey", F.concat_ws(" ", F.lower("c_mktsegment"), F.translate(F.substring("c_name", 10, 9), "0123456789", "abcdefghij")).alias("name"),
        F.concat_ws("/", "c_nationkey", "c_mktsegment").alias("team")
    )
    right = c.select(F.col("c_custkey").alias("code"), "name", "team")
    k = F.col("c_custkey")
    left = c.select(
        (k + 500000).alias("uid"), F.when(k % 3 == 0, F.concat(F.col("name"), F.lit("s"))).otherwise(F.col("name")).alias("name"),
        F.when(k % 5 == 1, "elsewhere").otherwise(F.col("team")).alias("team")
    )
    return left, right


def _roled(spark, d):
    """The same names with roles on both sides, and the list's last words as second names."""
    left, right = _names(spark, d)
    k = F.col("uid") - 500000
    short = F.element_at(F.split("name", " "), -1)
    left = left.withColumns({"name": F.when(k % 6 == 0, F.concat(F.translate(short, "s", ""), F.lit("x"))).otherwise(F.col("name")), "role": F.when(k % 7 != 0, k % 2)})
    return left, right.withColumns({"web": F.when(F.col("code") % 4 != 1, short), "role": F.col("code") % 2})


#: Names as ``_roled`` makes them, and the score of every pair in ``pairs`` (a, b, c) as the better of both names: longest common subsequences by bits.
_ROLED = """c AS (SELECT c_custkey AS k, translate(substring(c_name, 10, 9), '0123456789', 'abcdefghij') AS w, lower(c_mktsegment) AS seg, c_nationkey || '/' || c_mktsegment AS team FROM customer),
r AS (SELECT k AS code, seg || ' ' || w AS b, CASE WHEN k % 4 <> 1 THEN w END AS c, team, k % 2 AS role FROM c),
l AS (SELECT k + 500000 AS uid, CASE WHEN k % 6 = 0 THEN w || 'x' WHEN k % 3 = 0 THEN seg || ' ' || w || 's' ELSE seg || ' ' || w END AS a,
  CASE WHEN k % 5 = 1 THEN 'elsewhere' ELSE team END AS team, CASE WHEN k % 7 <> 0 THEN k % 2 END AS role FROM c)"""
_SCORES = """two AS (SELECT DISTINCT a, b FROM pairs UNION SELECT DISTINCT a, c FROM pairs WHERE c IS NOT NULL),
ws AS (SELECT a, b, list_sort(string_split(a, ' ')) AS x, list_sort(string_split(b, ' ')) AS y FROM two),
st AS (SELECT a, b, array_to_string(x, ' ') AS sa, array_to_string(y, ' ') AS sb, array_to_string(list_filter(list_sort(list_distinct(x)), lambda w: list_contains(y, w)), ' ') AS common,
  array_to_string(list_filter(list_sort(list_distinct(x)), lambda w: NOT list_contains(y, w)), ' ') AS lo, array_to_string(list_filter(list_sort(list_distinct(y)), lambda w: NOT list_contains(x, w)), ' ') AS ro FROM ws),
cmp AS (SELECT a, b, unnest([{'x': sa, 'y': sb, 'd': 0}, {'x': trim(common || ' ' || lo), 'y': trim(common || ' ' || ro), 'd': 2}, {'x': common, 'y': trim(common || ' ' || lo), 'd': 2}, {'x': common, 'y': trim(common || ' ' || ro), 'd': 2}]) AS s
  FROM st),
lcs AS (SELECT a, b, s.x AS x, s.y AS y, s.d AS d, (1::BIGINT << length(s.x)) - 1 AS full_, list_reduce(list_prepend((1::BIGINT << length(s.x)) - 1, list_transform(string_split(s.y, ''),
  lambda ch: list_sum(list_transform(range(length(s.x)), lambda i: CASE WHEN substring(s.x, i + 1, 1) = ch THEN 1::BIGINT << i ELSE 0 END))::BIGINT)),
  lambda row, m: ((row + (row & m)) | (row - (row & m))) & ((1::BIGINT << length(s.x)) - 1)) AS row FROM cmp WHERE s.x <> ''),
sc AS (SELECT a, b, max(200.0 * (length(x) - bit_count(row)) / (length(x) + length(y)) - d) AS score FROM lcs GROUP BY a, b),
scored AS (SELECT p.*, greatest(s.score, coalesce(t.score, 0)) AS score FROM pairs p JOIN sc s ON s.a = p.a AND s.b = p.b LEFT JOIN sc t ON t.a = p.a AND t.b = p.c),
best AS (SELECT *, coalesce(lead(score) OVER (PARTITION BY uid ORDER BY score DESC, code), 0) AS next FROM scored QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, code) = 1)"""


@query(f"""WITH c AS (SELECT c_custkey AS k, lower(c_mktsegment) || ' ' || translate(substring(c_name, 10, 9), '0123456789', 'abcdefghij') AS name, c_nationkey || '/' || c_mktsegment AS team FROM customer),
r AS (SELECT k AS code, name AS b, NULL::VARCHAR AS c, team FROM c),
l AS (SELECT k + 500000 AS uid, CASE WHEN k % 3 = 0 THEN name || 's' ELSE name END AS a, CASE WHEN k % 5 = 1 THEN 'elsewhere' ELSE team END AS team FROM c),
here AS (SELECT uid, min(code) AS code FROM l JOIN r ON a = b AND l.team = r.team GROUP BY uid), alone AS (SELECT uid, min(code) AS code FROM l JOIN r ON a = b GROUP BY uid HAVING count(DISTINCT code) = 1),
known AS (SELECT l.*, CASE WHEN uid = 500009 THEN uid - 500000 ELSE coalesce(here.code, alone.code) END AS code,
  CASE WHEN uid = 500009 THEN 'override' WHEN here.code IS NOT NULL THEN 'exact' WHEN alone.code IS NOT NULL THEN 'unique_name' END AS method FROM l LEFT JOIN here USING (uid) LEFT JOIN alone USING (uid)),
pairs AS (SELECT uid, a, b, c, r.code FROM known JOIN r USING (team) WHERE method IS NULL), {_SCORES}
SELECT known.uid, coalesce(known.code, f.code)::BIGINT AS code, coalesce(method, CASE WHEN f.code IS NULL THEN 'unmatched' ELSE 'fuzzy' END) AS method
FROM known LEFT JOIN (SELECT * FROM best WHERE score >= 88 AND score - next >= 3) f USING (uid)""")
def j13_entity_resolution(spark, d):
    """The whole ladder: every left row with what it was matched by, or unmatched."""
    left, right = _names(spark, d)
    over = left.where("uid = 500009").select("uid", (F.col("uid") - 500000).alias("code"))
    return resolve.resolve(left, right, over).select("uid", "code", "method")


@query(f"""WITH {_ROLED}, e AS (SELECT uid, bool_or(l.team = r.team) AS here, count(DISTINCT code) AS n FROM l JOIN r ON a = b AND (l.role IS NULL OR l.role = r.role) GROUP BY uid),
rest AS (SELECT l.* FROM l LEFT JOIN e USING (uid) WHERE e.uid IS NULL OR (NOT here AND n > 1)),
pairs AS (SELECT uid, a, b, c, code FROM rest JOIN r USING (team) WHERE rest.role IS NULL OR rest.role = r.role), {_SCORES}
SELECT rest.uid, b.code, CASE WHEN b.code IS NULL THEN 'unmatched' ELSE 'fuzzy' END AS method, round(b.score / 100 - 0.05, 2) AS confidence
FROM rest LEFT JOIN (SELECT * FROM best WHERE score >= 88 AND score - next >= 3) b USING (uid)""")
def j13_fuzzy_matches(spark, d):
    """The fuzzy rung of the ladder, with second names and roles."""
    left, right = _roled(spark, d)
    none = left.where("false").select("uid", F.lit(0).cast("long").alias("code"))
    return resolve.resolve(left, right, none, second="web", role="role").where("method in ('fuzzy', 'unmatched')")


@query(f"""WITH {_ROLED}, pairs AS (SELECT uid, a, b, c, code FROM l JOIN r USING (team) WHERE uid % 2 <> 0 AND code % 2 <> 0 AND (l.role IS NULL OR l.role = r.role)), {_SCORES}
SELECT uid, code, round(score, 6) AS score FROM best WHERE score >= 93 AND score - next >= 3 QUALIFY row_number() OVER (PARTITION BY code ORDER BY score DESC, uid) = 1""")
def j14_foreign_claims(spark, d):
    """Rows that nothing matched before, each candidate going to its best claimant."""
    left, right = _roled(spark, d)
    matched = left.where("uid % 2 = 0").select("uid", (F.col("uid") - 500000).alias("code"))
    return resolve.claim(left, right, matched, "team", second="web", role="role").select("uid", "code", r6("score").alias("score"))


@query("""WITH n AS (SELECT p_name, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY p_name)
SELECT p_name AS name, CASE WHEN n = 1 THEN k END AS code, CASE WHEN n = 1 THEN 'exact' ELSE 'ambiguous' END AS method FROM n""")
def j15_unique_alias(spark, d):
    """Part names against themselves: exact where one part has the name, skipped where several have it."""
    part = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("code"))
    return resolve.alias(part, part)


def j15_fuzzy_alias(spark, d):
    """Misspelt customer names against the list; scores have no SQL, tests hold the rung against brute force."""
    left, right = _names(spark, d)
    return resolve.alias(left.withColumn("name", F.concat("name", F.when(F.col("uid") % 3 == 0, "s").otherwise(""))), right)


query(name="j15_fuzzy_alias")(j15_fuzzy_alias)


@query("""WITH w AS (SELECT o_custkey AS name, sum(o_totalprice) AS minutes FROM orders GROUP BY 1) SELECT name, round(minutes, 2) AS minutes FROM w
  WHERE name % 4 = 0 ORDER BY minutes DESC, name LIMIT 20""")
def a29_top_unmatched(spark, d):
    w = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("name")).agg(F.sum("o_totalprice").alias("minutes"))
    top = resolve.top_unmatched(w.withColumn("hit", F.col("name") % 4 != 0), "minutes", "hit", "name")
    return top.select("name", F.round("minutes", 2).alias("minutes"))


@query("""SELECT year(o_orderdate)::INTEGER AS season, round(sum(o_totalprice), 2) AS weight,
  round(sum(CASE WHEN o_custkey % 4 <> 0 THEN o_totalprice ELSE 0 END) / sum(o_totalprice), 6) AS rate FROM orders GROUP BY 1""")
def a29_match_rate(spark, d):
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("season"), "o_totalprice", (F.col("o_custkey") % 4 != 0).alias("hit"))
    m = resolve.match_rate(o, "season", "o_totalprice", "hit")
    return m.select("season", F.round("weight", 2).alias("weight"), r6("rate").alias("rate"))


@query(r"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages)
  SELECT page_id, count(*) AS links, min(href) AS first_link FROM p GROUP BY page_id""")
def p32_page_rows(spark, d):
    p = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<li><a href="([^"]*)">'), 1)).alias("href"))
    return p.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min("href").alias("first_link"))


@query("""WITH s AS (SELECT c_custkey, c_nationkey FROM customer), a AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders
  WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996 GROUP BY 1)
SELECT c_custkey, coalesce(n, 0) AS n, coalesce(last, max(last) OVER (PARTITION BY c_nationkey)) AS last_match FROM s
  LEFT JOIN a ON o_custkey = c_custkey""")
def j16_enrich_squads(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("name"), F.col("c_nationkey").alias("country"))
    a = table(spark, d, "orders").where(
        (F.col("o_orderpriority") == "1-URGENT") & (F.year("o_orderdate") == 1996)
    ).groupBy(F.col("o_custkey").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("last_match"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("minutes", "matches", "starts", "goals")]
    return wiki.enrich(s, a.select("*", *zero)).select(F.col("name").alias("c_custkey"), F.coalesce("n", F.lit(0)).alias("n"), "last_match")


def _pages(spark, d):
    """Match pages in line markup made of the given tables: a customer is a match block, its orders are the players on the pitch.

    Starters are orders not divisible by 3; of the others those divisible by 2 never came on.  Every fifth
    customer's match has extra time, every second block is of the module form, one in thirteen lacks its date; rows after the
    second manager belong to no team.  A page of a hundredth of all customers has no bound, so it comes in parts, one a block.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("[[P"), k.cast("string"), F.when(k % 5 == 0, " (footballer)]]").otherwise("]]"))
    off = F.when(k % 4 == 1, F.concat(F.lit(" || {{suboff|"), (k % 30 + 60).cast("string"), F.lit("}}"))).otherwise("")
    on = F.when(k % 2 == 1, F.concat(F.lit(" || {{subon|"), (k % 30 + 20).cast("string"), F.lit("}}"))).otherwise("")
    row = F.concat(F.lit("|DF || '''4''' || "), name, F.when(k % 3 == 0, on).otherwise(off))
    goal = F.when(k % 7 == 1, F.concat(F.lit("* "), name, F.lit(" {{goal|12|45+2}}"))).when(
        k % 7 == 2, F.concat(F.lit("* "), name, F.lit(" 50', 82'"))
    ).when(k % 7 == 3, F.concat(F.lit("* "), name, F.lit(" {{goal|30|o.g.}}")))
    listed = lambda x, when: F.array_join(F.array_sort(F.collect_list(F.when(when, x))), "\n")
    per = table(spark, d, "orders").groupBy("o_custkey").agg(listed(row, k % 3 != 0).alias("start"), listed(row, k % 3 == 0).alias("bench"), listed(goal, k > 0).alias("goals"))
    box = F.when(c % 2 == 0, "{{#invoke:football box|main").otherwise("{{football box")
    date = F.when(c % 13 != 0, F.concat(F.lit("| date = {{Start date|2024|"), (c % 12 + 1).cast("string"), F.lit("|"), (c % 28 + 1).cast("string"), F.lit("}}"))).otherwise("| date = unknown")
    kits = F.concat(*[F.concat(F.lit("}}\n{{Football kit\n| pattern = x\n| title = "), (c % m).cast("string"), F.lit("<br>\n")) for m in (25, 7)])
    block = F.concat_ws("\n", box, date, F.concat(F.lit("| goals1 =\n"), F.col("goals")), F.lit("| penalties1 =\n* [[P1]] {{goal|120}}"), F.when(c % 5 == 0, "| aet = y"), kits, F.lit("}}\n{|"), F.col("start"),
                        F.lit("|-\n'''Substitutions:'''"), F.col("bench"), F.lit("'''Manager:'''\n|}\n'''Manager:'''\n|GK || 1 || [[Nobody]]\n"))
    return per.select((c % 100).alias("page"), c.alias("part"), F.concat(F.lit("intro\n"), block).alias("wikitext"))


#: The columns of a part of a page.
_PART = ["page", "part"]


_PAGES_SQL = """p AS (SELECT o_custkey % 100 AS page, 'P' || o_orderkey AS name, o_orderkey AS k, o_custkey AS c, o_orderkey % 3 <> 0 AS started,
  make_date(2024, (o_custkey % 12 + 1)::INTEGER, (o_custkey % 28 + 1)::INTEGER) AS match_date,
  CASE WHEN o_custkey % 5 = 0 THEN 120 ELSE 90 END AS full_time FROM orders),
a AS (SELECT page, name, match_date, started,
  CASE WHEN started THEN CASE WHEN k % 4 = 1 THEN k % 30 + 60 ELSE full_time END ELSE full_time - (k % 30 + 20) END AS minutes,
  CASE WHEN k % 7 IN (1, 2) THEN 2 ELSE 0 END AS goals FROM p WHERE (started OR k % 2 = 1) AND c % 13 <> 0),
a0 AS (SELECT page, c, match_date FROM p WHERE (started OR k % 2 = 1) AND c % 13 <> 0)"""


@query(f"WITH {_PAGES_SQL} SELECT page, name, match_date::VARCHAR AS match_date, started, minutes::INTEGER AS minutes FROM a")
def p33_lineup_pages(spark, d):
    """Appearances parsed from match pages: starters, substitutes by their markers, extra time."""
    return wiki.appearances(_pages(spark, d), _PART).select("page", "name", F.col("match_date").cast("string").alias("match_date"), "started", "minutes")


@query(f"""WITH {_PAGES_SQL}, SELECT name, sum(minutes)::BIGINT AS minutes, count(*) AS matches, count(*) FILTER (started) AS starts, sum(goals)::BIGINT AS goals,
  max(match_date)::VARCHAR AS last_match FROM a GROUP BY name""")
def a28_tournament_totals(spark, d):
    pages = staging.staged(_pages(spark, d), "pages")
    totals = wiki.tournament_totals(wiki.appearances(pages, _PART), wiki.goals(pages, _PART), _PART)
    return totals.select(
        "name", F.col("minutes").cast("long").alias("minutes"), "matches", "starts", F.col("goals").cast("long").alias("goals"),
        F.col("last_match").cast("string").alias("last_match")
    )


@query(f"""WITH {_PAGES_SQL}, b AS (SELECT page, match_date, c, count(*) AS slots FROM a0 GROUP BY ALL),
g AS (SELECT sum(CASE WHEN k % 7 IN (1, 2) THEN 2 ELSE 0 END) AS goals FROM p WHERE c IN (SELECT c FROM b))
SELECT count(*) AS parsed, round(avg(slots), 6) AS slots, round(max(goals) / count(*), 6) AS goals, round(count(*) / (SELECT count(DISTINCT c) FROM p), 6) AS share,
  count(*) >= 0.95 * (SELECT count(DISTINCT c) FROM p) AND avg(slots) BETWEEN 24 AND 42 AND max(goals) / count(*) BETWEEN 1.5 AND 4 AS healthy FROM b, g""")
def a28_parse_health(spark, d):
    """Whether a parse can be trusted: blocks found against those expected, players and goals per block."""
    pages = staging.staged(_pages(spark, d), "pages")
    expected = table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("expected"))
    row = wiki.health(wiki.appearances(pages, _PART), wiki.goals(pages, _PART), F.lit(1.0), _PART).crossJoin(F.broadcast(expected))  # one row each
    share = F.col("parsed") / F.col("expected")
    sound = (share >= wiki.LEAST_PARSED) & F.col("slots").between(*wiki.SLOTS) & F.col("goals").between(*wiki.GOALS)
    return row.select("parsed", r6("slots").alias("slots"), r6("goals").alias("goals"), r6(share).alias("share"), sound.alias("healthy"))


@query(f"""WITH {_PAGES_SQL}, t AS (SELECT (c % m)::VARCHAR AS country, match_date FROM a0, (VALUES (25), (7)) v(m))
SELECT country, max(match_date)::VARCHAR AS last_match FROM t GROUP BY country""")
def j16_country_dates(spark, d):
    """The latest match of each country, from the titles of the kits in its match blocks."""
    pages = staging.staged(_pages(spark, d), "pages")
    return wiki.country_dates(pages, _PART).select("country", F.col("last_match").cast("string").alias("last_match"))


@query("""SELECT n_regionkey AS page, n_name AS country, 'C' || c_custkey AS name FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def p32_squad_pages(spark, d):
    """Squad pages made of the given tables: a region is a page, a nation a heading, its customers the players."""
    member = F.concat(F.lit("{{nat fs g player|no=1|pos=DF|name=[[C"), F.col("c_custkey").cast("string"), F.lit("]]|age=20}}"))
    c = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey").groupBy("n_nationkey").agg(
        F.array_join(F.array_sort(F.collect_list(member)), "\n").alias("players")
    )
    n = table(spark, d, "nation").join(c, "n_nationkey").select("n_regionkey", F.concat(F.lit("=== "), F.col("n_name"), F.lit(" ===\n"), F.col("players")).alias("part"))
    pages = n.groupBy(F.col("n_regionkey").alias("page")).agg(F.concat(F.lit("intro\n"), F.array_join(F.array_sort(F.collect_list("part")), "\n")).alias("wikitext"))
    return wiki.squads(pages).select("page", "country", "name")
