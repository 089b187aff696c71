"""Points, shrinkage, sinks, resolution, pages and streams on small hand-made frames."""

import itertools
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from formline.functions.text import normalised, ratio, sorted_ratio, subsequence, token_score
from formline.operators import clean, evaluate, joins, ranking, resolve, scoring as S, seasons, wiki
from formline.plans import registry
from formline.sources import files, sinks
from formline.streaming import upserts


@pytest.fixture(scope="module")
def rules(spark):
    return S.rules_table(spark, {"a": S.RULES, "b": S.RULES_WITH_DC})


@pytest.mark.parametrize("row,points", [
    ({"position": 1, "minutes": 90, "goals_conceded": 0}, 2), ({"position": 1, "minutes": 90, "goals_conceded": 1}, 2), ({"position": 1, "minutes": 90, "goals_conceded": 3}, 1),
    ({"position": 1, "minutes": 90, "saves": 2}, 2), ({"position": 1, "minutes": 90, "saves": 3}, 3), ({"position": 3, "minutes": 0}, 0), ({"position": 3, "minutes": 1}, 1),
    ({"position": 3, "minutes": 59}, 1), ({"position": 3, "minutes": 60}, 2), ({"position": 4, "minutes": 90, "goals": 2}, 10), ({"position": 2, "minutes": None}, 0),
])
def test_points(spark, rules, row, points):
    df = spark.createDataFrame([{"season": "a", **row}], "season string, position int, minutes int, goals int, goals_conceded int, saves int")
    assert S.price(df, rules).first().priced == points


def test_thresholds_and_overlap(spark, rules):
    rows = [("b", 2, 90, c, 2 + (2 if c >= 10 else 0)) for c in range(20)] + [("b", 3, 90, c, 2 + (2 if c >= 12 else 0)) for c in range(20)]
    df = spark.createDataFrame(rows, "season string, position int, minutes int, defensive_contribution int, total_points int")
    assert {r.position: (r.threshold, r.quiet_to, r.overlap) for r in S.recovered_thresholds(df, rules).collect()} == {2: (10, 9, False), 3: (12, 11, False)}
    assert {r.season: (r.n, r.mismatches) for r in S.audit(df, rules).collect()} == {"b": (40, 0)}


def test_pmf_and_thinning(spark):
    df = spark.createDataFrame([(0.0,), (1.3,), (4.0,)], "lam double")
    for r in df.select(S.count_pmf(F.col("lam")).alias("p"), S.count_pmf(F.col("lam"), alpha=0.3).alias("q"), S.thinned(S.count_pmf(F.col("lam")), F.lit(0.3), 10).alias("t")).collect():
        assert abs(sum(r.p) - 1) < 1e-12 and abs(sum(r.q) - 1) < 1e-12 and abs(sum(r.t) - 1) < 1e-9
    two = spark.createDataFrame([([0.0, 0.0, 1.0],)], "p array<double>")
    assert abs(two.select(S.expected_steps(S.thinned(F.col("p"), F.lit(0.3), 2), 2, 2).alias("x")).first().x - 0.09) < 1e-12
    assert abs(two.select(S.expected_steps(F.col("p"), 2, 2, 0.3).alias("x")).first().x - 0.09) < 1e-12
    for alpha in (None, 0.3):
        listed = df.select(S.expected_steps(S.count_pmf(F.col("lam"), 20, alpha), 3, 20).alias("x"), S.expected_count_steps(F.col("lam"), 3, 20, alpha).alias("y"))
        assert all(abs(r.x - r.y) < 1e-12 for r in listed.collect())


def test_doubles_add_before_quantiles(spark):
    rows = [(1, 1, d, float(v)) for d in range(50) for v in (d % 5, d % 3)]
    r = S.sample_summary(spark.createDataFrame(rows, "k int, gw int, draw int, x double"), ["k", "gw"], "draw", "x").first()
    sums = sorted(d % 5 + d % 3 for d in range(50))
    assert abs(r.mean - sum(sums) / 50) < 1e-12 and r.p10 <= r.p50 <= r.p90 and r.p_haul <= r.p_return


def test_blend(spark):
    df = spark.createDataFrame([(None, 2.0, 0), (4.0, None, 3), (4.0, 2.0, 0), (4.0, 2.0, 30)], "c double, p double, n int")
    b, w = seasons.blend(F.col("c"), F.col("p"), F.col("n"), 10)
    out = df.select(b.alias("b"), w.alias("w")).collect()
    assert [r.b for r in out[:3]] == [2.0, 4.0, 2.0] and out[2].w == 0 and abs(out[3].b - 3.5) < 1e-12


def test_upsert(spark, tmp_path):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "id int, s string, x double")
    rows = spark.createDataFrame([(2, None), (3, 9.0)], "id int, x double")
    once = sinks.upsert(target, rows, ["id"])
    want = {(1, "a", 1.0), (2, "b", None), (3, None, 9.0)}
    assert {tuple(r) for r in once.collect()} == want
    assert {tuple(r) for r in sinks.upsert(once, rows, ["id"]).collect()} == want
    keys = sinks.upsert(target, spark.createDataFrame([(1,), (7,)], "id int"), ["id"])
    assert {tuple(r) for r in keys.collect()} == {(1, "a", 1.0), (2, "b", 2.0), (7, None, None)}
    assert sinks.upsert(target, rows.limit(0), ["id"]).count() == 2


def test_upsert_stream(spark, tmp_path):
    path, source = str(tmp_path / "table"), str(tmp_path / "in")
    spark.createDataFrame([(1, 1, 1.0, 0), (2, 2, 2.0, 0)], "season int, id int, x double, seq int").write.partitionBy("season").parquet(path)
    spark.createDataFrame([(1, 1, 5.0, 1), (1, 1, 6.0, 2), (1, 4, 4.0, 1)], "season int, id int, x double, seq int").write.parquet(source)
    stream = spark.readStream.schema("season int, id int, x double, seq int").parquet(source)
    upserts.upsert_stream(stream, path, ["season", "id"], ["season"], ["seq"], str(tmp_path / "c")).awaitTermination(120)
    assert {(r.season, r.id, r.x) for r in spark.read.parquet(path).collect()} == {(1, 1, 6.0), (1, 4, 4.0), (2, 2, 2.0)}


def test_season_csvs(spark, tmp_path):
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    (tmp_path / "a.csv").write_text("id,xG\n1,0.5\n2,n/a\n")
    (tmp_path / "b.csv").write_text("id,other\n3,z\n")
    schema = StructType([StructField("id", IntegerType()), StructField("xg", DoubleType())])
    df = files.season_csvs(spark, {"s1": str(tmp_path / "a.csv"), "s2": str(tmp_path / "b.csv")}, schema, {"xG": "xg"})
    assert {(r.id, r.xg, r.season) for r in df.collect()} == {(1, 0.5, "s1"), (2, None, "s1"), (3, None, "s2")}


def test_one_scan_for_each_header(spark, tmp_path):
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    headers = ["id,xG", "id,other", "other,id,xG"]
    paths, want = {}, set()
    for season in range(10):
        folder = tmp_path / f"season {season}"
        folder.mkdir()
        for i in range(100):
            h, n = headers[(season + i) % 3], season * 100 + i
            row = {"id": str(n), "xG": f"{n}.5", "other": "z"}
            (folder / f"part-{i}.csv").write_text(h + "\n" + ",".join(row[c] for c in h.split(",")) + "\n")
            want.add((n, n + 0.5 if "xG" in h else None, str(season)))
        (folder / "empty.csv").write_text("")
        paths[str(season)] = str(folder)
    schema = StructType([StructField("id", IntegerType()), StructField("xg", DoubleType())])
    df = files.season_csvs(spark, paths, schema, {"xG": "xg"})
    assert {(r.id, r.xg, r.season) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum(line.rstrip().endswith(" csv") for line in plan.splitlines() if "Relation [" in line) == 3
    assert files.season_csvs(spark, {"a": str(tmp_path / "season 0" / "empty.csv")}, schema).count() == 0


def test_rows_of_one_key_must_agree(spark):
    target = spark.createDataFrame([(1, 1.0)], "id int, x double")
    with pytest.raises(Exception, match="no order says"):
        sinks.upsert(target, spark.createDataFrame([(1, 2.0), (1, 3.0)], "id int, x double"), ["id"]).collect()
    same = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, None), (2, None)], "id int, x double")
    assert {tuple(r) for r in sinks.upsert(target, same, ["id"]).collect()} == {(1, 2.0), (2, None)}
    with pytest.raises(Exception, match="no order says"):
        sinks.update(target, spark.createDataFrame([(1, 2.0), (1, 3.0)], "id int, x double"), ["id"], ["x"]).collect()


def test_keys_that_change_partition(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a table")
    first = [(i, i % 3, float(i), "kept") for i in range(30)]
    spark.createDataFrame(first, "id int, p int, x double, note string").write.partitionBy("p").parquet(path)
    rows = spark.createDataFrame([(0, 7, -1.0), (3, 1, -2.0), (4, 1, -3.0), (99, 5, -4.0)], "id int, p int, x double")
    want = {i: (p, x, n) for i, p, x, n in first} | {0: (7, -1.0, "kept"), 3: (1, -2.0, "kept"), 4: (1, -3.0, "kept"), 99: (5, -4.0, None)}

    def now():
        got = spark.read.parquet(path).collect()
        assert len(got) == len({r.id for r in got})
        return {r.id: (r.p, r.x, r.note) for r in got}

    class Stopped(Exception):
        pass

    real = sinks.write_partitioned
    for stop_at in (f"{path}", f"{path}_index"):  # after staging, before the table; after the table, before the index
        def stopping(df, to, by, stop_at=stop_at):
            if to == stop_at:
                raise Stopped
            real(df, to, by)

        sinks.build_index(spark, path, ["id"], ["p"])
        monkeypatch.setattr(sinks, "write_partitioned", stopping)
        with pytest.raises(Stopped):
            sinks.upsert_table(spark, path, rows, ["id"], ["p"])
        monkeypatch.setattr(sinks, "write_partitioned", real)
    for _ in range(2):
        sinks.upsert_table(spark, path, rows, ["id"], ["p"])
        assert now() == want
    twos = spark.createDataFrame([(i, 9) for i in range(30) if i % 3 == 2], "id int, p int")  # a partition that empties
    sinks.upsert_table(spark, path, twos, ["id"], ["p"])
    assert now() == {i: (9, *v[1:]) if v[0] == 2 else v for i, v in want.items()} and not (tmp_path / "a table" / "p=2").exists()
    sinks.upsert_table(spark, path, spark.createDataFrame([(5, 100.0)], "id int, x double"), ["id"], ["p"])  # no partition named: the key stays where it is
    assert now()[5] == (9, 100.0, "kept")


def test_clean_names_and_scores(spark):
    names = spark.createDataFrame([("Jos&eacute; Ñu-ñez.O'Neil ",), (None,), ("",)], "n string")
    assert [r.x for r in names.select(normalised(F.col("n")).alias("x")).collect()] == ["jose nu nez oneil", None, ""]
    assert subsequence("kitten", "sitting") == 4 and ratio("", "") == 100.0 and token_score("john smith", "smith john") == 100.0
    assert token_score("alisson", "alisson becker") == 98.0
    assert token_score("a b", "c d") < 88


def test_ladder(spark):
    right = spark.createDataFrame([(1, "harry kane", "T"), (2, "john smith", "T"), (3, "john smith", "U"), (4, "emi martinez", "V"), (5, "emi martinex", "V")], "code int, name string, team string")
    left = spark.createDataFrame([(10, "john smith", "T"), (11, "harry kane", "Z"), (12, "harry kan", "T"), (13, "emi martine", "V"), (14, "nobody", "T"), (15, "x", "T")], "uid int, name string, team string")
    over = spark.createDataFrame([(15, 2)], "uid int, code int")
    out = {r.uid: (r.code, r.method) for r in resolve.resolve(left, right, over).collect()}
    assert out == {10: (2, "exact"), 11: (1, "unique_name"), 12: (1, "fuzzy"), 13: (None, "unmatched"), 14: (None, "unmatched"), 15: (2, "override")}


def test_entity_resolution_returns_the_whole_ladder(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the given tables")
    out = registry.QUERIES["j13_entity_resolution"](spark, data).collect()
    assert len({r.uid for r in out}) == len(out) == spark.read.parquet(f"{data}/customer.parquet").count()
    assert {r.method for r in out} == {"override", "exact", "unique_name", "fuzzy", "unmatched"}
    assert all(r.code == r.uid - 500000 for r in out if r.method != "unmatched")


PAGE = """===Northland===
{{nat fs player|no=1|pos=GK|name=[[Al One]]}}
{{nat fs g player|no=2|pos=DF|name=[[Bo Two (footballer)|Bo Two]]}}
{{nat fs g player|no=3|pos=DF|name=[[Fay Six (defender)]]|age=20}}
==={{flag|x}} [[Southland]]===
{{nat fs player|no=1|pos=GK|name=Cy Three}}
{{football box
|date = {{Start date|2026|7|4}}
|goals1= [[Al One]] {{goal|3}}
* [[Al One]] {{goal|12||55|pen.}}
* [[Bo Two]] {{goal|80|o.g.}}
* [[Di Four]] 50', 82+1'
* [[Og Nine]] {{goal|7}}
|goals2=* [[Ed Five]] 33' (o.g.)
|penalties1=
* [[Cy Three]] {{goal|91}}
}}
{{Football kit
| title = Northland<br>x
}}
{{Football kit | title = [[x]] | y}}
{|
|GK || 1 || [[Al One]] || {{suboff|78}}
|DF || '''2''' || [[Bo Two (footballer)|Bo Two]]
|DF || 3 || [[Fay Six (defender)]] || {{yel|40}}
|-
| '''Substitutions:'''
|MF || 9 || [[Di Four]] || {{subon|63}} || {{suboff|85}}
|FW || 8 || [[Ed Five]]
| '''Manager:'''
|}
{|
|GK || 1 || [[Gil Seven]]
| '''Manager:'''
|}
|GK || 1 || [[Not Playing]]
{{#invoke: football box|main
|goals1=
* [[Al One]] {{goal|1}}
}}
|GK || 1 || [[No Date]]
{{#invoke:Football box|main
|date={{Start date|2026|7|9}}
|aet= Yes
}}
|GK || 1 || [[Al One]]
"""


def test_pages(spark):
    df = spark.createDataFrame([("p", PAGE), ("empty", None)], "page string, wikitext string")
    assert {(r.country, r.name) for r in wiki.squads(df).collect()} == {("Northland", "Al One"), ("Northland", "Bo Two"), ("Northland", "Fay Six"), ("Southland", "Cy Three")}
    seen = wiki.appearances(df)
    assert {(r.name, r.started, r.minutes, str(r.match_date)) for r in seen.collect()} == {
        ("Al One", True, 78, "2026-07-04"), ("Bo Two", True, 90, "2026-07-04"), ("Fay Six", True, 90, "2026-07-04"), ("Di Four", False, 22, "2026-07-04"),
        ("Gil Seven", True, 90, "2026-07-04"), ("Al One", True, 120, "2026-07-09"),
    }
    scored = wiki.goals(df)
    assert {(r.name, r.goals) for r in scored.collect()} == {("Al One", 2), ("Di Four", 2), ("Og Nine", 1)}
    totals = wiki.tournament_totals(seen, scored)
    assert {r.name: (r.minutes, r.matches, r.starts, r.goals, str(r.last_match)) for r in totals.collect()}["Al One"] == (198, 2, 2, 2, "2026-07-09")
    dates = wiki.country_dates(df)
    assert {(r.country, str(r.last_match)) for r in dates.collect()} == {("Northland", "2026-07-04"), ("[[x]]", "2026-07-04")}
    row = wiki.health(seen, scored, F.lit(2)).first()
    assert (row.parsed, row.slots, row.goals, row.share, row.healthy) == (2, 3.0, 2.5, 1.0, False)
    rich = {r.name: (r.minutes, str(r.last_match)) for r in wiki.enrich(wiki.squads(df).drop("page", "line_no"), totals, dates=dates).collect()}
    assert rich == {"Al One": (198, "2026-07-09"), "Bo Two": (90, "2026-07-04"), "Fay Six": (90, "2026-07-04"), "Cy Three": (0, "None")}


def test_pages_in_parts(spark):
    cut = [PAGE[a:b] for a, b in itertools.pairwise([0, *[m.start() for m in re.finditer(r"(?m)^\{\{(#invoke:|[Ff]ootball box)", PAGE)], len(PAGE)])]
    assert len(cut) > 3
    whole = spark.createDataFrame([("p", 0, PAGE)], "page string, part int, wikitext string")
    parts = spark.createDataFrame([("p", i, x) for i, x in enumerate(cut)], "page string, part int, wikitext string")
    both = ["page", "part"]
    for made in (lambda df: wiki.appearances(df, both).drop("part", "block"), lambda df: wiki.goals(df, both).drop("part", "block"), lambda df: wiki.country_dates(df, both),
                 lambda df: wiki.health(wiki.appearances(df, both), wiki.goals(df, both), F.lit(2), both)):
        assert sorted(map(str, made(parts).collect())) == sorted(map(str, made(whole).collect())) != []


def test_ranking(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 10.0, 50), (2, 0, 9.0, 30.0, 60), (3, 0, 8.0, 8.0, 5), (4, 0, 7.0, 7.0, 90)], "id int, g int, total double, peak double, cost int")
    assert {r.id for r in ranking.prune(df, "g", "total", "peak", "cost", "id", (1, 1, 1)).collect()} == {1, 2, 3}
    weeks = spark.createDataFrame([(1, 1, "a", True), (1, 1, "b", False), (1, 2, "a", False), (1, 2, "c", True)], "o int, w int, m string, s boolean")
    assert {(r.w, r.m, r.change) for r in ranking.changes(weeks, "o", "w", "m", "s").collect()} == {(2, "a", "demoted"), (2, "b", "out"), (2, "c", "in")}


def test_constant_rounds_are_left_out(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 2.0), (2, 1.0, 3.0), (2, 2.0, 4.0)], "r int, p double, a double").withColumn("k", F.lit(0))
    r = evaluate.spearman(df, ["k"], "r", "p", "a").first()
    assert r.rounds == 1 and math.isclose(r.spearman, 1.0)


def test_season_strings(spark):
    r = spark.createDataFrame([("2026-08-14T17:30:00Z",), ("bad",)], "d string").select(clean.season_name(F.col("d")).alias("n")).select("n", clean.season_code(F.col("n")).alias("c")).collect()
    assert (r[0].n, r[0].c) == ("2026-27", "2627") and r[1].n is None


def _people(seed=3):
    import random

    rng = random.Random(seed)
    parts = ["anna", "berto", "carla", "dimitri", "elena", "fabian", "gomez", "hartmann", "ivanov", "jansen"]
    right = []
    for i in range(60):
        full = " ".join(rng.sample(parts, rng.choice([1, 2, 2, 3])))
        right.append((i, full, full.split()[-1] if rng.random() < 0.5 else None, rng.choice("xyz"), rng.choice(["gk", "field"])))

    def spoil(name):
        if rng.random() < 0.5:
            return name
        i = rng.randrange(len(name))
        return (name[:i] + rng.choice("abe ") + name[i + rng.choice([0, 1]):]).strip() or name

    left = [(1000 + i, spoil(rng.choice(right)[1]), rng.choice("xyz"), rng.choice(["gk", "field", None])) for i in range(80)]
    return left, right


def _score(a, names, score=token_score):
    return max(score(a, n) for n in names if n is not None)


def test_resolve_and_claim_equal_all_pairs(spark):
    left, right = _people()
    lf = spark.createDataFrame(left, "uid long, name string, team string, role string")
    rf = spark.createDataFrame(right, "code long, name string, web string, team string, role string")
    over = spark.createDataFrame([(1003, 59)], "uid long, code long")
    sane = lambda r, role: role is None or r[4] == role

    def best(cands, name, least):
        scored = sorted(((_score(name, (r[1], r[2])), -r[0]) for r in cands), reverse=True)
        ok = scored and scored[0][0] >= least and (len(scored) < 2 or scored[0][0] - scored[1][0] >= 3)
        return (-scored[0][1], scored[0][0]) if ok else None

    want = {}
    for uid, name, team, role in left:
        same = [r for r in right if r[1] == name and sane(r, role)]
        here = [r[0] for r in same if r[3] == team]
        if uid == 1003:
            want[uid] = (59, "override", 1.0)
        elif here:
            want[uid] = (min(here), "exact", 1.0)
        elif len(same) == 1:
            want[uid] = (same[0][0], "unique_name", 0.95)
        else:
            found = best([r for r in right if r[3] == team and sane(r, role)], name, 88)
            want[uid] = (found[0], "fuzzy", round(found[1] / 100 - 0.05, 2)) if found else (None, "unmatched", None)
    got = resolve.resolve(lf, rf, over, second="web", role="role").collect()
    assert {r.uid: (r.code, r.method) for r in got} == {k: v[:2] for k, v in want.items()} and len(got) == len(left)
    assert all(r.confidence == want[r.uid][2] or abs(r.confidence - want[r.uid][2]) < 0.011 for r in got)
    assert {"fuzzy", "unmatched", "exact", "unique_name", "override"} == {v[1] for v in want.values()}

    known = spark.createDataFrame([(1000 + i, i) for i in range(10)], "uid long, code long")
    claims = {}
    for uid, name, team, role in left:
        found = best([r for r in right if r[3] == team and r[0] >= 10 and sane(r, role)], name, 93) if uid >= 1010 else None
        if found:
            claims.setdefault(found[0], []).append((-found[1], uid))
    assert {(r.uid, r.code) for r in resolve.claim(lf, rf, known, "team", second="web", role="role").collect()} == {(min(v)[1], k) for k, v in claims.items()}


def test_copies_of_a_name_meet_once(spark):
    n = 3000  # copies of either side: as rows 9,000,000 pairs for one pair of names
    near, far = spark.range(n).selectExpr("id AS code", "'harry kane' AS name", "'T' AS team"), spark.createDataFrame([(n, "john smith", "T")], "code long, name string, team string")
    left = spark.range(n).selectExpr("id AS uid", "CASE WHEN id % 2 = 0 THEN 'harry kan' ELSE 'john smit' END AS name", "'T' AS team")
    found = resolve._candidates(near.unionByName(far), "name", "code", ["team"], None, None)
    sure = resolve._sure(left, found, ["team", "name"], "team", "name", 88.0, 3.0, None).collect()
    assert [(r.name, r["_code"]) for r in sure] == [("john smit", n)]  # one row a name; equal candidates are no sure match
    none = left.where("false").select("uid", F.lit(0).cast("long").alias("code"))
    out = resolve.resolve(left, near.unionByName(far), none)
    assert {(r.method, r.code, r["count"]) for r in out.groupBy("method", "code").count().collect()} == {("fuzzy", n, n // 2), ("unmatched", None, n // 2)}
    assert [(r.uid, r.code) for r in resolve.claim(left, near.unionByName(far), none, "team").collect()] == [(1, n)]


def test_alias_equals_all_pairs(spark):
    left, right = _people(9)
    right = [*right, (90, "anna anna berto", None, "x", "gk")]
    want = {}
    for name in {r[1] for r in left}:
        same = [r[0] for r in right if r[1] == name]
        if same:
            want[name] = (same[0], "exact") if len(same) == 1 else (None, "ambiguous")
        else:
            found = sorted((-_score(name, (r[1], r[2]), sorted_ratio), r[0]) for r in right)[0]
            want[name] = (found[1], "fuzzy") if -found[0] >= 93 else (None, "unmatched")
    lf = spark.createDataFrame([(r[1],) for r in left], "name string")
    rf = spark.createDataFrame([r[:3] for r in right], "code long, name string, web string")
    assert {r.name: (r.code, r.method) for r in resolve.alias(lf, rf, second="web").collect()} == want
    assert {"exact", "fuzzy", "unmatched"} <= {v[1] for v in want.values()}


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_stubs_of_few_teams_take_many_tasks(spark, monkeypatch, most):
    """One team holds nearly all members: its pairs are complete and no task makes most of them."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
    monkeypatch.setattr(joins, "TASK_PAIRS", 1000)
    members = [(i, "a" if i % 20 else "b") for i in range(1000)] + [(1000, None), (1001, "none"), (7, "a")]
    coming = [(i, "a" if i % 10 else "b") for i in range(50)] + [(50, None), (51, "nobody")]
    out = joins.stubs(spark.createDataFrame(members, "member long, team string"), spark.createDataFrame(coming, "fixture long, team string"), "team")
    got = sorted((r.member, r.team, r.fixture) for r in out.collect())
    assert got == sorted((m, t, f) for m, t in members for f, u in coming if t is not None and t == u)
    assert all(r.is_inference for r in out.select("is_inference").distinct().collect())
    by_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(by_task) > 20 and max(by_task) < len(got) / 4
