"""Windows over cut keys: the same answers as plain windows, and no task with a whole hot key."""

import math
import random

import pytest
from pyspark.sql import functions as F

from formline.operators import spread as S
from formline.operators import windows as W

K, O = ["k"], ["ts", "id"]
CUTS = {"run_rows": 40, "bucket_seconds": 60}


@pytest.fixture(scope="module")
def rows(spark):
    """Half of the rows have one key, some the null key; times tie, are null, and leave gaps."""
    rng = random.Random(7)
    out = []
    for i in range(1200):
        k = 0 if rng.random() < 0.5 else None if rng.random() < 0.2 else rng.randrange(1, 30)
        t = None if rng.random() < 0.02 else rng.choice([rng.randrange(3000), rng.randrange(3000) + 50_000, rng.randrange(10) * 200])
        out.append((i, k, t, None if rng.random() < 0.3 else rng.uniform(-5, 5), rng.randrange(91)))
    df = spark.createDataFrame(out, "id long, k int, t long, x double, m int").select("id", "k", F.timestamp_seconds("t").alias("ts"), "x", "m")
    df.cache()
    return df


def same(a, b, columns):
    left = {r.id: tuple(r[c] for c in columns) for r in a.collect()}
    right = {r.id: tuple(r[c] for c in columns) for r in b.collect()}
    assert left.keys() == right.keys() and len(left) > 0
    for i, want in right.items():
        for x, y in zip(left[i], want, strict=True):
            assert (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)), (i, left[i], want)


@pytest.mark.parametrize("run_rows", [3, 40, 10_000])
def test_bounded(rows, run_rows):
    x, m = F.col("x"), F.col("m")

    def build(k, o):
        return {
            "a": W.rolling(x, k, o, 3), "b": W.rolling(x, k, o, 10, "sum", 2), "c": W.rolling(x, k, o, 6, min_obs=3, lagged=False), "d": W.rolling_rate(x, m, k, o, 5),
            "e": W.changed(F.col("m") % 3, k, o), "f": W.lagged_flag(m >= 60, k, o), "g": W.rest_days(F.col("ts"), k, o),
        }

    got = S.bounded(rows, K, O, 10, build, run_rows, 60)
    same(got, rows.withColumns(build(K, O)), "abcdefg")
    assert got.columns == [*rows.columns, *"abcdefg"]


@pytest.mark.parametrize("run_rows", [3, 40, 10_000])
def test_cumulative(rows, run_rows):
    cuts = {"run_rows": run_rows, "bucket_seconds": 60}
    x, m = F.col("x"), F.col("m")
    same(S.season_to_date(rows, x, K, O, "v", **cuts), rows.withColumn("v", W.season_to_date(x, K, O)), ["v"])
    rate, seen = W.rate_to_date(x, m, K, O)
    same(S.rate_to_date(rows, x, m, K, O, "v", "n", **cuts), rows.withColumns({"v": rate, "n": seen}), ["v", "n"])
    same(S.total_to_date(rows, m, K, O, "v", **cuts), rows.withColumn("v", W.total_to_date(m, K, O)), ["v"])
    mean, n = W.expanding(x, K, O)
    same(S.expanding(rows, x, K, O, "v", "n", **cuts), rows.withColumns({"v": mean, "n": n}), ["v", "n"])
    same(S.recency(rows, K, O, "v", **cuts), rows.withColumn("v", W.recency(K, O)), ["v"])


def test_ewma(rows):
    want = W.with_lagged_ewma(rows, F.col("x"), K, O, {"a": 3, "b": 0.25})
    same(S.lagged_ewma(rows, F.col("x"), K, O, {"a": 3, "b": 0.25}, **CUTS), want, ["a", "b"])


def largest(df, path):
    """Rows of the largest task: each writes a file."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]


def test_hot_key_is_spread(spark, tmp_path):
    """Half of 60,000 rows have one key: no task sees more than a few runs of it."""
    kept = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 997 + 1).alias("k"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.rand(1).alias("x"))
        cuts = {"run_rows": 1000, "bucket_seconds": 600}
        build = lambda k, o: {"v": W.rolling(F.col("x"), k, o, 5)}
        assert largest(df.withColumns(build(K, O)), str(tmp_path / "plain")) >= 30_000
        assert largest(S.bounded(df, K, O, 5, build, **cuts), str(tmp_path / "bounded")) < 8_000
        assert largest(S.season_to_date(df, F.col("x"), K, O, "v", **cuts), str(tmp_path / "running")) < 8_000
        assert largest(S.lagged_ewma(df, F.col("x"), K, O, {"v": 3}, **cuts), str(tmp_path / "ewma")) < 8_000
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)


def test_tables_by_shuffle_and_nothing(rows, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    build = lambda k, o: {"v": W.rolling(F.col("x"), k, o, 4)}
    same(S.bounded(rows, K, O, 4, build, **CUTS), rows.withColumns(build(K, O)), ["v"])
    same(S.season_to_date(rows, F.col("x"), K, O, "v", **CUTS), rows.withColumn("v", W.season_to_date(F.col("x"), K, O)), ["v"])
    assert S.bounded(rows.limit(0), K, O, 4, build).count() == 0 and S.recency(rows.limit(0), K, O, "v").count() == 0


def test_counts_of_another_table(spark):
    from formline.operators import intervals

    rng = random.Random(11)
    day = 86_400
    left = [(i, rng.choice([0, 0, 0, 1, 2, 9, None]), None if rng.random() < 0.05 else rng.randrange(100) * day // 2 + rng.choice([0, 0, 7])) for i in range(400)]
    right = [(rng.choice([0, 0, 0, 1, 2, None]), None if rng.random() < 0.05 else rng.randrange(100) * day // 2) for _ in range(500)]
    lf = spark.createDataFrame(left, "id long, k int, t long").select("id", "k", F.timestamp_seconds("t").alias("ts"))
    rf = spark.createDataFrame(right, "k int, t long").select("k", F.timestamp_seconds("t").alias("at"))
    for bucket in (day, 30 * day):
        got = {r.id: (r.n14, r.n30, r.since) for r in intervals.trailing_counts(lf, rf, ["k"], ["id"], "ts", "at", {"n14": 14, "n30": 30}, "since", 20, bucket).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            dates = [x for j, x in right if j == k and x is not None] if k is not None else []
            if t is None or not dates:
                assert got[i] == (None, None, None)
                continue
            n14, n30 = (sum(t - d * day <= x < t for x in dates) for d in (14, 30))
            before = [x for x in dates if x < t]
            assert got[i][:2] == (n14, n30)
            assert (got[i][2] is None) == (not before) and (not before or math.isclose(got[i][2], min((t - max(before)) / day, 20)))
