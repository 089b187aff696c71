"""Window operators against pandas, with nulls, ties and single rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from formline.operators import asof, windows as W


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 4, 60), "t": np.arange(60), "x": np.where(rng.random(60) < 0.25, np.nan, rng.normal(size=60)), "m": rng.integers(0, 91, 60).astype(float)})
    pdf.loc[60] = [9, 60, 1.5, 90.0]  # an entity of one row
    df = spark.createDataFrame(pdf).withColumns({"k": F.col("k").cast("int"), "t": F.col("t").cast("int"), "x": F.when(~F.isnan("x"), F.col("x"))})
    return pdf, df


def got(df, column):
    return df.select("t", column.alias("v")).toPandas().sort_values("t").v.astype(float).to_numpy()


def by_key(pdf, fn):
    return pdf.groupby("k", group_keys=False)["x"].apply(fn).sort_index().to_numpy()


@pytest.mark.parametrize("w,least", [(3, 1), (5, 2), (10, 3)])
def test_rolling(frame, w, least):
    pdf, df = frame
    np.testing.assert_allclose(got(df, W.rolling(F.col("x"), ["k"], ["t"], w, min_obs=least)), by_key(pdf, lambda s: s.shift(1).rolling(w, min_periods=least).mean()))
    np.testing.assert_allclose(got(df, W.rolling(F.col("x"), ["k"], ["t"], w, min_obs=least, lagged=False)), by_key(pdf, lambda s: s.rolling(w, min_periods=least).mean()))


@pytest.mark.parametrize("half_life", [3, 8])
def test_ewma(frame, half_life):
    pdf, df = frame
    want = by_key(pdf, lambda s: s.shift(1).ewm(halflife=half_life, min_periods=1).mean())
    have = W.with_lagged_ewma(df, F.col("x"), ["k"], ["t"], {"v": half_life}).toPandas().sort_values("t").v.to_numpy()
    np.testing.assert_allclose(have, want)


def test_ewma_of_long_series(spark):
    """Over many segments, with a stretch of nulls longer than any weight reaches."""
    x = np.random.default_rng(1).standard_normal(3000)
    x[np.random.default_rng(2).random(3000) < 0.3] = np.nan
    x[700:1900] = np.nan
    rows = [(i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "t long, x double").withColumn("k", F.lit(1))
    have = W.with_lagged_ewma(df, F.col("x"), ["k"], ["t"], {"a": 3, "b": 1.5}).toPandas().sort_values("t")
    for name, half_life in (("a", 3), ("b", 1.5)):
        s = w = 0.0
        want = []
        for v in x:
            want.append(s / w if w > 0 else np.nan)
            s, w = s * 2 ** (-1 / half_life), w * 2 ** (-1 / half_life)
            if w and w < 1e-250:  # rescale: only the ratio counts
                s, w = s * 1e200, w * 1e200
            if not np.isnan(v):
                s, w = s + v, w + 1
        np.testing.assert_allclose(have[name].to_numpy()[:1901], np.array(want)[:1901], rtol=1e-9)
        np.testing.assert_allclose(have[name].to_numpy()[2100:], pd.Series(x).shift(1).ewm(halflife=half_life, min_periods=1).mean().to_numpy()[2100:], rtol=1e-9)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_rank_share_and_quantile_edges(spark, parts):
    x = np.random.default_rng(3).integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(900, None)], "t long, x double").repartition(5)
    have = W.rank_share(df, "x", parts=parts).toPandas().sort_values("t")
    np.testing.assert_allclose(have.share.to_numpy()[:500], pd.Series(x).rank(pct=True).to_numpy())
    assert np.isnan(have.share.to_numpy()[500])
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    np.testing.assert_allclose(W.quantile_edges(df, "x", probs, parts).first().edges, np.unique(np.quantile(x, probs)))
    assert W.rank_share(df.limit(0), "x").count() == 0 and W.quantile_edges(df.limit(0), "x", probs).first().edges in ([], None)


def test_season_to_date(frame):
    pdf, df = frame
    want = by_key(pdf, lambda s: s.shift(1).cumsum() / np.arange(len(s)).clip(1))
    np.testing.assert_allclose(got(df, W.season_to_date(F.col("x"), ["k"], ["t"])), want)


def test_average_rank(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 7.0), (4, 1.0)], "t int, x double").withColumn("k", F.lit(0))
    have = df.select("t", (W.average_rank("x", ["k"]) / 4).alias("v")).toPandas().sort_values("t").v.to_numpy()
    np.testing.assert_allclose(have, pd.Series([5.0, 5.0, 7.0, 1.0]).rank(pct=True).to_numpy())


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("bucket", [None, 50])
def test_asof(spark, exact, bucket):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"id": range(80), "k": rng.integers(0, 3, 80), "t": rng.integers(0, 200, 80)}).sort_values("t")
    right = pd.DataFrame({"k": rng.integers(0, 3, 40), "t": rng.permutation(200)[:40]}).sort_values("t")
    right["v"] = np.where(rng.random(40) < 0.3, np.nan, rng.normal(size=40))
    want = pd.merge_asof(left, right, on="t", by="k", allow_exact_matches=exact).sort_values("id").v.to_numpy()
    stamp = lambda c: F.timestamp_seconds(F.col(c))
    l = spark.createDataFrame(left).withColumn("t", stamp("t"))
    r = spark.createDataFrame(right).withColumn("rt", stamp("t")).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).drop("t")
    have = asof.asof_join(l, r, ["k"], "t", "rt", ["v"], exact=exact, bucket_seconds=bucket).toPandas().sort_values("id").v.astype(float).to_numpy()
    np.testing.assert_allclose(have, want)


def test_asof_null_keys_and_times_match_nothing(spark):
    l = spark.createDataFrame([(1, None, 5), (2, 1, None), (3, 1, 5)], "id int, k int, t int").withColumn("t", F.timestamp_seconds("t"))
    r = spark.createDataFrame([(None, 1, 1.0), (1, 1, 2.0)], "k int, t int, v double").withColumn("rt", F.timestamp_seconds("t")).drop("t")
    assert {x.id: x.v for x in asof.asof_join(l, r, ["k"], "t", "rt", ["v"]).collect()} == {1: None, 2: None, 3: 2.0}


def test_order_of_partitions_does_not_matter(frame):
    _, df = frame
    column = W.rolling(F.col("x"), ["k"], ["t"], 5)
    np.testing.assert_allclose(got(df, column), got(df.repartition(7, "m"), column))
