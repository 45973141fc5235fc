"""Hot keys and partition counts must not change results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.operators import aggregates as A
from leafmill.operators import ranking as R
from leafmill.operators.accounting import running_balance
from leafmill.operators.evaluation import train_val_split
from leafmill.operators.running import percentiles, previous


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    pdf = pd.DataFrame(
        {"id": np.arange(n), "k": key, "v": np.round(rng.exponential(20, n), 1), "s": rng.integers(0, 5000, n), "d": rng.choice([-1, 1], n)}
    )
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    return pdf, df


@pytest.mark.parametrize("parts", [1, 7])
def test_percentiles(frame, parts):
    pdf, df = frame
    got = percentiles(df.repartition(parts), ["k"], "v", {"p50": 0.5, "p95": 0.95}).toPandas().set_index("k")
    for k, g in pdf.groupby("k")["v"]:
        if len(g) > 1:
            assert got.loc[k, "p50"] == pytest.approx(np.percentile(g, 50))
            assert got.loc[k, "p95"] == pytest.approx(np.percentile(g, 95))
    near = percentiles(df, [], "v", {"p": 0.95}, "nearest").first()["p"]
    v = sorted(pdf["v"])
    assert near == v[min(int(len(v) * 95 / 100), len(v) - 1)]


def test_percentile_needs_two(spark):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (2, 5.0), (2, None)], "k int, v double")
    assert {r["p"] for r in percentiles(df, ["k"], "v", {"p": 0.5}).collect()} == {None}


def test_rank_rows(frame):
    pdf, df = frame
    got = R.rank_list(df.select("k", "id", "v"), ["k"], "v", "id").toPandas().sort_values("id")["rank"].to_numpy()
    order = pdf.sort_values(["k", "v", "id"], ascending=[True, False, True])
    want = order.assign(r=order.groupby("k").cumcount() + 1).sort_values("id")["r"].to_numpy()
    assert (got == want).all()


def test_rate_limit(frame):
    pdf, df = frame
    req = df.select("k", F.lit("ingest").alias("grp"), "id", "ts")
    got = R.sliding_rate_limit(req, ["k"], "grp", 300, "id").toPandas().set_index("id")
    for k, g in pdf.groupby("k"):
        s = g["s"].to_numpy()
        for i, t in zip(g["id"], s):
            assert got.loc[i, "n_in_window"] == ((s > t - 300) & (s <= t)).sum()
    assert (got["allowed"] == (got["n_in_window"] <= 10)).all() and not got["allowed"].all()


def test_balance_floor(frame):
    pdf, df = frame
    got = running_balance(df.select("k", "s", "id", "d"), "k", ["s", "id"], "d", F.floor(F.col("s") / 500)).toPandas()
    got = got.set_index("id")["balance"]
    for _, g in pdf.sort_values(["s", "id"]).groupby("k"):
        b = 0
        for i, d in zip(g["id"], g["d"]):
            b = max(0, b + d)
            assert got[i] == b


def test_previous(frame):
    pdf, df = frame
    got = previous(df.select("k", "s", "id"), ["k"], ["s", "id"], F.floor(F.col("s") / 500), "id", "p").toPandas().set_index("id")["p"]
    for _, g in pdf.sort_values(["s", "id"]).groupby("k"):
        want = g["id"].shift(1)
        assert all((pd.isna(w) and pd.isna(got[i])) or got[i] == w for i, w in zip(g["id"], want))


def test_split_counts(frame):
    _, df = frame
    n = train_val_split(df.select("id"), "id", 0.1).groupBy("split").count().toPandas().set_index("split")["count"]
    assert n["val"] == 300 and n["train"] == 2700
    tiny = train_val_split(df.select("id").limit(3), "id", 0.1).where("split = 'val'").count()
    assert tiny == 1


def test_exact_duplicates_large_group(spark):
    rows = [(i, "same line") for i in range(500)] + [(600, "a"), (600, "b"), (601, "b"), (601, "a"), (602, "a")]
    got = A.exact_duplicates(spark.createDataFrame(rows, "f int, t string"), "f", "t").toPandas()
    assert len(got) == 502 and set(got[got["first_file"] == 600]["f"]) == {600, 601}
    assert set(got[got["first_file"] == 0]["n_files"]) == {500}


def test_cooldown(spark):
    t0 = pd.Timestamp("2024-01-01")
    rows = [("a", t0 + pd.Timedelta(hours=h)) for h in (0, 5, 23, 24, 30, 49)] + [("b", t0)]
    got = R.cooldown_gate(spark.createDataFrame(pd.DataFrame(rows, columns=["k", "at"]), "k string, at timestamp_ntz"), "k", "at").toPandas()
    assert sorted((got[got["k"] == "a"]["at"] - t0).dt.total_seconds() / 3600) == [0, 24, 49]


def test_one_group_is_dealt_by_range(spark, monkeypatch):
    """All rows in one group: its values lie in several ranges, and positions go on across them."""
    from leafmill.operators import running

    kept, seen = running.written, []
    monkeypatch.setattr(running, "written", lambda df, *a: seen.append(kept(df, *a)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).selectExpr("id * 7919 % 20000 / 3.0D as v").repartition(6)
        cum = {r.v: r.cum_n for r in running.cumulative_counts(df, [], "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [cum[v] for v in sorted(cum)] == list(range(1, 20_001))
    sizes = [r["count"] for r in seen[0].groupBy("_range").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 8_000
