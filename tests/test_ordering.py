"""Distributed order functions against pandas, with cells small enough that every branch runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialmesh.functions import ordering


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(5)
    n = 3000
    value = np.round(rng.normal(size=n), 2)
    value[: n // 3] = 0.5  # one value holds a third of all rows
    value[-40:] = np.nan
    return pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(rng.random(n) < 0.7, "a", rng.choice(["b", "c"], n)),
            "v": value,
            "w": rng.integers(1, 4, n),
        }
    )


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("cell", [60, 10**6])
def test_average_rank(spark, frame, by, cell):
    out = ordering.average_rank(
        spark.createDataFrame(frame), "v", by, tie="id", total="n", rows_per_cell=cell
    ).toPandas().sort_values("id")
    grouped = frame.groupby("g")["v"] if by else frame["v"]
    np.testing.assert_allclose(out["avg_rank"].to_numpy(), grouped.rank().to_numpy())
    sizes = grouped.transform("count") if by else frame["v"].count()
    assert (out["n"].to_numpy() == np.asarray(sizes)).all()


@pytest.mark.parametrize("cell", [60, 10**6])
def test_weighted_average_rank_equals_copies(spark, frame, cell):
    clean = frame.dropna()
    out = ordering.average_rank(
        spark.createDataFrame(clean), "v", ["g"], tie="id", weight="w", rows_per_cell=cell
    ).toPandas().sort_values("id")
    copies = clean.loc[clean.index.repeat(clean["w"])].copy()
    copies["r"] = copies.groupby("g")["v"].rank()
    want = copies.groupby("id")["r"].first()
    np.testing.assert_allclose(out["avg_rank"].to_numpy(), want.loc[out["id"]].to_numpy())


def _ordered(frame, by):
    import hashlib

    f = frame.dropna().copy()
    f["h"] = [hashlib.md5(str(i).encode()).hexdigest() for i in f["id"]]
    return f.sort_values([*by, "v", "h"], ascending=[True] * len(by) + [False, True])


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("cell", [60, 10**6])
def test_running_position(spark, frame, by, cell):
    out = ordering.running_position(
        spark.createDataFrame(frame), "v", by, tie="id", descending=True, weight="w", rows_per_cell=cell
    ).toPandas().set_index("id")["position"]
    want = _ordered(frame, by)
    want["p"] = want.groupby("g")["w"].cumsum() if by else want["w"].cumsum()
    want = want.set_index("id")["p"]
    assert (out.loc[want.index] == want).all() and len(out) == len(want)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("cell", [60, 10**6])
def test_exact_quantiles(spark, frame, by, cell):
    probs = [0.0, 0.02, 0.5, 0.9, 1.0]
    out = ordering.exact_quantiles(spark.createDataFrame(frame), "v", probs, by, tie="id", rows_per_cell=cell).toPandas()
    for row in out.itertuples():
        values = frame.loc[frame["g"] == row.g, "v"] if by else frame["v"]
        assert row.value == pytest.approx(values.quantile(row.prob), abs=1e-12)
    assert len(out) == len(probs) * (3 if by else 1)


@pytest.mark.parametrize("cell", [60, 10**6])
@pytest.mark.parametrize("descending", [True, False])
def test_cut_selects_exactly_k(spark, frame, cell, descending):
    df = spark.createDataFrame(frame)
    cuts, _ = ordering.cut_after(
        df, F.ceil(F.col("n") * 0.2), ["g"], value="v", tie="id", descending=descending, rows_per_cell=cell
    )
    flag = ordering.inside_cut(F.col("v"), F.col("id"), F.col("cut_value"), F.col("cut_hash"), descending)
    picked = df.join(cuts, "g").where(flag & ~F.isnan("v")).toPandas()
    for g, part in frame.dropna().groupby("g"):
        k = int(np.ceil(len(part) * 0.2))
        mine = picked.loc[picked["g"] == g, "v"]
        best = part["v"].nlargest(k) if descending else part["v"].nsmallest(k)
        assert len(mine) == k and sorted(mine) == sorted(best)


@pytest.mark.parametrize("cell", [60, 10**6])
def test_hash_position_and_take_first(spark, frame, cell):
    import hashlib

    df = spark.createDataFrame(frame[["id", "g"]])
    out = ordering.hash_position(df, F.md5(F.col("id").cast("string")), ["g"], rows_per_cell=cell).toPandas()
    out["h"] = [hashlib.md5(str(i).encode()).hexdigest() for i in out["id"]]
    assert (out.groupby("g")["h"].rank() == out["position"]).all()
    flag = ordering.take_first(df, 100, tie="id", rows_per_cell=cell)
    got = set(df.where(flag).toPandas()["id"])
    assert got == set(out.sort_values("h")["id"].head(100))


def test_dense_ids(spark, frame):
    keys = spark.createDataFrame(frame[["v"]].dropna()).distinct().select(F.format_number("v", 3).alias("k"))
    out = ordering.dense_ids(keys, ["k"], "id").toPandas().sort_values("k")
    assert list(out["id"]) == list(range(len(out)))


def test_search_over_many_groups_stays_distributed(spark, frame, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_TABLE", 5)
    df = spark.createDataFrame(frame)
    out = ordering.exact_quantiles(df, "v", [0.25, 0.9], ["g"], tie="id", rows_per_cell=60).toPandas()
    assert len(out) == 6
    for row in out.itertuples():
        assert row.value == pytest.approx(frame.loc[frame["g"] == row.g, "v"].quantile(row.prob), abs=1e-12)
    cuts, small = ordering.cut_after(df, F.ceil(F.col("n") * 0.2), ["g"], value="v", tie="id", rows_per_cell=60)
    assert not small
    flag = ordering.inside_cut(F.col("v"), F.col("id"), F.col("cut_value"), F.col("cut_hash"))
    picked = df.join(cuts, "g").where(flag & ~F.isnan("v")).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in picked} == {g: int(np.ceil(len(p) * 0.2)) for g, p in frame.dropna().groupby("g")}
