"""Guards and grouped paths not covered elsewhere."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.operators import ordering as O
from foldwise.operators.features import fit_immediate
from foldwise.operators.output import label_table, postprocess
from foldwise.plans.spec import FeatureOp
from foldwise.session import size_checked_broadcast


def test_grouped_lag_matches_pandas(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"rid": np.arange(300), "g": rng.integers(0, 4, 300), "x": rng.normal(size=300)})
    df = spark.createDataFrame(pdf)
    out = O.lag(df, "x", ["rid"], periods=2, output="l2", partition_by=["g"]).toPandas().set_index("rid").sort_index()
    exp = pdf.sort_values("rid").groupby("g")["x"].shift(2)
    assert np.allclose(out.l2.astype(float), exp.sort_index(), equal_nan=True)
    roll = O.rolling_mean(df, "x", ["rid"], window=4, output="r4", partition_by=["g"]).toPandas()
    roll = roll.set_index("rid").sort_index()
    exp_r = pdf.sort_values("rid").groupby("g")["x"].transform(lambda s: s.rolling(4, min_periods=1).mean())
    assert np.allclose(roll.r4.astype(float), exp_r.sort_index())


def test_size_checked_broadcast_both_ways(spark):
    _, b = size_checked_broadcast(spark.range(5), max_bytes=1000)
    assert b
    _, b2 = size_checked_broadcast(spark.range(50), max_bytes=1000)
    assert not b2
    _, b3 = size_checked_broadcast(spark.range(50), max_bytes=1000, known_max_rows=8)
    assert b3
    wide = spark.range(3).select(F.repeat(F.lit("x"), 2000).alias("key"))   # few rows, many bytes
    _, b4 = size_checked_broadcast(wide, max_bytes=1000, known_max_rows=3)
    assert not b4


def test_stream_refuses_order_dependent_ops(spark, tmp_path):
    from foldwise.streaming.apply import apply_to_stream

    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double")
    fitted = fit_immediate(df, [FeatureOp.of("lag", "x", "lx")])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError):
        apply_to_stream(stream, fitted)
    with pytest.raises(ValueError):
        apply_to_stream(df, fitted)        # not a stream


def test_label_table_takes_any_number_of_labels(spark):
    df = spark.range(20_000).withColumn("y", F.col("id").cast("double"))
    got = label_table(df.unionByName(df).withColumn("y", F.when(F.col("id") != 3, F.col("y"))), "y")
    assert [tuple(r) for r in got.orderBy("index").limit(4).collect()] == [(0.0, 0), (1.0, 1), (2.0, 2), (4.0, 3)]
    assert got.count() == 19_999
    preds = spark.createDataFrame([(1, [0.1, 0.9]), (2, [0.0, 0.0, 0.0, 0.0, 1.0])], "id long, pred array<double>")
    few = label_table(df.filter("id < 3"), "y")
    assert {r["id"]: r["pred"] for r in postprocess(preds, "pred", "label", few).collect()} == {1: 1.0, 2: 2.0}


def test_near_monotonic_skips_nulls(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, 2.0), (3, 1.5), (4, 3.0)], "rid long, x double")
    r = O.near_monotonic(df, ["x"], ["rid"]).first()
    assert r["n_nonnull"] == 4 and r["share_nondecreasing"] == pytest.approx(2 / 3) and not r["is_monotonic"]
    short = spark.createDataFrame([(0, 1.0), (1, 2.0)], "rid long, x double")
    assert not O.near_monotonic(short, ["x"], ["rid"]).first()["is_monotonic"]   # fewer than 3 values


def test_r2_constant_target_and_null_predictions(spark):
    from foldwise.operators.metrics import score

    same = spark.createDataFrame([(2.0, 2.0, 1), (2.0, 2.0, 1)], "y double, pred double, g int")
    assert score(same, "r2", group_by=["g"]).first()["score"] == 1.0
    off = spark.createDataFrame([(2.0, 3.0, 1), (2.0, 2.0, 1)], "y double, pred double, g int")
    assert score(off, "r2", group_by=["g"]).first()["score"] == 0.0
    withnull = spark.createDataFrame([(1.0, None, 1), (2.0, 2.5, 1)], "y double, pred double, g int")
    assert score(withnull, "mae", group_by=["g"]).first()["score"] == 0.5   # never-validated rows left out


def test_probability_vectors_average_weight_and_pivot(spark):
    from foldwise.operators import blend as B
    from foldwise.operators.train import average_predictions

    p = spark.createDataFrame([(1, "m", 0, [0.2, 0.8]), (1, "m", 1, [0.4, 0.6]), (2, "m", 0, [1.0, 0.0])],
                              "row_id long, model string, fold int, pred array<double>")
    avg = {r["row_id"]: r["pred"] for r in average_predictions(p).collect()}
    assert avg[1] == pytest.approx([0.3, 0.7]) and avg[2] == [1.0, 0.0]
    two = spark.createDataFrame([(1, "a", [0.2, 0.8]), (1, "b", [0.6, 0.4])], "row_id long, model string, pred array<double>")
    w = spark.createDataFrame([("a", 0.25), ("b", 0.75)], "model string, weight double")
    assert B.weighted_average(two, w).first()["pred"] == pytest.approx([0.5, 0.5])
    wide = B.meta_features(two, ["a", "b"]).first()
    assert (wide["a_0"], wide["a_1"], wide["b_0"], wide["b_1"]) == (0.2, 0.8, 0.6, 0.4)


def test_nan_is_missing(spark):
    from foldwise.operators.matrix import fit_matrix

    nan = float("nan")
    tr = spark.createDataFrame([(0, 1.0), (1, nan), (2, 3.0), (3, 5.0)], "rid long, x double")
    f = fit_immediate(tr, [FeatureOp.of("bin_equal_width", "x", "b", bins=2),
                           FeatureOp.of("count_encoding", "x", "ce")])
    got = {r["rid"]: (r["b"], r["ce"]) for r in f.apply(tr).collect()}
    assert got[1] == (None, 0) and got[0] == (0, 1) and got[3] == (1, 1)   # edges from 1..5, NaN ignored
    fm = fit_matrix(tr, ["x"], order_by="rid")
    filled = {r["rid"]: r["x"] for r in fm.apply(tr, keep=["rid"]).collect()}
    assert filled[1] == 3.0                                                  # median of 1, 3, 5


def test_fewer_rows_than_folds(spark):
    from foldwise.operators.folds import KFOLD, assign_folds
    from foldwise.operators.infold import Deferred, infold_encode

    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1)], "rid long, k string, y int")
    f = assign_folds(df, "rid", k=5, kind=KFOLD)
    assert sorted(r["fold"] for r in f.collect()) == [0, 1, 2]      # two folds stay empty
    enc = infold_encode(f, [Deferred("target_encode", ("k",), "te")], "rid", "y", k=5).collect()
    assert len(enc) == 15                                           # every row in every fit fold
    assert all(r["te"] is not None for r in enc)


def test_lookup_join_is_the_same_without_a_broadcast(spark):
    from foldwise.session import lookup_join

    df = spark.createDataFrame([(i, None if i % 3 else f"k{i % 5}") for i in range(60)], "rid long, k string")
    table = spark.createDataFrame([("k0", 1.0), ("k1", 2.0), ("zz", 3.0)], "key string, v double")
    want = sorted(tuple(r) for r in df.join(table, df["k"] == table["key"], "left").select("rid", "v").fillna(-1.0).collect())
    for small in (True, False):
        got = lookup_join(df, table, "k", "key", small).select("rid", "v").fillna(-1.0)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_pair_correlations_match_numpy(spark):
    from foldwise.operators import profile as P

    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [1, 1e3, 1e-3, 1] + [1e6, 0, 5, 0]
    x[:, 3] = 7.0                                              # constant
    x[:, 2] += x[:, 0] * 1e-3
    x[rng.random((400, 4)) < 0.2] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], "a double, b double, c double, d double").repartition(5)
    got = {(r["i"], r["j"]): r for r in P.pair_correlations(df, ["a", "b", "c", "d"], ["a", "b", "c", "d"], upper=True).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            r = got[i, j]
            assert r["n_pairs"] == both.sum()
            if 3 in (i, j):
                assert r["r"] is None
            else:
                assert r["r"] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-9)
    top = P.top_correlations(df, 2).collect()
    assert (top[0]["col_a"], top[0]["col_b"]) == ("a", "c")


def test_known_features_are_no_leaks_by_correlation(spark):
    from foldwise.operators import profile as P

    df = spark.createDataFrame([(i, float(i), 2.0 * i, float(i % 7), float(i)) for i in range(50)], "id long, y double, twice double, other double, my_label double")
    flagged = lambda **kw: {r["column"]: (r["by_name"], r["by_correlation"]) for r in P.leakage_columns(df, "id", ["y"], **kw).collect()}
    assert flagged() == {"twice": (False, True), "my_label": (True, True)}
    assert flagged(known_features=["twice", "my_label"]) == {"my_label": (True, False)}
