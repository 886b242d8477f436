"""Immediate feature operators: hand values (fit on train, apply to test)."""

import math

import pytest

from foldwise.operators.features import fit_immediate
from foldwise.plans.spec import FeatureOp, PlanError


def _col(df, c, order="id"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


def test_log_transform_skipped_on_negative_train(spark):
    tr = spark.createDataFrame([(1, -1.0), (2, 2.0)], "id int, x double")
    f = fit_immediate(tr, [FeatureOp.of("log_transform", "x", "lx")])
    assert f.created == [] and f.skipped
    assert "lx" not in f.apply(tr).columns


def test_log_sqrt_values(spark):
    tr = spark.createDataFrame([(1, 0.0), (2, 3.0)], "id int, x double")
    te = spark.createDataFrame([(3, 8.0), (4, -0.5)], "id int, x double")
    f = fit_immediate(tr, [FeatureOp.of("log_transform", "x", "lx"), FeatureOp.of("sqrt_transform", "x", "sx")])
    out = f.apply(te)
    assert _col(out, "lx")[0] == pytest.approx(math.log1p(8.0))
    assert _col(out, "sx") == [pytest.approx(math.sqrt(8.0)), None]   # negative test value → NULL


def test_interactions(spark):
    tr = spark.createDataFrame([(1, 2.0, 1.0), (2, 4.0, 2.0)], "id int, a double, b double")
    te = spark.createDataFrame([(3, 6.0, 3.0)], "id int, a double, b double")
    ops = [FeatureOp.of("interaction_multiply", ["a", "b"], "m"), FeatureOp.of("interaction_ratio", ["a", "b"], "r"),
           FeatureOp.of("polynomial_degree2", "a", "p")]
    f = fit_immediate(tr, ops)
    assert _col(f.apply(tr), "m") == [2.0, 8.0]
    assert _col(f.apply(te), "m") == [18.0]
    assert _col(f.apply(tr), "r") == [pytest.approx(2.0, rel=1e-3), pytest.approx(2.0, rel=1e-3)]
    assert _col(f.apply(tr), "p") == [4.0, 16.0]


def test_count_encoding_train_only(spark):
    tr = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, c string")
    te = spark.createDataFrame([(4, "a"), (5, "z")], "id int, c string")
    f = fit_immediate(tr, [FeatureOp.of("count_encoding", "c", "n")])
    assert _col(f.apply(tr), "n") == [2, 2, 1]
    assert _col(f.apply(te), "n") == [2, 0]


def test_equal_width_bins_right_closed(spark):
    tr = spark.createDataFrame([(i, float(i)) for i in range(11)], "id int, x double")
    te = spark.createDataFrame([(100, -5.0), (101, 1.0), (102, 1.0001), (103, 99.0), (104, None)],
                               "id int, x double")
    f = fit_immediate(tr, [FeatureOp.of("bin_equal_width", "x", "b", bins=10)])
    # edges 1, 2, ..., 9 interior; (0,1] → 0, (1,2] → 1, ends open
    assert _col(f.apply(te), "b") == [0, 0, 1, 9, None]


def test_equal_width_constant_column_is_skipped(spark):
    tr = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, x double")
    f = fit_immediate(tr, [FeatureOp.of("bin_equal_width", "x", "b", bins=4)])
    assert f.created == [] and f.skipped


def test_equal_freq_bins_match_numpy(spark):
    import numpy as np
    import pandas as pd

    vals = [1.0, 2.0, 2.0, 3.0, 7.0, 8.0, 9.0, 20.0, 21.0, 50.0]
    tr = spark.createDataFrame(list(enumerate(vals)), "id int, x double")
    f = fit_immediate(tr, [FeatureOp.of("bin_equal_freq", "x", "b", bins=4)])
    edges = np.unique(np.quantile(vals, np.linspace(0, 1, 5)))
    edges[0], edges[-1] = -np.inf, np.inf
    expected = pd.cut(pd.Series(vals), bins=edges, labels=False).tolist()
    assert _col(f.apply(tr), "b") == expected


def test_extract_title_rare_and_unseen(spark):
    names = ["A, Mr. X", "B, Mr. Y", "C, Mrs. Z", "D, Mrs. W", "E, Miss. V", "F, Miss. U", "G, Dr. T"]
    tr = spark.createDataFrame(list(enumerate(names)), "id int, Name string")
    te = spark.createDataFrame([(10, "H, Countess. S"), (11, "I, Mr. R")], "id int, Name string")
    f = fit_immediate(tr, [FeatureOp.of("extract_title", "Name", "t", min_count=2)])
    assert set(_col(f.apply(tr), "t")) == {"Mr", "Mrs", "Miss", "Rare"}
    assert _col(f.apply(te), "t") == ["Rare", "Mr"]


def test_family_alone_deck(spark):
    df = spark.createDataFrame([(1, 0, 0, "C85"), (2, 1, 2, "E46"), (3, 3, 0, None), (4, None, 1, "B28")],
                               "id int, sib int, par int, cabin string")
    ops = [FeatureOp.of("family_size", ["sib", "par"], "fs"), FeatureOp.of("is_alone", ["sib", "par"], "al"),
           FeatureOp.of("cabin_deck", "cabin", "dk")]
    out = fit_immediate(df, ops).apply(df)
    assert _col(out, "fs") == [1.0, 4.0, 4.0, 2.0]
    assert _col(out, "al") == [1, 0, 0, 0]
    assert _col(out, "dk") == ["C", "E", "U", "B"]


def test_datetime_parts(spark):
    import datetime as dt

    tr = spark.createDataFrame([(1, dt.datetime(2021, 1, 1, 5)), (2, dt.datetime(2021, 6, 15))], "id int, d timestamp")
    te = spark.createDataFrame([(3, dt.datetime(2020, 12, 31, 23)), (4, None)], "id int, d timestamp")
    f = fit_immediate(tr, [FeatureOp.of("datetime_parts", "d", "p")])
    a = f.apply(tr).orderBy("id").collect()
    assert [r["p_year"] for r in a] == [2021, 2021] and [r["p_month"] for r in a] == [1, 6]
    assert a[0]["p_dow"] == 4 and a[0]["p_hour"] == 5          # 2021-01-01 is a Friday (Mon=0)
    assert a[1]["p_days_since_min"] == 164
    b = f.apply(te).orderBy("id").collect()
    assert b[0]["p_days_since_min"] == -1                        # floored, 6 hours before the minimum
    assert b[1]["p_year"] is None


def test_lag_and_rolling_match_pandas(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(0)
    v = rng.normal(size=50)
    v[[3, 17]] = np.nan
    pdf = pd.DataFrame({"id": np.arange(50), "x": v})
    df = spark.createDataFrame([(int(i), None if np.isnan(x) else float(x)) for i, x in zip(pdf.id, pdf.x)],
                               "id long, x double")
    ops = [FeatureOp.of("lag", "x", "l2", periods=2), FeatureOp.of("rolling_mean", "x", "r3", window=3)]
    from foldwise.operators import ordering

    out = fit_immediate(df, ops).apply(df, order_by=["id"]).orderBy("id").toPandas()
    exp_l = pdf.x.shift(2)
    exp_r = pdf.x.rolling(3, min_periods=1).mean()
    assert np.allclose(out.l2.astype(float), exp_l, equal_nan=True)
    assert np.allclose(out.r3.astype(float), exp_r, equal_nan=True)
    # small blocks: the halo must carry rows across block boundaries
    small = ordering.with_trailing_window(df, ["id"], lambda w: {"l2": __import__("pyspark.sql.functions",
                                          fromlist=["lag"]).lag("x", 2).over(w)}, halo=2, block_rows=7)
    got = small.orderBy("id").toPandas().l2.astype(float)
    assert np.allclose(got, exp_l, equal_nan=True)


def test_deferred_op_cannot_be_fitted_on_full_train(spark):
    tr = spark.createDataFrame([(1, "a", 1)], "id int, c string, y int")
    with pytest.raises(PlanError):
        fit_immediate(tr, [FeatureOp.of("target_encode", "c", "te")])
