"""HLL and KLL sketches against exact counts and quantiles; merging by file."""
import tempfile

import numpy as np
from pyspark.sql import functions as F

from foldwise.operators import profile as P
from foldwise.operators import sketches as K
from foldwise.operators.features import fit_immediate
from foldwise.operators.matrix import fit_matrix
from foldwise.plans.spec import FeatureOp


def _frame(spark, n=20_000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 977).cast("double").alias("x"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 50)).alias("s"),
                                 F.lit(None).cast("double").alias("none"), F.lit(float("nan")).alias("nan"), (F.col("id") % 2 == 0).alias("b"))


def test_estimates_lie_within_the_stated_errors(spark):
    df = _frame(spark)
    exact, guess = P.distinct_counts(df, ["k", "x", "s", "none", "b"]), P.distinct_counts(df, ["k", "x", "s", "none", "b"], approximate=True)
    assert exact == {"k": 20_000, "x": 977, "s": 50, "none": 0, "b": 2}
    assert all(abs(guess[c] - exact[c]) <= K.DISTINCT_ERROR * exact[c] for c in exact)
    got = K.quantile_estimates(K.column_sketches(df, ["k", "none", "nan", "s"]), [0.0, 0.1, 0.5, 1.0])
    assert got["none"] == got["nan"] == got["s"] == [None] * 4
    assert all(abs(v / 20_000 - p) <= K.RANK_ERROR for v, p in zip(got["k"], [0.0, 0.1, 0.5, 1.0]))


def test_opt_in_statistics(spark):
    df = _frame(spark)
    exact, near = (fit_matrix(df, ["k", "x", "none"], "k", approximate=a).medians for a in (False, True))
    assert exact["x"] == np.median(np.arange(20_000) % 977) and abs(near["k"] - exact["k"]) <= 20_000 * K.RANK_ERROR and near["none"] is exact["none"] is None
    fitted = fit_immediate(df, [FeatureOp.of("bin_equal_freq", "k", "q", bins=4, approximate=1), FeatureOp.of("bin_equal_freq", "none", "z", bins=4, approximate=1)])
    assert np.allclose(fitted.scalars["edges0"], [5000, 10_000, 15_000], atol=20_000 * K.RANK_ERROR) and [n for n, _ in fitted.skipped] == ["z"]


def test_files_are_sketched_once(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="fw-sk-")
    _frame(spark, 1000).repartition(3).write.parquet(f"{base}/d")
    first = K.distinct_estimates(K.update_sketches(spark, f"{base}/d", ["k"], f"{base}/store"))
    calls = []
    made = K.column_sketches
    monkeypatch.setattr(K, "column_sketches", lambda *a: calls.append(a) or made(*a))
    assert K.distinct_estimates(K.update_sketches(spark, f"{base}/d", ["k"], f"{base}/store")) == first and not calls
    _frame(spark, 1500).filter("k >= 1000").coalesce(1).write.mode("append").parquet(f"{base}/d")
    kept = K.update_sketches(spark, f"{base}/d", ["k"], f"{base}/store")
    assert len(calls) == 1 and kept.count() == 4 and K.merged(kept).first().n == 1500
    assert abs(K.distinct_estimates(kept)["k"] - 1500) <= 1500 * K.DISTINCT_ERROR


def test_sketch_files_grow_with_the_rows(spark, monkeypatch):
    """The query's files stay within a number of rows; they were four, however many rows there are."""
    from foldwise.operators import sketches
    from foldwise.workloads import profile

    monkeypatch.setattr(profile, "SKETCH_FILE_ROWS", 500)
    seen, update = [], sketches.update_sketches
    monkeypatch.setattr(sketches, "update_sketches", lambda spark, path, *a: seen.append(path) or update(spark, path, *a))
    sf = "/root/testdata/sf0.001"
    got = profile.sketches_within_error(spark, sf).collect()
    assert len(got) == 5 and all(r["distinct_within"] and r["quartiles_within"] in (True, None) for r in got)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert rows > 2000 and len(spark.read.parquet(seen[0]).inputFiles()) == -(-rows // 500)
