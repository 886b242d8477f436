"""In-fold (deferred) encoding workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators.folds import STRATIFIED, assign_folds
from foldwise.operators.infold import Deferred, infold_encode
from foldwise.workloads.common import r, table, workload

_FOLDS_SQL_STRAT = """
base AS (SELECT o_orderkey, o_orderpriority, o_custkey, o_totalprice,
                CAST(o_orderstatus = 'F' AS INTEGER) AS y FROM orders),
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)),
                                         o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM base),
ff AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) t(fit_fold))"""


def _orders_y(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"))


_TARGET_SQL = f"""
WITH {_FOLDS_SQL_STRAT},
g AS (SELECT ff.fit_fold, avg(y) AS gm FROM f JOIN ff ON f.fold <> ff.fit_fold GROUP BY 1),
s AS (SELECT ff.fit_fold, o_orderpriority, avg(y) AS m, count(y) AS n
      FROM f JOIN ff ON f.fold <> ff.fit_fold GROUP BY 1, 2),
enc AS (SELECT f.fold AS fit_fold, f.o_orderpriority, f.y,
               coalesce((s.m * s.n + g.gm * 1.0) / (s.n + 1.0), g.gm) AS te
        FROM f JOIN g ON g.fit_fold = f.fold
        LEFT JOIN s ON s.fit_fold = f.fold AND s.o_orderpriority = f.o_orderpriority)
SELECT fit_fold AS fold, o_orderpriority, count(*) AS n_heldout,
       round(avg(te), 6) AS mean_enc, round(avg(abs(y - te)), 6) AS mean_abs_err
FROM enc GROUP BY 1, 2
"""


@workload("infold_target_encode", _TARGET_SQL)
def infold_target_encode(spark, d):
    """Stratified md5 folds on orders, in-fold smoothed target encoding of the
    order priority for every fold at once, held-out encoding error per
    (fold, priority)."""
    folds = assign_folds(_orders_y(spark, d), "o_orderkey", k=5, kind=STRATIFIED, seed=42,
                         y="y")
    enc = infold_encode(folds, [Deferred("target_encode", ("o_orderpriority",), "te")],
                        "o_orderkey", "y", k=5, kind=STRATIFIED)
    return _held_out_error(enc.filter("heldout"))


def _held_out_error(held):
    return held.groupBy(F.col("fit_fold").alias("fold"), "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_heldout"), r(F.avg("te"), "mean_enc"),
        r(F.avg(F.abs(F.col("y") - F.col("te"))), "mean_abs_err"))


@workload("encoder_saved_and_reloaded", _TARGET_SQL)
def encoder_saved_and_reloaded(spark, d):
    """The same encoding from an ML pipeline stage: fitted inside a Pipeline,
    saved, loaded again and applied."""
    from pyspark.ml import Pipeline, PipelineModel

    from foldwise.operators.encoder import InFoldEncoder
    from foldwise.sources.sinks import save_model
    from foldwise.workloads.io import _scratch

    folds = assign_folds(_orders_y(spark, d), "o_orderkey", k=5, kind=STRATIFIED, seed=42, y="y")
    stage = InFoldEncoder(inputCols=["o_orderpriority"], targetCol="y", outputCol="te", numFolds=5, foldKind=STRATIFIED)
    path = f"{_scratch(spark)}/encoder"
    save_model(Pipeline(stages=[stage]).fit(folds), path)
    held = PipelineModel.load(path).transform(folds)
    return _held_out_error(held.withColumn("fit_fold", F.col("fold")))
