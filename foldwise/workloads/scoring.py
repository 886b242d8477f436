"""Metric, blending, output and run-history workloads.

Prediction tables are stand-ins built per row from the orders table (two
binary "models", a regression model and a 3-class probability model) on the
md5 shuffled folds; every metric, blend and output step runs on them through
the library's own operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import blend as B
from foldwise.operators import history as H
from foldwise.operators import output as O
from foldwise.operators.folds import KFOLD, assign_folds
from foldwise.operators.metrics import binary_scores, score
from foldwise.workloads.common import r, table, workload

_MD5 = "md5('42:' || CAST(o_orderkey AS VARCHAR))"
_BASE_SQL = f"""
o AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus,
             CAST((row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders),
p AS (SELECT o_orderkey, fold, 'm_a' AS model, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
             ((o_custkey * 37) % 101) / 100.0 AS pred FROM o
      UNION ALL
      SELECT o_orderkey, fold, 'm_b', CAST(o_orderstatus = 'F' AS INTEGER),
             ((o_orderkey * 7919) % 1000) / 999.0 FROM o)"""


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _folded_orders(spark, d):
    return assign_folds(_orders(spark, d), "o_orderkey", k=5, kind=KFOLD, seed=42)


def binary_preds(spark, d, folds: bool = True):
    """Two binary stand-in models over orders; with ``folds`` each row also
    has its shuffled fold."""
    o = _folded_orders(spark, d) if folds else _orders(spark, d).withColumn("fold", F.lit(0))
    y = (F.col("o_orderstatus") == "F").cast("int").alias("y")
    a = o.select("o_orderkey", "fold", F.lit("m_a").alias("model"), y,
                 (F.pmod(F.col("o_custkey") * 37, F.lit(101)) / 100.0).alias("pred"))
    b = o.select("o_orderkey", "fold", F.lit("m_b").alias("model"), y,
                 (F.pmod(F.col("o_orderkey") * 7919, F.lit(1000)) / 999.0).alias("pred"))
    return a.unionByName(b)


@workload("metrics_binary", f"""
WITH {_BASE_SQL},
rk AS (SELECT *, rank() OVER (PARTITION BY model, fold ORDER BY pred)
                 + (count(*) OVER (PARTITION BY model, fold, pred) - 1) / 2.0 AS ar FROM p),
auc AS (SELECT model, fold, 'auc' AS metric,
               (sum(CASE WHEN y = 1 THEN ar ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
               / (sum(y) * (count(*) - sum(y))) AS score FROM rk GROUP BY 1, 2),
ll AS (SELECT model, fold, 'logloss', -avg(y * ln(greatest(least(pred, 1 - 2.220446049250313e-16), 2.220446049250313e-16))
              + (1 - y) * ln(1 - greatest(least(pred, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))
       FROM p GROUP BY 1, 2),
f1 AS (SELECT model, fold, 'f1',
              2.0 * sum(CASE WHEN y = 1 AND pred > 0.5 THEN 1 ELSE 0 END)
              / (sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) + sum(CASE WHEN pred > 0.5 THEN 1 ELSE 0 END)) FROM p GROUP BY 1, 2),
acc AS (SELECT model, fold, 'accuracy', avg(CASE WHEN y = CAST(pred > 0.5 AS INTEGER) THEN 1.0 ELSE 0.0 END)
        FROM p GROUP BY 1, 2)
SELECT model, fold, metric, round(score, 6) AS score FROM (
  SELECT * FROM auc UNION ALL SELECT * FROM ll UNION ALL SELECT * FROM f1 UNION ALL SELECT * FROM acc)
""")
def metrics_binary(spark, d):
    """Exact AUC (tie-averaged Mann-Whitney), log loss, F1 and accuracy per (model, fold)."""
    p = binary_preds(spark, d)
    return binary_scores(p, ["auc", "logloss", "f1", "accuracy"], group_by=["model", "fold"]) \
        .select("model", "fold", "metric", r("score"))


@workload("metrics_regression", f"""
WITH o AS (SELECT o_orderkey, o_totalprice AS y,
                  CAST((row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders),
p AS (SELECT o_orderkey, fold, y, y * (0.9 + (o_orderkey % 21) / 100.0) AS pred FROM o)
SELECT fold, 'rmse' AS metric, round(sqrt(avg((y - pred) * (y - pred))), 6) AS score FROM p GROUP BY 1
UNION ALL SELECT fold, 'mae', round(avg(abs(y - pred)), 6) FROM p GROUP BY 1
UNION ALL SELECT fold, 'r2', round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(y)), 6) FROM p GROUP BY 1
""")
def metrics_regression(spark, d):
    """RMSE, MAE and R² per fold of a stand-in regression of the order total."""
    o = _folded_orders(spark, d)
    p = o.select("fold", F.col("o_totalprice").alias("y"),
                 (F.col("o_totalprice") * (0.9 + (F.col("o_orderkey") % 21) / 100.0)).alias("pred"))
    out = None
    for m in ("rmse", "mae", "r2"):
        s = score(p, m, group_by=["fold"])
        out = s if out is None else out.unionByName(s)
    return out.select("fold", "metric", r("score"))


def multiclass_preds(spark, d, folds: bool = True):
    o = _folded_orders(spark, d) if folds else _orders(spark, d).withColumn("fold", F.lit(0))
    a = [(F.pmod(F.col("o_orderkey") * ((i + 3) * 31), F.lit(97)) + 1).cast("double") for i in range(3)]
    tot = a[0] + a[1] + a[2]
    y = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select("o_orderkey", "fold", y.alias("y"), F.array(*[x / tot for x in a]).alias("pred"))


_MC_SQL = f"""
o AS (SELECT o_orderkey, o_orderstatus,
             CAST((row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders),
a AS (SELECT o_orderkey, fold, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y,
             CAST((o_orderkey * 93) % 97 + 1 AS DOUBLE) AS a0, CAST((o_orderkey * 124) % 97 + 1 AS DOUBLE) AS a1,
             CAST((o_orderkey * 155) % 97 + 1 AS DOUBLE) AS a2 FROM o),
p AS (SELECT o_orderkey, fold, y, [a0 / (a0 + a1 + a2), a1 / (a0 + a1 + a2), a2 / (a0 + a1 + a2)] AS pred FROM a)"""


@workload("metrics_multiclass", f"""
WITH {_MC_SQL},
c AS (SELECT fold, k, CAST(y = k AS INTEGER) AS yc, pred[k + 1] AS pc FROM p, (VALUES (0), (1), (2)) t(k)),
rk AS (SELECT *, rank() OVER (PARTITION BY fold, k ORDER BY pc)
                 + (count(*) OVER (PARTITION BY fold, k, pc) - 1) / 2.0 AS ar FROM c),
auc AS (SELECT fold, avg(s) AS score FROM (
          SELECT fold, k, (sum(CASE WHEN yc = 1 THEN ar ELSE 0 END) - sum(yc) * (sum(yc) + 1) / 2.0)
                          / (sum(yc) * (count(*) - sum(yc))) AS s FROM rk GROUP BY 1, 2) GROUP BY 1),
lab AS (SELECT fold, y, list_position(pred, list_max(pred)) - 1 AS l, pred FROM p),
ll AS (SELECT fold, -avg(ln(greatest(least(pred[y + 1], 1 - 2.220446049250313e-16), 2.220446049250313e-16)
        / list_sum(list_transform(pred, lambda v: greatest(least(v, 1 - 2.220446049250313e-16), 2.220446049250313e-16)))))
        AS score FROM p GROUP BY 1),
acc AS (SELECT fold, avg(CASE WHEN y = l THEN 1.0 ELSE 0.0 END) AS score FROM lab GROUP BY 1),
cls AS (SELECT DISTINCT fold, y AS k FROM lab UNION SELECT DISTINCT fold, l FROM lab),
f1c AS (SELECT cls.fold, cls.k,
               2.0 * sum(CASE WHEN lab.y = cls.k AND lab.l = cls.k THEN 1 ELSE 0 END)
               / (sum(CASE WHEN lab.y = cls.k THEN 1 ELSE 0 END) + sum(CASE WHEN lab.l = cls.k THEN 1 ELSE 0 END)) AS s
        FROM cls JOIN lab ON lab.fold = cls.fold GROUP BY 1, 2),
f1 AS (SELECT fold, avg(s) AS score FROM f1c GROUP BY 1)
SELECT fold, metric, round(score, 6) AS score FROM (
  SELECT fold, 'auc' AS metric, score FROM auc UNION ALL SELECT fold, 'logloss', score FROM ll
  UNION ALL SELECT fold, 'accuracy', score FROM acc UNION ALL SELECT fold, 'f1', score FROM f1)
""")
def metrics_multiclass(spark, d):
    """One-vs-rest macro AUC, log loss, argmax accuracy and macro F1 per fold
    for 3-class probability vectors."""
    p = multiclass_preds(spark, d)
    out = None
    for m in ("auc", "logloss", "accuracy", "f1"):
        s = score(p, m, group_by=["fold"])
        out = s if out is None else out.unionByName(s)
    return out.select("fold", "metric", r("score"))


_BLEND_SQL = f"""
WITH {_BASE_SQL},
rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY pred)
                 + (count(*) OVER (PARTITION BY model, pred) - 1) / 2.0 AS ar,
              count(*) OVER (PARTITION BY model) AS n FROM p),
auc AS (SELECT model, (sum(CASE WHEN y = 1 THEN ar ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0)
                      / (sum(y) * (count(*) - sum(y))) AS s FROM rk GROUP BY 1),
sh AS (SELECT model, s - max(s) OVER () AS z FROM auc),
w AS (SELECT model, exp(z) / sum(exp(z)) OVER () AS w FROM sh),
wa AS (SELECT p.o_orderkey, sum(w.w * p.pred) AS weighted FROM p JOIN w ON p.model = w.model GROUP BY 1),
ra AS (SELECT o_orderkey, avg(ar / n) AS ranked FROM rk GROUP BY 1)"""


@workload("blend_weighted_rank", _BLEND_SQL + """
SELECT wa.o_orderkey, round(weighted, 6) AS weighted, round(ranked, 6) AS ranked
FROM wa JOIN ra ON wa.o_orderkey = ra.o_orderkey
""")
def blend_weighted_rank(spark, d):
    """Softmax-of-AUC weighted average and rank average of two binary models, per row."""
    p = binary_preds(spark, d, folds=False).withColumnRenamed("o_orderkey", "row_id")
    w = B.softmax_weights(score(p, "auc", group_by=["model"]), higher_is_better=True)
    both = B.weighted_and_rank_average(p, w)
    return both.select(F.col("row_id").alias("o_orderkey"), r("weighted"), r("ranked"))


@workload("blend_meta_features", f"""
WITH {_BASE_SQL}
SELECT o_orderkey, round(max(CASE WHEN model = 'm_a' THEN pred END), 6) AS m_a,
       round(max(CASE WHEN model = 'm_b' THEN pred END), 6) AS m_b FROM p GROUP BY 1
""")
def blend_meta_features(spark, d):
    """Meta-feature matrix: one prediction column per model, side by side by row id."""
    p = binary_preds(spark, d, folds=False).withColumnRenamed("o_orderkey", "row_id")
    wide = B.meta_features(p, ["m_a", "m_b"])
    return wide.select(F.col("row_id").alias("o_orderkey"), r("m_a"), r("m_b"))


@workload("blend_vs_best", _BLEND_SQL + """,
bl AS (SELECT wa.o_orderkey, wa.weighted AS pred, o.o_orderstatus = 'F' AS yb FROM wa JOIN o ON wa.o_orderkey = o.o_orderkey),
brk AS (SELECT *, rank() OVER (ORDER BY pred) + (count(*) OVER (PARTITION BY pred) - 1) / 2.0 AS ar FROM bl),
bauc AS (SELECT (sum(CASE WHEN yb THEN ar ELSE 0 END) - sum(CAST(yb AS INTEGER)) * (sum(CAST(yb AS INTEGER)) + 1) / 2.0)
                / (sum(CAST(yb AS INTEGER)) * (count(*) - sum(CAST(yb AS INTEGER)))) AS s FROM brk)
SELECT (SELECT arg_max(model, s) FROM auc) AS best_model, round((SELECT max(s) FROM auc), 6) AS best_score,
       round(bauc.s, 6) AS blend_score, round(bauc.s - (SELECT max(s) FROM auc), 6) AS gain FROM bauc
""")
def blend_vs_best(spark, d):
    """Best single model by AUC, AUC of the softmax-weighted blend and the gain over the best solo."""
    p = binary_preds(spark, d, folds=False).withColumnRenamed("o_orderkey", "row_id")
    s = score(p, "auc", group_by=["model"])
    w = B.softmax_weights(s, higher_is_better=True)
    blended = B.weighted_average(p, w).join(p.filter(F.col("model") == "m_a").select("row_id", "y"), "row_id")
    bs = score(blended.withColumn("g", F.lit(1)), "auc", group_by=["g"])
    best = s.agg(F.max_by("model", "score").alias("best_model"), F.max("score").alias("best_score"))
    b_row = bs.first()  # one scalar: the blend's AUC
    return best.select("best_model", r("best_score"), r(F.lit(b_row["score"]), "blend_score"),
                       r(F.lit(b_row["score"]) - F.col("best_score"), "gain"))


@workload("output_postprocess", f"""
WITH {_MC_SQL}
SELECT p.o_orderkey, round(greatest(least(pred[1], 1 - 1e-6), 1e-6), 6) AS proba_f,
       (['F', 'O', 'P'])[least(list_position(pred, list_max(pred)), 3)] AS label,
       CASE WHEN pred[1] > 0.5 THEN 'yes' ELSE 'no' END AS binary_label
FROM p
""")
def output_postprocess(spark, d):
    """Probability clipping, argmax → sorted label domain, and threshold →
    two-label domain, applied to 3-class probability vectors."""
    p = multiclass_preds(spark, d, folds=False)
    domain = O.label_table(table(spark, d, "orders"), "o_orderstatus")
    answers = spark.createDataFrame([("no", 0), ("yes", 1)], "label string, index long")
    out = p.select("o_orderkey", F.col("pred").alias("label"), F.col("pred")[0].alias("proba_f"), F.col("pred")[0].alias("binary_label"))
    out = O.postprocess(out, "proba_f", "proba")
    out = O.postprocess(out, "binary_label", "label", answers)
    out = O.postprocess(out, "label", "label", domain)
    return out.select("o_orderkey", r("proba_f"), "label", "binary_label")


@workload("output_build", f"""
WITH {_MC_SQL},
s AS (SELECT o_orderkey, o_orderstatus FROM orders)
SELECT s.o_orderkey, (['F', 'O', 'P'])[least(list_position(pred, list_max(pred)), 3)] AS o_orderstatus
FROM s LEFT JOIN p ON s.o_orderkey = p.o_orderkey
""")
def output_build(spark, d):
    """Prediction output in the sample's rows and columns (every order):
    argmax labels joined on the id (not by position)."""
    sample = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    domain = O.label_table(table(spark, d, "orders"), "o_orderstatus")
    preds = O.postprocess(multiclass_preds(spark, d, folds=False).select("o_orderkey", "pred"), "pred", "label", domain)
    out = O.build_output(sample, preds, "o_orderkey", ["o_orderstatus"])
    return out


@workload("output_value_metric", """
SELECT o_orderkey, round(o_totalprice, 6) AS pred FROM orders
""")
def output_value_metric(spark, d):
    """Predictions under a value metric leave post-processing unchanged."""
    p = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("pred"))
    return O.postprocess(p, "pred", "value").select("o_orderkey", r("pred"))


@workload("output_validate", """
WITH s AS (SELECT o_orderkey, o_totalprice FROM orders),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM s)
SELECT false AS column_mismatch, CAST(0 AS BIGINT) AS row_count_diff,
       (SELECT count(*) FROM o WHERE o_totalprice IS NULL OR isnan(o_totalprice)) AS null_or_nan_cells,
       CAST(0 AS BIGINT) AS infinite_cells, CAST(0 AS BIGINT) AS ids_missing, CAST(0 AS BIGINT) AS ids_extra
""")
def output_validate(spark, d):
    """Validation report (column order, row count, NULL/NaN and infinite
    cells, id sets both ways) of a value output with some missing predictions."""
    sample = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    preds = sample.select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, None)
                          .otherwise(F.col("o_totalprice")).alias("pred"))
    out = O.build_output(sample, preds, "o_orderkey", ["o_totalprice"])
    return O.validation_report(out, sample, "o_orderkey")


@workload("output_validate_labels", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 13 > 0)
SELECT false AS column_mismatch, CAST(0 AS BIGINT) AS row_count_diff, (SELECT count(*) FROM orders) - (SELECT count(o_orderstatus) FROM o) AS null_or_nan_cells,
       CAST(0 AS BIGINT) AS infinite_cells, CAST(0 AS BIGINT) AS ids_missing, CAST(0 AS BIGINT) AS ids_extra
""")
def output_validate_labels(spark, d):
    """Validation report of a label output: ids without a prediction and
    predictions without a label both leave an empty cell."""
    sample = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    preds = sample.filter("o_orderkey % 13 > 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderstatus")).alias("pred"))
    return O.validation_report(O.build_output(sample, preds, "o_orderkey", ["o_orderstatus"]), sample, "o_orderkey")


_HIST_SQL = """
h AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS iteration,
             'out_' || CAST(event_id AS VARCHAR) AS path, value / 100.0 AS cv_score,
             (value + (event_id % 7) - 3) / 100.0 AS public_score, ts, event_id FROM events)"""


_BEST_GAP_SQL = f"""
WITH {_HIST_SQL},
b AS (SELECT run_id, arg_max(path, cv_score) AS path, max(cv_score) AS cv_score FROM h GROUP BY 1),
g AS (SELECT run_id, count(*) FILTER (WHERE abs(public_score - cv_score) > 0.01) AS n_gap,
             round(avg(public_score - cv_score), 6) AS mean_delta FROM h GROUP BY 1)
SELECT b.run_id, b.path, round(b.cv_score, 6) AS cv_score, g.n_gap, g.mean_delta FROM b JOIN g ON b.run_id = g.run_id
"""


@workload("history_best_gap", _BEST_GAP_SQL)
def history_best_gap(spark, d):
    """Best output per run by CV score (higher is better) and CV-vs-public
    gap flags, over a history table derived from events."""
    return _best_gap(_history(spark, d))


def _best_gap(h):
    best = H.best_output(h, higher_is_better=True)
    gaps = H.score_gap(h).groupBy("run_id").agg(F.count(F.when(F.col("gap_flag"), 1)).alias("n_gap"),
                                                 r(F.avg("delta"), "mean_delta"))
    return best.join(gaps, "run_id").select("run_id", "path", r("cv_score"), "n_gap", "mean_delta")


def _history(spark, d):
    from foldwise.operators.ordering import with_position

    # stand-in history rows: one run per user, iterations numbered in event
    # time order with distributed positions (no per-user window)
    e = with_position(table(spark, d, "events").select("event_id", "ts", "user_id", "value"),
                      ["ts", "event_id"], "_it", partition_by=["user_id"])
    return e.select(F.col("user_id").alias("run_id"), (F.col("_it") + 1).cast("bigint").alias("iteration"),
                    F.concat(F.lit("out_"), F.col("event_id").cast("string")).alias("path"),
                    (F.col("value") / 100.0).alias("cv_score"),
                    ((F.col("value") + (F.col("event_id") % 7) - 3) / 100.0).alias("public_score"),
                    "ts", "event_id")


@workload("history_log", _BEST_GAP_SQL)
def history_log(spark, d):
    """The same answers from an append-only log of outputs: the rows of an
    attempt cut short (other scores), then of the attempt that replaced it,
    written twice; readers see each (run, iteration) once, as last written."""
    from foldwise.sources.logs import append_log, read_log
    from foldwise.workloads.io import _scratch

    h = _history(spark, d)
    path = f"{_scratch(spark)}/outputs"
    append_log(h.filter("iteration % 3 = 0").withColumn("cv_score", F.col("cv_score") + 1000.0), path)
    append_log(h, path)
    append_log(h, path)
    return _best_gap(read_log(spark, path, ["run_id", "iteration"]))


@workload("history_reentry_budget", f"""
WITH {_HIST_SQL},
st AS (SELECT run_id, iteration, public_score - cv_score AS delta, cv_score AS blend_score,
              cv_score + ((event_id % 5) - 2) / 1000.0 AS best_solo, event_id % 2 AS followups FROM h),
l AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) = 1),
dec AS (SELECT run_id, iteration,
               CASE WHEN iteration + 1 < 1000 THEN
                 CASE least(CASE WHEN abs(delta) > 0.01 THEN 5 END, CASE WHEN abs(blend_score - best_solo) < 0.002 THEN 6 END,
                            CASE WHEN followups > 0 THEN 3 END)
                   WHEN 3 THEN '3' WHEN 5 THEN '5b' WHEN 6 THEN '6' END END AS reentry_phase FROM l),
bud AS (SELECT run_id, count(*) FILTER (WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM h)) AS used FROM h GROUP BY 1)
SELECT dec.run_id, dec.iteration, dec.reentry_phase,
       CAST(greatest(0, least(5, (dec.run_id % 7) + 1) - bud.used) AS BIGINT) AS remaining
FROM dec JOIN bud ON dec.run_id = bud.run_id
""")
def history_reentry_budget(spark, d):
    """Re-entry decision from each run's latest state (gap → 5b, small blend
    gain → 6, follow-ups → 3, lowest wins, none past the iteration budget)
    and the remaining output budget for the last day."""
    h = _history(spark, d)
    st = h.select("run_id", "iteration", (F.col("public_score") - F.col("cv_score")).alias("delta"),
                  F.col("cv_score").alias("blend_score"),
                  (F.col("cv_score") + ((F.col("event_id") % 5) - 2) / 1000.0).alias("best_solo"),
                  (F.col("event_id") % 2).alias("followups"))
    dec = H.reentry_decision(st, max_iterations=1000)
    last_day = h.agg(F.max(F.to_date("ts"))).first()[0]
    used = h.groupBy("run_id").agg(F.count(F.when(F.to_date("ts") == F.lit(last_day), 1)).alias("used"))
    out = dec.join(used, "run_id").withColumn(
        "remaining", H.remaining_budget(F.lit(5), (F.col("run_id") % 7) + 1, F.col("used")).cast("bigint"))
    return out.select("run_id", "iteration", "reentry_phase", "remaining")
