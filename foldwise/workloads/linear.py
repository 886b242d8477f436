"""Linear learners from fold statistics, with SQL: ridge by normal equations,
logistic regression by Newton steps written out, and stacking of ridge models.
The SQL solves systems of two features by Cramer's rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import linear
from foldwise.operators.folds import KFOLD, assign_folds
from foldwise.operators.train import prepare_folds, run_cv, stacking
from foldwise.workloads.common import is_test, r, table, workload

#: Fewer digits than elsewhere: predictions come from different orders of summation.
DIGITS = 4
#: orders: prices in thousands, and three numbers to learn from.
_ORDERS = """l AS (SELECT o_orderkey AS row_id, o_orderkey % 5 = 4 AS test, o_totalprice / 1000 AS y, CAST(o_custkey % 50 AS DOUBLE) AS customer_part, CAST(month(o_orderdate) AS DOUBLE) / 100 AS month_part,
  CAST(left(o_orderpriority, 1) AS DOUBLE) / 10 AS priority_part, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS finished FROM orders),
tr AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) - 1) % 5 AS fold FROM l WHERE NOT test),
te AS (SELECT * FROM l WHERE test)"""


def _orders(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), is_test("o_orderkey").alias("test"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") % 50).cast("double").alias("customer_part"),
        (F.month("o_orderdate") / 100).alias("month_part"), (F.substring("o_orderpriority", 1, 1).cast("double") / 10).alias("priority_part"), (F.col("o_orderstatus") == "F").cast("int").alias("finished"))
    return assign_folds(o.filter(~F.col("test")), "row_id", k=5, kind=KFOLD), o.filter("test")


def ridge_sql(name: str, rows: str, y: str, a: str, b: str, alpha: float, folds: str = "range(6)") -> str:
    """CTEs ``<name>_m(fit_fold, icept, ca, cb)``: the ridge of ``y`` on two columns of ``rows`` by fit fold; fold 5, which
    no row has, is the fit on all rows."""
    return f"""
{name}_s AS (SELECT fold, count(*) AS n, sum({a}) AS sa, sum({b}) AS sb, sum({y}) AS sy, sum({a} * {a}) AS saa, sum({a} * {b}) AS sab, sum({b} * {b}) AS sbb, sum({a} * {y}) AS say, sum({b} * {y}) AS sby FROM {rows} GROUP BY fold),
{name}_t AS (SELECT f AS fit_fold, sum(n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(sy) AS sy, sum(saa) AS saa, sum(sab) AS sab, sum(sbb) AS sbb, sum(say) AS say, sum(sby) AS sby FROM {name}_s, (SELECT unnest({folds}) AS f) WHERE fold <> f GROUP BY f),
{name}_c AS (SELECT *, saa - sa * sa / n + {alpha} AS aa, sab - sa * sb / n AS ab, sbb - sb * sb / n + {alpha} AS bb, say - sa * sy / n AS ay, sby - sb * sy / n AS byy FROM {name}_t),
{name}_w AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM {name}_c),
{name}_m AS (SELECT fit_fold, ca, cb, (sy - ca * sa - cb * sb) / n AS icept FROM {name}_w)"""


@workload("train_cv_ridge", f"""
WITH {_ORDERS}, {ridge_sql("g", "tr", "y", "customer_part", "month_part", 50.0)}
SELECT row_id, 'oof' AS kind, CAST(fold AS INTEGER) AS fold, round(icept + ca * customer_part + cb * month_part, {DIGITS}) AS pred FROM tr JOIN g_m ON fit_fold = fold
UNION ALL SELECT row_id, 'fold_test', NULL, round(avg(icept + ca * customer_part + cb * month_part), {DIGITS}) FROM te, g_m WHERE fit_fold < 5 GROUP BY row_id
""")
def train_cv_ridge(spark, d):
    """Five-fold ridge of the total on two numbers of the order (alpha 50) from
    one scan of products: out-of-fold predictions of the train role and the
    fold models' mean predictions of the test role."""
    train, test = _orders(spark, d)
    res = run_cv(train, "row_id", "y", ["customer_part", "month_part"], "Ridge", {"alpha": 50.0}, "regression", 0, k=5, test=test)
    oof = res.oof.select("row_id", F.lit("oof").alias("kind"), "fold", F.round("pred", DIGITS).alias("pred"))
    return oof.unionByName(res.fold_test.select("row_id", F.lit("fold_test").alias("kind"), F.lit(None).cast("int").alias("fold"), F.round("pred", DIGITS).alias("pred")))


_STRENGTH = 0.01
_STEPS = 9


def newton_sql() -> str:
    """Newton steps of the penalised logistic regression of ``finished`` on two columns, one CTE a step, over
    the counts of equal rows; three unknowns by Cramer's rule."""
    p = "1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2)))"
    out = f"""c AS (SELECT fold, customer_part AS x1, month_part AS x2, count(*) AS n, sum(finished) AS k FROM tr GROUP BY ALL),
u AS (SELECT f AS fit_fold, x1, x2, sum(n) AS n, sum(k) AS k FROM c, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY ALL),
b0_ AS (SELECT DISTINCT fit_fold, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM u)"""
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    h = ["h00", "h01", "h02", "h01", "h11", "h12", "h02", "h12", "h22"]
    column = lambda j: det([f"g{i // 3}" if i % 3 == j else h[i] for i in range(9)])
    for s in range(_STEPS):
        out += f""",
q{s} AS (SELECT fit_fold, b0, b1, b2, n, k, x1, x2, {p} AS p FROM u JOIN b{s}_ USING (fit_fold)),
d{s} AS (SELECT fit_fold, b0, b1, b2, {_STRENGTH} * sum(n * p - k) AS g0, b1 + {_STRENGTH} * sum((n * p - k) * x1) AS g1, b2 + {_STRENGTH} * sum((n * p - k) * x2) AS g2,
  {_STRENGTH} * sum(n * p * (1 - p)) AS h00, {_STRENGTH} * sum(n * p * (1 - p) * x1) AS h01, {_STRENGTH} * sum(n * p * (1 - p) * x2) AS h02,
  1 + {_STRENGTH} * sum(n * p * (1 - p) * x1 * x1) AS h11, {_STRENGTH} * sum(n * p * (1 - p) * x1 * x2) AS h12, 1 + {_STRENGTH} * sum(n * p * (1 - p) * x2 * x2) AS h22 FROM q{s} GROUP BY fit_fold, b0, b1, b2),
b{s + 1}_ AS (SELECT fit_fold, b0 - {column(0)} / {det(h)} AS b0, b1 - {column(1)} / {det(h)} AS b1, b2 - {column(2)} / {det(h)} AS b2 FROM d{s})"""
    return out


@workload("train_logistic_newton", f"""
WITH {_ORDERS}, {newton_sql()}
SELECT row_id, CAST(fold AS INTEGER) AS fold, round(1 / (1 + exp(-(b0 + b1 * customer_part + b2 * month_part))), 6) AS pred FROM tr JOIN b{_STEPS}_ ON fit_fold = fold
UNION ALL SELECT -1 - fit_fold, NULL, round(v, 6) FROM (SELECT fit_fold, unnest([b0, b1, b2]) AS v FROM b{_STEPS}_)
""")
def train_logistic_newton(spark, d):
    """Five-fold logistic regression of the order status on two of its
    numbers (C 0.01): out-of-fold probabilities, and each fold model's
    intercept and weights (negative ids)."""
    train, _ = _orders(spark, d)
    fd = prepare_folds(train, "row_id", "finished", ["customer_part", "month_part"], 5)
    models = linear.fit_folds(fd, "LogisticRegression", [{"C": _STRENGTH}], "classification")[0]
    oof = linear.out_of_fold(fd, models, "row_id").select("row_id", "fold", r("pred"))
    weights = [(-1 - f, float(v)) for f, m in enumerate(models) for v in (m.intercept, *m.coef)]
    return oof.unionByName(spark.createDataFrame(weights, "row_id long, pred double").select("row_id", F.lit(None).cast("int").alias("fold"), r("pred")))


_STACK_SQL = f"""
WITH {_ORDERS}, {ridge_sql("g", "tr", "y", "customer_part", "month_part", 1.0)}, {ridge_sql("h", "tr", "y", "month_part", "priority_part", 20.0)},
x AS (SELECT row_id, y, g_m.icept + g_m.ca * customer_part + g_m.cb * month_part AS pa, h_m.icept + h_m.ca * month_part + h_m.cb * priority_part AS pb, ntile(5) OVER (ORDER BY row_id) - 1 AS fold
  FROM tr JOIN g_m ON g_m.fit_fold = fold JOIN h_m ON h_m.fit_fold = fold),
{ridge_sql("s", "x", "y", "pa", "pb", 1.0)},
v AS (SELECT row_id, avg(g_m.icept + g_m.ca * customer_part + g_m.cb * month_part) AS pa, avg(h_m.icept + h_m.ca * month_part + h_m.cb * priority_part) AS pb FROM te, g_m JOIN h_m USING (fit_fold) WHERE fit_fold < 5 GROUP BY row_id)
SELECT row_id, 'oof' AS kind, round(icept + ca * pa + cb * pb, {DIGITS}) AS pred FROM x JOIN s_m ON fit_fold = fold
UNION ALL SELECT row_id, 'test', round(icept + ca * pa + cb * pb, {DIGITS}) FROM v, s_m WHERE fit_fold = 5"""


@workload("stacking_ridge", _STACK_SQL)
def stacking_ridge(spark, d):
    """Two ridge models of the total on different features; a ridge meta
    learner on their out-of-fold predictions: its own out-of-fold predictions
    from contiguous folds, and test predictions from the fold-averaged ones."""
    train, test = _orders(spark, d)
    results = []
    for name, feats, alpha in (("a", ["customer_part", "month_part"], 1.0), ("b", ["month_part", "priority_part"], 20.0)):
        res = run_cv(train, "row_id", "y", feats, "Ridge", {"alpha": alpha}, "regression", 0, k=5, test=test)
        results.append((res.oof.withColumn("model", F.lit(name)), res.fold_test.withColumn("model", F.lit(name))))
    (oof_a, test_a), (oof_b, test_b) = results
    meta_oof, meta_test = stacking(oof_a.unionByName(oof_b), test_a.unionByName(test_b), train.select("row_id", "y"), ["a", "b"], "row_id", "y", "regression", 0)
    out = meta_oof.select("row_id", F.lit("oof").alias("kind"), "pred").unionByName(meta_test.select("row_id", F.lit("test").alias("kind"), "pred"))
    return out.select("row_id", "kind", F.round("pred", DIGITS).alias("pred"))


_N_TRIALS = 50
_ALPHAS = f"""a AS (SELECT t AS trial, exp(ln(0.001) + (CAST('0x' || substr(md5('42:' || t || ':alpha'), 1, 13) AS BIGINT) / 4503599627370496.0) * (ln(100.0) - ln(0.001))) AS alpha
  FROM (SELECT unnest(range({_N_TRIALS})) AS t))"""


def trials_sql() -> str:
    """Root mean squared error of the out-of-fold predictions of every trial's ridge, from the folds' products."""
    return f"""
WITH {_ORDERS}, {_ALPHAS},
s AS (SELECT fold, count(*) AS n, sum(customer_part) AS sa, sum(month_part) AS sb, sum(y) AS sy, sum(customer_part * customer_part) AS saa, sum(customer_part * month_part) AS sab, sum(month_part * month_part) AS sbb,
  sum(customer_part * y) AS say, sum(month_part * y) AS sby FROM tr GROUP BY fold),
t AS (SELECT f AS fit_fold, sum(n) AS n, sum(sa) AS sa, sum(sb) AS sb, sum(sy) AS sy, sum(saa) AS saa, sum(sab) AS sab, sum(sbb) AS sbb, sum(say) AS say, sum(sby) AS sby FROM s, (SELECT unnest(range(5)) AS f) WHERE fold <> f GROUP BY f),
c AS (SELECT trial, fit_fold, n, sa, sb, sy, saa - sa * sa / n + alpha AS aa, sab - sa * sb / n AS ab, sbb - sb * sb / n + alpha AS bb, say - sa * sy / n AS ay, sby - sb * sy / n AS byy FROM t, a),
w AS (SELECT trial, fit_fold, n, sa, sb, sy, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS ca, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM c),
scores AS (SELECT trial, sqrt(avg(power(y - (sy - ca * sa - cb * sb) / n - ca * customer_part - cb * month_part, 2))) AS score FROM w JOIN tr ON fit_fold = fold GROUP BY trial)"""


@workload("search_ridge_trials", f"""{trials_sql()},
r AS (SELECT trial, score, 'all' AS search FROM scores UNION ALL SELECT trial, score, 'pruned' FROM scores WHERE trial < 10)
SELECT search, CAST(trial AS INTEGER) AS trial, round(score, {DIGITS}) AS score, CASE search WHEN 'all' THEN 'COMPLETE' ELSE 'PRUNED_EARLY' END AS status FROM r
""")
def search_ridge_trials(spark, d):
    """Two searches of fifty trials of ridge (log-uniform alpha) by the root
    mean squared error of out-of-fold predictions, read back from their trial
    table: one scored in batches from the same fold statistics; one run as
    concurrent jobs against a prior best that stops it after ten trials."""
    from foldwise.operators.metrics import score
    from foldwise.operators.models import SEARCH_SPACES
    from foldwise.operators.train import linear_scores
    from foldwise.plans import search as S
    from foldwise.plans.trials import TrialTable, search
    from foldwise.workloads.io import _scratch

    train, _ = _orders(spark, d)
    features = ["customer_part", "month_part"]
    fd = prepare_folds(train, "row_id", "y", features, 5)
    trials = S.trial_params(S.sample_trials(spark, SEARCH_SPACES["Ridge"], _N_TRIALS, seed=42))
    kept = TrialTable(spark, f"{_scratch(spark)}/trials")

    def one(params):
        oof = run_cv(train, "row_id", "y", features, "Ridge", params, "regression", 0, k=5, prepared=fd).oof
        return score(oof.join(fd.wide.select("row_id", "y"), "row_id").withColumn("g", F.lit(1)), "rmse", group_by=["g"]).first()["score"]

    whole = search(spark, trials, False, run_batch=lambda batch: linear_scores(fd, "Ridge", batch, "rmse", "regression"), table=kept, name="all")
    pruned = search(spark, trials, False, prior_best=min(whole.scores) / 2, run_trial=one, table=kept, name="pruned", parallelism=3)
    status = spark.createDataFrame([("all", whole.status), ("pruned", pruned.status)], "search string, status string")
    return kept.read().join(F.broadcast(status), "search").select("search", "trial", F.round("score", DIGITS).alias("score"), "status")  # two rows


@workload("permutation_importance", f"""
WITH l AS (SELECT o_orderkey AS row_id, o_totalprice / 1000 AS y, CAST(o_custkey % 50 AS DOUBLE) AS a, CAST(month(o_orderdate) AS DOUBLE) / 100 AS b FROM orders),
tr AS (SELECT *, (row_number() OVER (ORDER BY md5('42:' || CAST(row_id AS VARCHAR)), row_id) - 1) % 3 AS fold FROM l),
{ridge_sql("g", "tr", "y", "a", "b", 1.0, folds="range(3)")},
m AS (SELECT row_id, fold, y, a, b, row_number() OVER (PARTITION BY fold ORDER BY row_id) AS k FROM tr),
p AS (SELECT s AS rep, fold, a AS pa, b AS pb, row_number() OVER (PARTITION BY fold, s ORDER BY md5((42 + s) || ':' || CAST(row_id AS VARCHAR)), row_id) AS k FROM tr, (SELECT unnest(range(3)) AS s)),
e AS (SELECT m.fold, rep, sum(power(y - icept - ca * a - cb * b, 2)) AS e0, sum(power(y - icept - ca * pa - cb * b, 2)) AS ea, sum(power(y - icept - ca * a - cb * pb, 2)) AS eb, var_pop(y) * count(*) AS v
  FROM m JOIN p ON m.fold = p.fold AND m.k = p.k JOIN g_m ON fit_fold = m.fold GROUP BY m.fold, rep)
SELECT f AS feature, round(avg(CASE f WHEN 'a' THEN ea - e0 ELSE eb - e0 END / v), 8) AS importance FROM e, (VALUES ('a'), ('b')) t(f) GROUP BY f
""")
def permutation_importance(spark, d):
    """Importance probe of a learner without native importances: ridge on
    three folds, each feature permuted three times on each fold's own rows,
    by the drop of R2."""
    from foldwise.operators.train import probe_importance

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") % 50).cast("double").alias("a"), (F.month("o_orderdate") / 100).alias("b"))
    return probe_importance(o, "row_id", "y", ["a", "b"], "Ridge", "regression", 0).select("feature", F.round("importance", 8).alias("importance"))
