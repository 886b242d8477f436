"""Search, model ranking, pruning, fold averages, blend choice, metric names
and token totals over tables.

The driver tables carry no trial, result or call log.  Stand-in rows are
built one by one from events, suppliers, parts and conversations; sampling,
best trials, the early-stop rule, running bests, ranks, pruning, averages and
choices run through the library on them.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwise.functions.metrics import ALIASES, METRICS, SUBSTRING_RULES, resolve_metric_col
from foldwise.operators import blend as B
from foldwise.operators import history as H
from foldwise.operators.train import average_predictions
from foldwise.plans import search as S
from foldwise.workloads.common import r, table, workload

SPACE = {"n_estimators": {"type": "int", "low": 200, "high": 2000},
         "learning_rate": {"type": "float", "low": 0.005, "high": 0.3, "log": True},
         "subsample": {"type": "float", "low": 0.5, "high": 1.0},
         "max_features": {"type": "categorical", "choices": ["sqrt", "log2"]}}


@workload("search_sample_trials", """
WITH s AS (SELECT s_suppkey AS run_id, s_suppkey % 7 AS seed, 1 + s_nationkey % 4 AS n FROM supplier),
t AS (SELECT run_id, seed, unnest(range(0, n)) AS trial FROM s),
p(param) AS (VALUES ('n_estimators'), ('learning_rate'), ('subsample'), ('max_features')),
u AS (SELECT run_id, trial, param, CAST('0x' || substr(md5(concat_ws(':', seed, trial, param)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM t, p)
SELECT run_id, CAST(trial AS INTEGER) AS trial, param,
       round(CASE param WHEN 'n_estimators' THEN floor(200 + u * 1801) WHEN 'learning_rate' THEN exp(ln(0.005) + u * (ln(0.3) - ln(0.005)))
                  WHEN 'subsample' THEN 0.5 + u * 0.5 END, 6) AS value,
       CASE WHEN param = 'max_features' THEN (['"sqrt"', '"log2"'])[CAST(floor(u * 2) AS INTEGER) + 1] END AS choice
FROM u
""")
def search_sample_trials(spark, d):
    """Parameter samples of one search per supplier (seed and number of
    trials from its row): ints, log-uniform and uniform floats, choices."""
    searches = table(spark, d, "supplier").select(F.col("s_suppkey").alias("run_id"), (F.col("s_suppkey") % 7).alias("seed"), (1 + F.col("s_nationkey") % 4).alias("n_trials"))
    t = S.sample_searches(searches, SPACE)
    text = F.col("param") == "max_features"
    return t.select("run_id", "trial", "param", r(F.when(~text, F.col("value").try_cast("double")), "value"), F.when(text, F.col("value")).alias("choice"))


_TRIALS_SQL = """
t AS (SELECT user_id AS model, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS trial, value AS score FROM events)"""


def _trials(spark, d):
    # stand-in search log: one search per user, its events are the trials
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("model"), (F.row_number().over(w) - 1).alias("trial"), F.col("value").alias("score"))


@workload("search_best_trial", f"""
WITH {_TRIALS_SQL},
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY model ORDER BY score DESC, trial) = 1)
SELECT model, CAST(trial AS INTEGER) AS best_trial, round(score, 6) AS best_score FROM b
""")
def search_best_trial(spark, d):
    """Best trial of every search, ties to the first."""
    return S.best_trial(_trials(spark, d), True).select("model", F.col("best_trial").cast("int").alias("best_trial"), r("best_score"))


@workload("search_early_stop", f"""
WITH {_TRIALS_SQL},
f AS (SELECT model, median(score) AS m, count(*) AS n FROM t WHERE trial < 10 GROUP BY 1),
p AS (SELECT c_custkey AS model, abs(c_acctbal) / 100.0 AS prior FROM customer)
SELECT f.model, round(m, 6) AS median10, coalesce(n >= 10 AND prior IS NOT NULL AND m < prior * 0.85, false) AS pruned_early FROM f LEFT JOIN p USING (model)
""")
def search_early_stop(spark, d):
    """Early-stop rule of every search against a prior best score taken from
    the customer of that number."""
    prior = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), (F.abs("c_acctbal") / 100.0).alias("prior_best"))
    return S.early_stop_flags(_trials(spark, d), prior, True).select("model", r("median10"), "pruned_early")


@workload("search_rank_models", """
WITH s AS (SELECT s_nationkey AS run_id, s_suppkey AS model, CASE WHEN s_suppkey % 5 > 0 THEN s_acctbal END AS oof FROM supplier)
SELECT run_id, model, round(max(oof) OVER (PARTITION BY run_id ORDER BY model ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS best_prior,
       CAST(rank() OVER (PARTITION BY run_id ORDER BY oof DESC NULLS LAST) AS INTEGER) AS rank FROM s
""")
def search_rank_models(spark, d):
    """Best score so far and final rank of every model of a run (run =
    nation, model = supplier; some models have no score)."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("model"), F.when(F.col("s_suppkey") % 5 > 0, F.col("s_acctbal")).alias("oof_score"))
    both = S.rank_models(S.best_so_far(s, True, order="model"), True)
    return both.select("run_id", "model", r("best_prior"), F.col("rank").cast("int").alias("rank"))


@workload("search_prune_features", """
WITH i AS (SELECT p_size AS dataset, 'f' || CAST(p_partkey AS VARCHAR) AS feature, p_retailprice AS importance FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY importance DESC, feature) AS position FROM i)
SELECT dataset, feature, round(importance, 6) AS importance, CAST(position AS INTEGER) AS position FROM k WHERE position <= 7
""")
def search_prune_features(spark, d):
    """The seven most important features of every dataset (dataset = part
    size, feature = part; the limit is the feature)."""
    i = table(spark, d, "part").select(F.col("p_size").alias("dataset"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature"), F.col("p_retailprice").alias("importance"))
    return S.prune_features(i, 7).select("dataset", "feature", r("importance"), "position")


@workload("fold_averaged_test", """
WITH p AS (SELECT o_orderkey AS row_id, f AS fold, ((o_custkey * (f + 3)) % 101) / 100.0 AS pred FROM orders, (VALUES (0), (1), (2), (3), (4)) t(f))
SELECT row_id, round(avg(pred), 6) AS pred, round(avg(1 - pred), 6) AS pred_other FROM p GROUP BY 1
""")
def fold_averaged_test(spark, d):
    """Mean over five fold models' predictions of every row, for scalars and
    for class vectors."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_custkey", F.explode(F.array(*[F.lit(f) for f in range(5)])).alias("fold"))
    p = o.select("row_id", "fold", ((F.col("o_custkey") * (F.col("fold") + 3)) % 101 / 100.0).alias("pred"))
    scalar = average_predictions(p)
    vector = average_predictions(p.withColumn("pred", F.array(F.col("pred"), 1 - F.col("pred")))).select("row_id", F.col("pred")[1].alias("other"))
    return scalar.join(vector, "row_id").select("row_id", r("pred"), r("other", "pred_other"))


_NAMES = ["RMSE", "Root Mean Squared Error", "rootmeansquarederror", "Mean Absolute Error", "R2 score", "ROC AUC", "Area Under The Curve", "Log Loss",
          "logarithmic loss", "Cross Entropy", "Mean F1", "Categorization Accuracy", " f1 ", "quadratic kappa", ""]


def _metric_sql() -> str:
    key = "replace(lower(trim(coalesce(m, ''))), ' ', '')"
    whens = [f"WHEN {key} = '{a}' THEN '{m}'" for a, m in ALIASES.items()] + [f"WHEN {key} = '{m}' THEN '{m}'" for m in METRICS]
    whens += [f"WHEN contains({key}, '{n}') THEN '{m}'" for n, m in SUBSTRING_RULES]
    names = ", ".join(f"'{n}'" for n in _NAMES)
    return f"""
WITH t AS (SELECT event_id, ([{names}])[event_id % {len(_NAMES)} + 1] AS m, CASE WHEN user_id % 2 = 0 THEN 'regression' ELSE 'classification' END AS k FROM events)
SELECT event_id, CASE {" ".join(whens)} WHEN k = 'regression' THEN 'rmse' ELSE 'auc' END AS metric FROM t"""


@workload("metric_names", _metric_sql())
def metric_names(spark, d):
    """Free-text metric names of a table of tasks resolved to metrics."""
    names = F.array(*[F.lit(n) for n in _NAMES])
    t = table(spark, d, "events").select("event_id", F.element_at(names, (F.col("event_id") % len(_NAMES) + 1).cast("int")).alias("m"),
                                         F.when(F.col("user_id") % 2 == 0, "regression").otherwise("classification").alias("k"))
    return t.select("event_id", resolve_metric_col(F.col("m"), F.col("k")).alias("metric"))


_METHODS_SQL = "(['weighted_average', 'rank_average', 'stacking', 'none', 'median'])"


@workload("blend_method_choice", f"""
WITH q AS (SELECT c_custkey AS dataset, {_METHODS_SQL}[c_custkey % 5 + 1] AS asked FROM customer),
p AS (SELECT o_custkey AS dataset, o_orderkey % 4 AS model, o_orderkey % 3 AS k, 1 + (o_custkey % 2) * 2 AS width FROM orders),
m AS (SELECT dataset, model, max(CASE WHEN k > 0 THEN 1 ELSE 0 END) AS oof, max(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS tst, max(width) AS width FROM p GROUP BY 1, 2),
h AS (SELECT dataset, count(*) AS n, min(tst) AS t, max(width) AS width FROM m WHERE oof = 1 GROUP BY 1)
SELECT q.dataset, CASE WHEN coalesce(n, 0) < 2 OR asked = 'none' THEN 'none' WHEN asked = 'stacking' AND t = 1 THEN 'stacking'
       WHEN asked = 'rank_average' AND width = 1 THEN 'rank_average' ELSE 'weighted_average' END AS method
FROM q LEFT JOIN h ON q.dataset = h.dataset
""")
def blend_method_choice(spark, d):
    """The blend that every dataset (customer) gets of the one it asks for,
    from what its predictions (orders) hold."""
    names = F.array(*[F.lit(m) for m in ("weighted_average", "rank_average", "stacking", "none", "median")])
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("dataset"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("requested"))
    held = table(spark, d, "orders").select(F.col("o_custkey").alias("dataset"), F.when(F.col("o_orderkey") % 3 > 0, "oof").otherwise("fold_test").alias("kind"),
                                            (F.col("o_orderkey") % 4).alias("model"), (1 + (F.col("o_custkey") % 2) * 2).alias("width"))
    return B.choose_methods(asked, held)


@workload("blend_best_models", """
WITH s AS (SELECT o_custkey AS dataset, o_orderpriority AS model, avg(o_totalprice) AS score FROM orders GROUP BY 1, 2)
SELECT dataset, model, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY score, model) = 1
""")
def blend_best_models(spark, d):
    """Best single model of every dataset (customer), lower scores first;
    models are order priorities, scores their mean totals."""
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("dataset"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("score"))
    return B.best_models(s, False).select("dataset", "model", r("score"))


@workload("token_totals", """
SELECT conv_id AS run_id, role AS phase, CAST(sum(CAST(ceil(coalesce(length(text), 0) / 4.0) AS BIGINT)) AS BIGINT) AS tokens_in, CAST(sum(turn) AS BIGINT) AS tokens_out,
       count(*) AS n_calls, CAST(sum(CAST(ceil(coalesce(length(text), 0) / 4.0) AS BIGINT)) + sum(turn) AS BIGINT) AS tokens
FROM conversations GROUP BY 1, 2
""")
def token_totals(spark, d):
    """Token totals per run and phase of a call log (run = conversation,
    phase = role, one call per turn)."""
    c = table(spark, d, "conversations")
    calls = c.select(F.col("conv_id").alias("run_id"), F.col("role").alias("phase"), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4.0).cast("bigint").alias("tokens_in"),
                     F.col("turn").cast("bigint").alias("tokens_out"))
    return H.token_totals(calls)
