"""Run-history queries over tables instead of an in-memory state object.

Tables: ``outputs(run_id, iteration, ts, path, cv_score, public_score)``,
``cv_results(run_id, model, oof_score, status, ...)`` and
``errors(run_id, phase, error_type, message)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values that must equal the reference.
GAP_THRESHOLD = 0.01        # |public - cv| above this re-enters training
MIN_BLEND_GAIN = 0.002      # blend barely better than best solo re-enters blending
PHASE_TRAIN, PHASE_BLEND, PHASE_FEATURES = (5, "5b"), (6, "6"), (3, "3")


def best_output(outputs: DataFrame, higher_is_better: bool, by: str = "run_id") -> DataFrame:
    """Best output per run by CV score, in the metric's direction."""
    pick = F.max_by if higher_is_better else F.min_by
    best = F.max("cv_score") if higher_is_better else F.min("cv_score")
    return outputs.groupBy(by).agg(pick("path", "cv_score").alias("path"), best.alias("cv_score"))


def score_gap(outputs: DataFrame) -> DataFrame:
    """``delta = public - cv`` and ``gap_flag = |delta| > 0.01``."""
    delta = F.col("public_score") - F.col("cv_score")
    return outputs.withColumn("delta", delta).withColumn("gap_flag", F.coalesce(F.abs(delta) > GAP_THRESHOLD, F.lit(False)))


def remaining_budget(limit_a: Column, limit_b: Column, used: Column) -> Column:
    """``max(0, min(limits) - used)``."""
    return F.greatest(F.lit(0), F.least(limit_a, limit_b) - used)


def reentry_decision(state: DataFrame, max_iterations: int) -> DataFrame:
    """Per run, from its latest state row (``run_id, iteration, delta,
    blend_score, best_solo, followups``): the lowest-numbered phase whose
    trigger fires — CV/public gap → 5b, blend gain below 0.002 → 6, pending
    feature follow-ups → 3 — or NULL when none fires or the iteration budget
    is spent."""
    cols = [c for c in state.columns if c != "run_id"]
    latest = state.groupBy("run_id").agg(F.max_by(F.struct(*cols), "iteration").alias("_l")).select("run_id", "_l.*")
    gap = F.coalesce(F.abs(F.col("delta")) > GAP_THRESHOLD, F.lit(False))
    gain = F.coalesce(F.abs(F.col("blend_score") - F.col("best_solo")) < MIN_BLEND_GAIN, F.lit(False))
    follow = F.coalesce(F.col("followups") > 0, F.lit(False))
    code = F.least(F.when(gap, PHASE_TRAIN[0]), F.when(gain, PHASE_BLEND[0]), F.when(follow, PHASE_FEATURES[0]))
    label = (F.when(code == PHASE_FEATURES[0], PHASE_FEATURES[1]).when(code == PHASE_TRAIN[0], PHASE_TRAIN[1])
             .when(code == PHASE_BLEND[0], PHASE_BLEND[1]))
    budget_left = F.col("iteration") + 1 < F.lit(max_iterations)
    return latest.select("run_id", "iteration", F.when(budget_left, label).alias("reentry_phase"))


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("phase", "error_type").agg(F.count(F.lit(1)).alias("n"))


def token_totals(calls: DataFrame) -> DataFrame:
    """Tokens spent per run and phase from a log of calls (``run_id, phase,
    tokens_in, tokens_out``); missing counts are zero."""
    return calls.groupBy("run_id", "phase").agg(
        F.sum(F.coalesce("tokens_in", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("tokens_out", F.lit(0))).alias("tokens_out"),
        F.count(F.lit(1)).alias("n_calls")).withColumn("tokens", F.col("tokens_in") + F.col("tokens_out"))
