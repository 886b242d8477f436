"""Fold assignment (shuffled, stratified, forward-chaining, contiguous).

Folds are a ``(row_id, fold)`` column computed from distributed positions, so
no step puts a whole table (or a whole class) into one task:

* shuffled K-fold: position in ``md5('<seed>:<row_id>')`` order, ``pos % k``
  (ranked inside buckets of the hash's first digits, nothing sorted globally);
* stratified: the same position counted within each class;
* forward chaining: ``t = n div (k+1)``; fold i validates positions
  ``[n-(k-i)t, n-(k-i-1)t)``; the first ``n-k*t`` rows are never validated
  (fold NULL) and fold i trains on every earlier position;
* contiguous (unshuffled): ``ntile``-style blocks over the row order, within
  each class for classification.

The md5 ordering is reproducible in any SQL engine, which is what lets an
independent engine recompute the same folds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordering import with_hash_position, with_position

KFOLD = "kfold"
STRATIFIED = "stratified"
FORWARD = "forward"
CONTIGUOUS = "contiguous"


def shuffle_key(row_id: str, seed: int) -> Column:
    """Deterministic pseudo-random order key shared with the SQL oracle."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")))


def _ntile(pos: Column, n: Column, k: int) -> Column:
    """0-based ntile(k) of a 0-based position among n rows: the first n % k
    tiles get one extra row (same allocation as unshuffled K-fold)."""
    q = F.floor(n / k)
    r = n % k
    big = r * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - big) / F.greatest(q, F.lit(1))))


def assign_folds(df: DataFrame, row_id: str, k: int = 5, kind: str = KFOLD, seed: int = 42,
                 y: str | None = None, order_by: Sequence[str] | None = None,
                 fold_col: str = "fold") -> DataFrame:
    """Return ``df`` with an INT ``fold_col``.

    ``kind``: ``kfold`` (shuffled), ``stratified`` (shuffled within ``y``),
    ``forward`` (time-ordered by ``order_by``, default the row id) or
    ``contiguous`` (unshuffled blocks; within ``y`` when given).  Positions
    are computed on the ``(row_id, y, order_by)`` projection only; other
    columns are joined back by the (unique) row id."""
    if k < 2:
        raise ValueError("need at least 2 folds")
    needed = list(dict.fromkeys([row_id, *([y] if y else []), *(order_by or [])]))
    if set(df.columns) - set(needed):
        # number only the narrow key projection and join the fold back by row id
        folds = assign_folds(df.select(*needed), row_id, k, kind, seed, y, order_by, fold_col)
        return df.join(folds.select(row_id, fold_col), row_id, "inner")
    if kind == KFOLD:
        out = with_hash_position(df, shuffle_key(row_id, seed), row_id, "_fw_fpos")
        fold = F.col("_fw_fpos") % k
    elif kind == STRATIFIED:
        if not y:
            raise ValueError("stratified folds need the target column")
        out = with_hash_position(df, shuffle_key(row_id, seed), row_id, "_fw_fpos", partition_by=[y])
        fold = F.col("_fw_fpos") % k
    elif kind == FORWARD:
        order = list(order_by or [row_id])
        if row_id not in order:
            order.append(row_id)
        out = with_position(df, order, "_fw_fpos", size_col="_fw_n")
        t = F.floor(F.col("_fw_n") / (k + 1))
        first = F.col("_fw_n") - t * k
        fold = F.when((t > 0) & (F.col("_fw_fpos") >= first),
                      F.floor((F.col("_fw_fpos") - first) / F.greatest(t, F.lit(1))))
    elif kind == CONTIGUOUS:
        order = list(order_by or [row_id])
        if row_id not in order:
            order.append(row_id)
        out = with_position(df, order, "_fw_fpos", partition_by=[y] if y else [],
                            size_col="_fw_n")
        fold = _ntile(F.col("_fw_fpos"), F.col("_fw_n"), k)
    else:
        raise ValueError(f"unknown fold kind {kind!r}")
    return out.withColumn(fold_col, fold.cast("int")).drop("_fw_fpos", "_fw_n")


def choose_fold_kind(task_kind: str, is_time_series: bool) -> str:
    """Time series → forward chaining; classification → stratified; else K-fold."""
    if is_time_series:
        return FORWARD
    return STRATIFIED if task_kind == "classification" else KFOLD


def fit_mask(fold: Column, fit_fold: Column, kind: str) -> Column:
    """True when a row with validation fold ``fold`` is a training row of
    ``fit_fold``: every other fold, or (forward chaining) every earlier row."""
    if kind == FORWARD:
        return F.coalesce(fold, F.lit(-1)) < fit_fold
    return fold.isNull() | (fold != fit_fold)
