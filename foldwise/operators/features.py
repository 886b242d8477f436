"""Immediate feature operators: fit on train, apply to any frame.

Fitting is batched: every scalar statistic the plan needs (minimums for the
non-negativity guard, min/max for equal-width bins, distinct-count estimates,
the earliest timestamp) comes from ONE aggregate over train, and exact
quantiles for equal-frequency bins from ``ordering.quantiles``; value lookups (count encoding, common titles) are small grouped tables
joined back with a size-checked broadcast.  Application is one projection
plus those joins, and one block-halo window pass for lag / rolling mean.

An output is added to a frame only when the op's input columns exist there,
and an op that cannot be fitted (negative values for log/sqrt, a constant or
all-NULL column for equal-width bins, fewer than two distinct quantiles) adds
no column and is reported in ``skipped``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions import columns as C
from foldwise.operators.ordering import quantiles, with_trailing_window
from foldwise.operators.sketches import column_sketches, quantile_estimates
from foldwise.plans.spec import PLUGINS, FeatureOp, PlanError, Plugin
from foldwise.session import lookup_join, size_checked_broadcast


@dataclass
class _Lookup:
    op: FeatureOp
    table: DataFrame          # (_lk_key, _lk_val)
    key_expr: str             # "raw" or "title"
    small: bool               # checked small enough to broadcast


@dataclass
class _FittedPlugin:
    plugin: Plugin
    values: dict              # of a one-row table
    table: DataFrame | None   # of a keyed one
    small: bool

    def add(self, df: DataFrame, op: FeatureOp, i: int) -> DataFrame:
        """``df`` with the op's outputs; a keyed table is joined on the op's first column."""
        if self.table is None:
            return df.withColumns(self._outputs(op, {n: F.lit(v).cast(t) for n, (v, t) in self.values.items()}))
        tmp = f"_pl{i}_"
        key, *names = self.table.columns
        t = self.table.select(F.col(f"`{key}`").alias(f"{tmp}key"), *[F.col(f"`{n}`").alias(f"{tmp}{n}") for n in names])
        out = lookup_join(df, t, op.columns[0], f"{tmp}key", self.small)
        return out.withColumns(self._outputs(op, {n: F.col(f"`{tmp}{n}`") for n in names})).drop(f"{tmp}key", *[f"{tmp}{n}" for n in names])

    def _outputs(self, op: FeatureOp, stats: dict) -> dict[str, Column]:
        made = self.plugin.apply(op, stats)
        return made if isinstance(made, dict) else {op.output_name: made}


def _fit_plugin(plugin: Plugin, train: DataFrame, op: FeatureOp) -> _FittedPlugin:
    if plugin.fit is None:
        return _FittedPlugin(plugin, {}, None, True)
    table = plugin.fit(train, op)
    if plugin.keyed:
        key = table.columns[0]
        table, small = size_checked_broadcast(table.filter(F.col(f"`{key}`").isNotNull()))
        if not table.groupBy(F.col(f"`{key}`")).count().filter("count > 1").isEmpty():
            raise PlanError(f"{op.operation!r}: the statistics repeat a key")
        return _FittedPlugin(plugin, {}, table, small)
    rows = table.limit(2).collect()
    if len(rows) != 1:
        raise PlanError(f"{op.operation!r}: the statistics are not one row")
    return _FittedPlugin(plugin, {f.name: (rows[0][f.name], f.dataType) for f in table.schema.fields}, None, True)


@dataclass
class FittedFeatures:
    ops: list[FeatureOp]
    scalars: dict
    lookups: dict[str, _Lookup] = field(default_factory=dict)
    created: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    plugins: dict[str, _FittedPlugin] = field(default_factory=dict)

    def _expr(self, op: FeatureOp, i: int, dtypes: dict) -> dict[str, Column]:
        a = op.columns[0]
        s = self.scalars
        o = op.output_name
        if op.operation == "log_transform":
            return {o: C.log1p_or_null(a)}
        if op.operation == "sqrt_transform":
            return {o: C.sqrt_or_null(a)}
        if op.operation == "interaction_multiply":
            return {o: C.multiply(a, op.columns[1])}
        if op.operation == "interaction_ratio":
            return {o: C.ratio(a, op.columns[1])}
        if op.operation == "polynomial_degree2":
            return {o: C.square(a)}
        if op.operation in ("bin_equal_width", "bin_equal_freq"):
            return {o: C.right_closed_bin(a, s[f"edges{i}"])}
        if op.operation == "datetime_parts":
            ts = C.as_timestamp(a, dtypes[a])
            return {f"{o}_year": F.year(ts), f"{o}_month": F.month(ts), f"{o}_dow": C.weekday_mon0(ts),
                    f"{o}_hour": F.hour(ts),
                    f"{o}_days_since_min": C.days_since(C.epoch_micros(a, dtypes[a]), s.get(f"tmin{i}"))}
        if op.operation == "family_size":
            return {o: C.family_size(a, op.columns[1])}
        if op.operation == "is_alone":
            return {o: C.is_alone(a, op.columns[1])}
        if op.operation == "cabin_deck":
            return {o: C.cabin_deck(a)}
        raise PlanError(f"{op.operation!r} has no projection form")

    def apply(self, df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
        """Add every fitted output whose inputs exist in ``df``.  Lag and
        rolling mean follow ``order_by`` (must make rows unique)."""
        dtypes = dict(df.dtypes)
        exprs: dict[str, Column] = {}
        out = df
        windowed: list[FeatureOp] = []
        for i, op in enumerate(self.ops):
            if any(c not in dtypes for c in op.columns) or op.output_name in dict(self.skipped):
                continue
            if op.operation in ("lag", "rolling_mean"):
                windowed.append(op)
            elif op.output_name in self.plugins:
                out = self.plugins[op.output_name].add(out, op, i)
            elif op.operation in ("count_encoding", "extract_title"):
                lk = self.lookups[op.output_name]
                key = F.col(op.columns[0]) if lk.key_expr == "raw" else C.title_of(op.columns[0])
                tmp = f"_lk{i}"
                t = lk.table.select(F.col("_lk_key").alias(f"{tmp}_k"), F.col("_lk_val").alias(f"{tmp}_v"))
                out = out.withColumn(f"{tmp}_src", key)
                out = lookup_join(out, t, f"{tmp}_src", f"{tmp}_k", lk.small)
                if op.operation == "count_encoding":
                    val = F.coalesce(F.col(f"{tmp}_v"), F.lit(0)).cast("bigint")
                else:
                    val = F.when(F.col(f"{tmp}_v").isNotNull(), F.col(f"{tmp}_src")).otherwise(F.lit(C.RARE_TITLE))
                out = out.withColumn(op.output_name, val).drop(f"{tmp}_src", f"{tmp}_k", f"{tmp}_v")
            else:
                exprs.update(self._expr(op, i, dtypes))
        if exprs:
            out = out.withColumns(exprs)
        if windowed:
            if not order_by:
                raise PlanError("lag / rolling_mean need an order_by")
            halo = max((op.param("periods", 1) if op.operation == "lag" else op.param("window", 3) - 1)
                       for op in windowed)

            def build(w):
                cols = {}
                for op in windowed:
                    x = F.col(op.columns[0])
                    if op.operation == "lag":
                        cols[op.output_name] = F.lag(x, op.param("periods", 1)).over(w)
                    else:
                        n = op.param("window", 3)
                        cols[op.output_name] = F.avg(x.cast("double")).over(w.rowsBetween(-(n - 1), 0))
                return cols
            # only the order and the inputs are numbered and pinned; the
            # order columns make rows unique, so the results join back on them
            order = list(order_by)
            inputs = list(dict.fromkeys([*order, *(op.columns[0] for op in windowed)]))
            made = with_trailing_window(out.select(*inputs), order, build, halo=halo)
            out = out.join(made.select(*order, *[op.output_name for op in windowed]), order, "left")
        return out


def _quantile_points(bins: int) -> list[float]:
    return [i / bins for i in range(bins + 1)]


def fit_immediate(train: DataFrame, ops: Sequence[FeatureOp]) -> FittedFeatures:
    """Fit all immediate ops on ``train`` (one scalar aggregate + lookups)."""
    ops = list(ops)
    for op in ops:
        if op.kind != "immediate":
            raise PlanError(f"{op.operation!r} belongs to the folds: fitting it on every training row would leak the target")
        if op.operation == "tfidf_svd":
            raise PlanError("tfidf_svd is fitted by foldwise.operators.text")
    dtypes = dict(train.dtypes)
    aggs: list[Column] = []
    for i, op in enumerate(ops):
        a = op.columns[0]
        if op.operation in ("log_transform", "sqrt_transform"):
            aggs.append(F.min(C.as_double(a)).alias(f"min{i}"))
        elif op.operation == "bin_equal_width":
            aggs += [F.min(C.as_double(a)).alias(f"lo{i}"), F.max(C.as_double(a)).alias(f"hi{i}")]
        elif op.operation == "datetime_parts":
            aggs.append(F.min(C.epoch_micros(a, dtypes[a])).alias(f"tmin{i}"))
    row = train.agg(*aggs).first().asDict() if aggs else {}
    freq = [(i, op) for i, op in enumerate(ops) if op.operation == "bin_equal_freq"]
    for i, op in freq:  # exact quantiles; per op because the bin counts differ
        src = train.select(C.as_double(op.columns[0]).alias("x"))
        points = _quantile_points(op.param("bins", 10))
        if op.param("approximate", 0):  # edges from a KLL sketch
            row[f"q{i}"] = quantile_estimates(column_sketches(src, ["x"]), points).get("x", [None])
        else:
            row[f"q{i}"] = quantiles(src, ["x"], points)["x"]
        if row[f"q{i}"][0] is None:
            row[f"q{i}"] = None
    fitted = FittedFeatures(ops, {})
    for i, op in enumerate(ops):
        name, skip = op.output_name, None
        if op.operation in ("log_transform", "sqrt_transform"):
            if row[f"min{i}"] is not None and row[f"min{i}"] < 0:
                skip = "negative values in train"
        elif op.operation == "bin_equal_width":
            lo, hi, n = row[f"lo{i}"], row[f"hi{i}"], op.param("bins", 10)
            if lo is None or hi is None or (hi == lo and n > 1):
                skip = "constant or empty column: duplicate bin edges"
            else:
                fitted.scalars[f"edges{i}"] = C.equal_width_edges(lo, hi, n)
        elif op.operation == "bin_equal_freq":
            q = row[f"q{i}"]
            edges = sorted(set(q)) if q else []
            if len(edges) < 2:
                skip = "fewer than two distinct quantile edges"
            else:
                fitted.scalars[f"edges{i}"] = edges[1:-1]
        elif op.operation == "datetime_parts":
            fitted.scalars[f"tmin{i}"] = row[f"tmin{i}"]
        elif op.operation == "count_encoding":
            key = F.col(op.columns[0])
            if dtypes[op.columns[0]] in ("float", "double"):
                key = F.nanvl(key, F.lit(None).cast(dtypes[op.columns[0]]))  # NaN keys are missing
            t = (train.groupBy(key.alias("_lk_key")).agg(F.count(F.lit(1)).alias("_lk_val"))
                 .filter(F.col("_lk_key").isNotNull()))
            t, small = size_checked_broadcast(t)
            fitted.lookups[name] = _Lookup(op, t, "raw", small)
        elif op.operation == "extract_title":
            min_count = op.param("min_count", 10)
            t = (train.select(C.title_of(op.columns[0]).alias("_lk_key")).filter(F.col("_lk_key").isNotNull())
                 .groupBy("_lk_key").agg(F.count(F.lit(1)).alias("_lk_val"))
                 .filter(F.col("_lk_val") >= min_count))
            t, small = size_checked_broadcast(t)
            fitted.lookups[name] = _Lookup(op, t, "title", small)
        elif op.operation in PLUGINS:
            fitted.plugins[name] = _fit_plugin(PLUGINS[op.operation], train, op)
            before = train.limit(0)
            fitted.created += [c for c in fitted.plugins[name].add(before, op, i).columns if c not in before.columns]
            continue
        if skip:
            fitted.skipped.append((name, skip))
            continue
        if op.operation == "datetime_parts":
            fitted.created += [f"{name}_{p}" for p in ("year", "month", "dow", "hour", "days_since_min")]
        else:
            fitted.created.append(name)
    return fitted
