"""Global row order without single-partition windows.

``with_position`` numbers rows 0..n-1 in a total order: range-partition on the
order keys, number rows inside each partition with
``monotonically_increasing_id`` (partition index in the high bits, local index
in the low 33 bits), checkpoint that numbering (range bounds are sampled, so
it must be computed once), then add each partition's prefix offset from a
table that has one row per partition (a proven broadcast bound).  Pass narrow
frames (ids, order keys, the values needed): the checkpoint holds them.  Grouped positions use
one row per (partition, group) instead.

``with_trailing_window`` evaluates lag / rolling frames over that global order
in fixed-size blocks: the last ``halo`` rows of every block are copied into the
next block, each block is windowed independently and the copies are dropped.
Both steps stay balanced whatever the key distribution, because the order keys
are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import materialize, size_checked_broadcast

_LOCAL_BITS = 33
_LOCAL_MASK = (1 << _LOCAL_BITS) - 1
DEFAULT_BLOCK_ROWS = 1 << 18


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


#: Hexadecimal digits of a hash that make a bucket.
PREFIX_DIGITS = 4


def _num_partitions(df: DataFrame, n: int | None) -> int:
    """Ranges for ``df``: one for each file it reads, and no fewer than the
    session's shuffle partitions.  (The planner's size estimate multiplies the
    sides of joins, and counting rows would compute the frame twice.)"""
    held = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return n or max(held, len(df.inputFiles()))


def _range(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """Range-partition on ``keys``.  An explicit count keeps every range a
    parallel task; letting AQE merge small ranges measured slower (fewer,
    larger sort tasks)."""
    return df.repartitionByRange(_num_partitions(df, num_partitions), *keys)


def with_hash_position(df: DataFrame, hashed: Column, tie: str, pos_col: str = "_pos", partition_by: Sequence[str] = (),
                       digits: int = PREFIX_DIGITS) -> DataFrame:
    """Add ``pos_col`` = 0-based rank of the row in (``hashed``, ``tie``)
    order, ``hashed`` being a hexadecimal hash (within ``partition_by``
    groups when given).

    The first ``digits`` of an evenly spread hash make buckets in the order of
    the hash itself: rows are ranked inside their bucket, and the counts of
    the buckets before it are added.  Bucket counts are at most 16^digits rows
    a group, whatever the size of the table; nothing is sampled, so nothing
    has to be pinned."""
    group = list(partition_by)
    rows = df.withColumn("_fw_hash", hashed)
    rows = rows.withColumn("_fw_bucket", F.conv(F.substring("_fw_hash", 1, digits), 16, 10).cast("int"))
    before = Window.partitionBy(*group).orderBy("_fw_bucket").rowsBetween(Window.unboundedPreceding, -1)
    keys = [F.col(g) for g in group]
    counts = rows.groupBy(*group, "_fw_bucket").agg(F.count(F.lit(1)).alias("_fw_cnt"))
    offsets = counts.select(*[k.alias(f"_fw_g{i}") for i, k in enumerate(keys)], F.col("_fw_bucket").alias("_fw_b"),
                            F.coalesce(F.sum("_fw_cnt").over(before), F.lit(0)).alias("_fw_off"))
    inside = Window.partitionBy(*group, "_fw_bucket").orderBy("_fw_hash", tie)
    ranked = rows.withColumn("_fw_rn", F.row_number().over(inside) - 1)
    offsets, _ = size_checked_broadcast(offsets, known_max_rows=None if group else 16 ** digits)
    cond = [ranked["_fw_bucket"] == offsets["_fw_b"]] + [ranked[g].eqNullSafe(offsets[f"_fw_g{i}"]) for i, g in enumerate(group)]
    out = ranked.join(offsets, cond, "inner").withColumn(pos_col, F.col("_fw_off") + F.col("_fw_rn"))
    return out.select(*[F.col(c) for c in df.columns], pos_col)


def with_position(df: DataFrame, order_by: Sequence[str | Column], pos_col: str = "_pos",
                  partition_by: Sequence[str] = (), size_col: str | None = None,
                  num_partitions: int | None = None, max_groups: int | None = None) -> DataFrame:
    """Add ``pos_col`` = 0-based rank of the row in ``order_by`` order (within
    ``partition_by`` groups when given).  ``order_by`` must make rows unique
    (append the row id) so the numbering is deterministic.  ``size_col``
    optionally receives the row count of the row's group (or of the table).

    ``max_groups`` is a known bound on the number of groups; it lets the
    per-(partition, group) offsets table be broadcast without counting it."""
    nparts = _num_partitions(df, num_partitions)  # upper bound on range partitions
    group = list(partition_by)
    keys = [*_cols(group), *_cols(order_by)]
    ranged = (_range(df, keys, num_partitions).sortWithinPartitions(*keys)
              .withColumn("_fw_mid", F.monotonically_increasing_id()))
    ranged = (ranged.withColumn("_fw_pid", F.shiftright(F.col("_fw_mid"), _LOCAL_BITS))
              .withColumn("_fw_lix", F.col("_fw_mid").bitwiseAND(F.lit(_LOCAL_MASK))))
    # Range bounds come from sampling seeded by the RDD id, so two evaluations
    # of the same plan can split rows differently.  Pin one numbering in the
    # checkpoint directory; counts and rows below both read it.
    ranged = materialize(ranged)
    aggs = [F.count(F.lit(1)).alias("_fw_cnt"), F.min("_fw_lix").alias("_fw_first")]
    counts = ranged.groupBy("_fw_pid", *group).agg(*aggs)
    before = Window.partitionBy(*group).orderBy("_fw_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = counts.select(
        "_fw_pid", *group, "_fw_first",
        F.coalesce(F.sum("_fw_cnt").over(before), F.lit(0)).alias("_fw_off"),
        F.sum("_fw_cnt").over(whole).alias("_fw_gn"))
    if group:
        bound = None if max_groups is None else nparts * max_groups
        offsets, _ = size_checked_broadcast(offsets, known_max_rows=bound)
        cond = [ranged["_fw_pid"] == offsets["_fw_pid"]] + [ranged[g].eqNullSafe(offsets[g]) for g in group]
        joined = ranged.join(offsets, cond, "inner").drop(offsets["_fw_pid"])
        for g in group:
            joined = joined.drop(offsets[g])
    else:
        offsets, _ = size_checked_broadcast(offsets, known_max_rows=nparts)
        joined = ranged.join(offsets, "_fw_pid", "inner")
    out = joined.withColumn(pos_col, F.col("_fw_off") + F.col("_fw_lix") - F.col("_fw_first"))
    if size_col:
        out = out.withColumn(size_col, F.col("_fw_gn"))
    return out.drop("_fw_mid", "_fw_pid", "_fw_lix", "_fw_cnt", "_fw_first", "_fw_off", "_fw_gn")


def with_trailing_window(df: DataFrame, order_by: Sequence[str | Column],
                         build: Callable[[Window], dict[str, Column]], halo: int,
                         partition_by: Sequence[str] = (), block_rows: int = DEFAULT_BLOCK_ROWS,
                         max_groups: int | None = None) -> DataFrame:
    """Evaluate window expressions that look at most ``halo`` rows back over a
    global (or per-group) order.  ``build(w)`` receives the block window
    (partitioned by block, ordered by position) and returns named columns."""
    halo = max(0, int(halo))
    b = max(int(block_rows), halo + 1)
    group = list(partition_by)
    pos = with_position(df, order_by, "_fw_pos", partition_by=group, max_groups=max_groups)
    home = F.floor(F.col("_fw_pos") / F.lit(b))
    tail = (F.col("_fw_pos") % F.lit(b)) >= F.lit(b - halo)
    blocks = F.when(F.lit(halo > 0) & tail, F.array(home, home + 1)).otherwise(F.array(home))
    exploded = pos.withColumn("_fw_blk", F.explode(blocks))
    w = Window.partitionBy(*group, "_fw_blk").orderBy("_fw_pos")
    exprs = build(w)
    out = exploded.select("*", *[e.alias(n) for n, e in exprs.items()])
    return out.filter(F.col("_fw_blk") == home).drop("_fw_blk", "_fw_pos")


def lag(df: DataFrame, column: str, order_by: Sequence[str | Column], periods: int = 1,
        output: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Value ``periods`` rows earlier in the order (pandas ``shift``); NULL for
    the first rows."""
    out = output or f"{column}_lag{periods}"
    if periods <= 0:
        raise ValueError("lag periods must be positive")
    return with_trailing_window(df, order_by, lambda w: {out: F.lag(column, periods).over(w)},
                                halo=periods, partition_by=partition_by)


def rolling_mean(df: DataFrame, column: str, order_by: Sequence[str | Column], window: int = 3,
                 output: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Trailing mean of the last ``window`` rows including the current one,
    ignoring NULLs (pandas ``rolling(window, min_periods=1).mean()``)."""
    out = output or f"{column}_roll{window}"
    if window <= 0:
        raise ValueError("rolling window must be positive")
    return with_trailing_window(
        df, order_by,
        lambda w: {out: F.avg(F.col(column).cast("double")).over(w.rowsBetween(-(window - 1), 0))},
        halo=window - 1, partition_by=partition_by)


def near_monotonic(df: DataFrame, columns: Sequence[str], order_by: Sequence[str | Column],
                   frac: float = 0.95) -> DataFrame:
    """Per column: share of consecutive non-null differences that are >= 0 in
    row order; ``is_monotonic`` needs at least 3 non-null values and
    ``share >= frac``.  All columns are checked in one job by stacking them
    into (column, value) rows and numbering each column's non-null values.

    Timestamps compare as microseconds; other values as DOUBLE.  Returns
    ``(column, n_nonnull, share_nondecreasing, is_monotonic)``."""
    dtypes = dict(df.dtypes)
    order_names = [c for c in order_by if isinstance(c, str)]
    if not columns:
        raise ValueError("no columns to check")
    cells = []
    for c in columns:
        t = dtypes[c]
        if t.startswith("timestamp") or t == "date":
            from foldwise.functions.columns import epoch_micros

            v = epoch_micros(c, t).cast("double")
        else:
            v = F.col(c).cast("double")
        cells.append(F.struct(F.lit(c).alias("column"), v.alias("_fw_v")))
    # one scan: every checked column becomes (column, value) rows
    stacked = (df.select(*order_names, F.explode(F.array(*cells)).alias("_fw_cell"))
               .select(*order_names, "_fw_cell.column", "_fw_cell._fw_v").filter(F.col("_fw_v").isNotNull()))
    diffs = with_trailing_window(
        stacked, order_by, lambda w: {"_fw_prev": F.lag("_fw_v", 1).over(w)}, halo=1,
        partition_by=["column"], max_groups=len(columns))
    d = F.col("_fw_v") - F.col("_fw_prev")
    agg = diffs.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_nonnull"),
        F.avg(F.when(F.col("_fw_prev").isNotNull(), (d >= 0).cast("double"))).alias("share_nondecreasing"))
    return agg.withColumn(
        "is_monotonic",
        (F.col("n_nonnull") >= 3) & F.coalesce(F.col("share_nondecreasing") >= F.lit(frac), F.lit(False)))


def running_sums(df: DataFrame, order_by: Sequence[str | Column], values: Sequence[str],
                 partition_by: Sequence[str] = (), suffix: str = "_cum",
                 num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` in ``order_by`` order (within
    ``partition_by`` groups), computed without a single-task window: the
    range-partitioned table is pinned in the checkpoint directory, each
    (range partition, group) chunk is summed, the chunk prefix offsets come
    from a table of one row per chunk, and the in-chunk running sum is a
    window over the chunk only.  ``order_by`` must be unique within a group."""
    nparts = _num_partitions(df, num_partitions)  # upper bound on range partitions
    group = list(partition_by)
    keys = [*_cols(group), *_cols(order_by)]
    ranged = materialize(_range(df, keys, num_partitions).withColumn("_fw_pid", F.spark_partition_id()))
    chunk = ranged.groupBy("_fw_pid", *group).agg(*[F.sum(v).alias(f"_fw_t{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(*group).orderBy("_fw_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunk.select("_fw_pid", *group, *[F.coalesce(F.sum(f"_fw_t{i}").over(before), F.lit(0))
                                                  .alias(f"_fw_o{i}") for i in range(len(values))])
    offsets, _ = size_checked_broadcast(offsets, known_max_rows=None if group else nparts)
    cond = [ranged["_fw_pid"] == offsets["_fw_pid"]] + [ranged[g].eqNullSafe(offsets[g]) for g in group]
    joined = ranged.join(offsets, cond, "inner").drop(offsets["_fw_pid"])
    for g in group:
        joined = joined.drop(offsets[g])
    w = Window.partitionBy("_fw_pid", *group).orderBy(*_cols(order_by)).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumns({f"{v}{suffix}": F.sum(v).over(w) + F.col(f"_fw_o{i}") for i, v in enumerate(values)})
    return out.drop("_fw_pid", *[f"_fw_o{i}" for i in range(len(values))])


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(c, v, cnt)``: how often each non-null, non-NaN value of the numeric
    ``columns`` occurs; one scan, counted before the shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    stacked = df.select(cells.alias("cell")).select("cell.c", "cell.v").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return stacked.groupBy("c", "v").agg(F.count(F.lit(1)).alias("cnt"))


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
              counts: DataFrame | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles (numpy's default) of several
    numeric columns, without any single task holding a column's values.

    Values are counted (``counts`` may carry their ``value_counts``), given
    distributed running counts in value order, and only the ranks
    floor/ceil(p * (n - 1)) are looked up; the few matching rows are returned
    to the driver and interpolated.  NULL per column when it has no value."""
    if not columns:
        return {}
    vc = value_counts(df, columns) if counts is None else counts.filter(F.col("c").isin(list(columns)))
    cum = running_sums(vc, ["v"], ["cnt"], partition_by=["c"])
    n = {r["c"]: r["n"] for r in cum.groupBy("c").agg(F.max("cnt_cum").alias("n")).collect()}
    wanted = {(c, k) for c, nc in n.items() for p in probs for k in _ranks(p, nc)}
    if not wanted:
        return {c: [None] * len(probs) for c in columns}
    targets = df.sparkSession.createDataFrame(sorted(wanted), "c string, k long")  # <= 2 * len(probs) rows per column
    hits = (cum.join(F.broadcast(targets), "c")
            .filter((F.col("cnt_cum") - F.col("cnt") <= F.col("k")) & (F.col("k") < F.col("cnt_cum")))
            .select("c", "k", "v").collect())
    at = {(r["c"], r["k"]): r["v"] for r in hits}

    def value(c: str, p: float) -> float | None:
        if c not in n:
            return None
        low, high = (at[c, k] for k in _ranks(p, n[c]))
        return low + (high - low) * (p * (n[c] - 1) % 1)

    return {c: [value(c, p) for p in probs] for c in columns}


def _ranks(p: float, n: int) -> tuple[int, int]:
    at = p * (n - 1)
    return int(at // 1), int(-(-at // 1))
