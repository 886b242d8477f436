"""Fold-assignment and further in-fold encoding workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators.folds import CONTIGUOUS, FORWARD, KFOLD, STRATIFIED, assign_folds
from foldwise.operators.infold import Deferred, full_fit_encode, infold_encode
from foldwise.workloads.common import is_test, r, table, workload

_MD5 = "md5('42:' || CAST(o_orderkey AS VARCHAR))"


@workload("folds_kfold", f"""
SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS INTEGER) AS fold FROM orders
""")
def folds_kfold(spark, d):
    """Shuffled 5-fold assignment of orders (md5-seeded order, equal sizes)."""
    o = table(spark, d, "orders").select("o_orderkey")
    return assign_folds(o, "o_orderkey", k=5, kind=KFOLD, seed=42).select("o_orderkey", "fold")


@workload("folds_stratified", f"""
SELECT o_orderkey, o_orderstatus,
       CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS INTEGER) AS fold
FROM orders
""")
def folds_stratified(spark, d):
    """Stratified shuffled 5-fold assignment of orders by order status."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return assign_folds(o, "o_orderkey", k=5, kind=STRATIFIED, seed=42, y="o_orderstatus").select("o_orderkey", "o_orderstatus", "fold")


@workload("folds_forward", """
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
q AS (SELECT event_id, pos, n, n // 6 AS t FROM p)
SELECT event_id, CAST(CASE WHEN t > 0 AND pos >= n - 5 * t THEN (pos - (n - 5 * t)) // t END AS INTEGER) AS fold
FROM q
""")
def folds_forward(spark, d):
    """Forward-chaining 5-fold split of events in time order: t = n div 6,
    the first n - 5t rows are never validated (fold NULL)."""
    e = table(spark, d, "events").select("event_id", "ts")
    return assign_folds(e, "event_id", k=5, kind=FORWARD, order_by=["ts"]).select("event_id", "fold")


@workload("folds_contiguous", """
SELECT o_orderkey, o_orderstatus,
       CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold_all,
       CAST(ntile(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS fold_by_class
FROM orders
""")
def folds_contiguous(spark, d):
    """Unshuffled contiguous folds (meta-learner folds): over all rows and
    within each order-status class."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    a = assign_folds(o, "o_orderkey", k=5, kind=CONTIGUOUS, fold_col="fold_all")
    b = assign_folds(a, "o_orderkey", k=5, kind=CONTIGUOUS, y="o_orderstatus", fold_col="fold_by_class")
    return b.select("o_orderkey", "o_orderstatus", "fold_all", "fold_by_class")


@workload("folds_all_kinds", f"""
WITH k AS (SELECT (row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS fold FROM orders),
s AS (SELECT (row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS fold
      FROM orders),
c AS (SELECT ntile(5) OVER (ORDER BY o_orderkey) - 1 AS fold FROM orders)
SELECT 'kfold' AS kind, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM k GROUP BY 1, 2
UNION ALL SELECT 'stratified', CAST(fold AS INTEGER), count(*) FROM s GROUP BY 1, 2
UNION ALL SELECT 'contiguous', CAST(fold AS INTEGER), count(*) FROM c GROUP BY 1, 2
""")
def folds_all_kinds(spark, d):
    """Fold sizes of the shuffled, stratified and contiguous assignments of orders."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    out = None
    for kind, kw in (("kfold", {}), ("stratified", {"y": "o_orderstatus"}),
                     ("contiguous", {})):
        f = assign_folds(o, "o_orderkey", k=5, kind=kind, **kw)
        g = f.groupBy(F.lit(kind).alias("kind"), "fold").agg(F.count(F.lit(1)).alias("n"))
        out = g if out is None else out.unionByName(g)
    return out


def _orders_enc(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"))


_ENC_OPS = [Deferred("group_mean_encode", ("o_custkey", "o_totalprice"), "gm"),
            Deferred("group_std_encode", ("o_custkey", "o_totalprice"), "gs"),
            Deferred("target_encode", ("o_orderpriority",), "te")]


@workload("infold_group_encodings", f"""
WITH f AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
                  (row_number() OVER (ORDER BY {_MD5}, o_orderkey) - 1) % 5 AS fold FROM orders),
ff AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) t(fit_fold)),
fit AS (SELECT ff.fit_fold, f.* FROM f JOIN ff ON f.fold <> ff.fit_fold),
g AS (SELECT fit_fold, avg(o_totalprice) AS gmv, stddev_samp(o_totalprice) AS gsv, avg(y) AS gy FROM fit GROUP BY 1),
c AS (SELECT fit_fold, o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM fit GROUP BY 1, 2),
p AS (SELECT fit_fold, o_orderpriority, avg(y) AS m, count(y) AS n FROM fit GROUP BY 1, 2)
SELECT f.o_orderkey, ff.fit_fold AS fit_fold, f.fold = ff.fit_fold AS heldout,
       round(coalesce(c.m, g.gmv, 0.0), 6) AS gm, round(coalesce(c.s, g.gsv, 0.0), 6) AS gs,
       round(coalesce((p.m * p.n + g.gy * 1.0) / (p.n + 1.0), g.gy), 6) AS te
FROM f JOIN ff ON true JOIN g ON g.fit_fold = ff.fit_fold
LEFT JOIN c ON c.fit_fold = ff.fit_fold AND c.o_custkey = f.o_custkey
LEFT JOIN p ON p.fit_fold = ff.fit_fold AND p.o_orderpriority = f.o_orderpriority
""")
def infold_group_encodings(spark, d):
    """Shuffled 5-fold in-fold group-mean / group-sd encodings of the order
    total by customer and target encoding of priority, for every (row, fit
    fold) pair (training rows and held-out rows)."""
    folds = assign_folds(_orders_enc(spark, d), "o_orderkey", k=5, kind=KFOLD, seed=42)
    enc = infold_encode(folds, _ENC_OPS, "o_orderkey", "y", k=5, kind=KFOLD)
    return enc.select("o_orderkey", F.col("fit_fold").cast("int").alias("fit_fold"), "heldout",
                      r("gm"), r("gs"), r("te"))


@workload("infold_forward_encode", """
WITH p AS (SELECT event_id, user_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos,
                  count(*) OVER () AS n FROM events),
f AS (SELECT *, CASE WHEN n // 6 > 0 AND pos >= n - 5 * (n // 6) THEN (pos - (n - 5 * (n // 6))) // (n // 6) END AS fold
      FROM p),
ff AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) t(fit_fold)),
fit AS (SELECT ff.fit_fold, f.* FROM f JOIN ff ON coalesce(f.fold, -1) < ff.fit_fold),
g AS (SELECT fit_fold, avg(value) AS gy FROM fit GROUP BY 1),
u AS (SELECT fit_fold, user_id, avg(value) AS m, count(value) AS n FROM fit GROUP BY 1, 2)
SELECT f.event_id, ff.fit_fold AS fit_fold, coalesce(f.fold = ff.fit_fold, false) AS heldout,
       round(coalesce((u.m * u.n + g.gy * 1.0) / (u.n + 1.0), g.gy), 6) AS te
FROM f JOIN ff ON coalesce(f.fold, -1) <= ff.fit_fold JOIN g ON g.fit_fold = ff.fit_fold
LEFT JOIN u ON u.fit_fold = ff.fit_fold AND u.user_id = f.user_id
""")
def infold_forward_encode(spark, d):
    """Forward-chaining folds on events (time order) with in-fold target
    encoding of the user id: fold f is fitted on every earlier row."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    folds = assign_folds(e, "event_id", k=5, kind=FORWARD, order_by=["ts"])
    enc = infold_encode(folds, [Deferred("target_encode", ("user_id",), "te")], "event_id", "value",
                        k=5, kind=FORWARD)
    return enc.select("event_id", F.col("fit_fold").cast("int").alias("fit_fold"), "heldout", r("te"))


@workload("full_fit_encode", """
WITH b AS (SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) AS y,
                  CASE WHEN o_orderkey % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM orders),
tr AS (SELECT * FROM b WHERE split = 'train'),
g AS (SELECT avg(o_totalprice) AS gmv, stddev_samp(o_totalprice) AS gsv, avg(y) AS gy FROM tr),
c AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM tr GROUP BY 1),
p AS (SELECT o_orderpriority, avg(y) AS m, count(y) AS n FROM tr GROUP BY 1)
SELECT b.o_orderkey, b.split, round(coalesce(c.m, g.gmv, 0.0), 6) AS gm, round(coalesce(c.s, g.gsv, 0.0), 6) AS gs,
       round(coalesce((p.m * p.n + g.gy * 1.0) / (p.n + 1.0), g.gy), 6) AS te
FROM b CROSS JOIN g LEFT JOIN c ON c.o_custkey = b.o_custkey LEFT JOIN p ON p.o_orderpriority = b.o_orderpriority
""")
def full_fit_encode_orders(spark, d):
    """Deferred encodings fitted on the whole train role and applied to both
    roles (the full-train refit path; unseen test keys fall back)."""
    base = _orders_enc(spark, d).withColumn("split", F.when(is_test("o_orderkey"), "test").otherwise("train"))
    train = base.filter(F.col("split") == "train")
    out = full_fit_encode(train, base, _ENC_OPS, "y")
    return out.select("o_orderkey", "split", r("gm"), r("gs"), r("te"))
