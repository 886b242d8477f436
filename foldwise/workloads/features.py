"""Immediate feature-operator workloads (fit on the train role, apply to
both roles) and matrix preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators.features import fit_immediate
from foldwise.operators.matrix import fit_matrix
from foldwise.plans.spec import FeatureOp
from foldwise.workloads.common import is_test, r, table, workload


def _split_sql(id_col: str) -> str:
    return f"CASE WHEN {id_col} % 5 = 4 THEN 'test' ELSE 'train' END AS split"


def _fit_apply(base, id_col, ops, outputs, order_by=None, doubles=()):
    base = base.withColumn("split", F.when(is_test(id_col), "test").otherwise("train"))
    train, test = base.filter(F.col("split") == "train"), base.filter(F.col("split") == "test")
    fitted = fit_immediate(train, ops)
    out = fitted.apply(train, order_by).unionByName(fitted.apply(test, order_by))
    return out.select(id_col, "split", *[r(c) if c in doubles else F.col(c) for c in outputs])


def _orders(spark, d):
    return table(spark, d, "orders")


def _part(spark, d):
    return table(spark, d, "part")


@workload("feat_log_transform", f"""
SELECT o_orderkey, {_split_sql('o_orderkey')}, round(ln(1 + o_totalprice), 6) AS f FROM orders
""")
def feat_log_transform(spark, d):
    """log_transform: ln(1+x) of the order total (train has no negatives)."""
    base = _orders(spark, d).select("o_orderkey", "o_totalprice")
    return _fit_apply(base, "o_orderkey", [FeatureOp.of("log_transform", "o_totalprice", "f")], ["f"], doubles=["f"])


@workload("feat_sqrt_transform", f"""
SELECT p_partkey, {_split_sql('p_partkey')}, round(sqrt(p_retailprice), 6) AS f FROM part
""")
def feat_sqrt_transform(spark, d):
    """sqrt_transform of the part retail price."""
    base = _part(spark, d).select("p_partkey", "p_retailprice")
    return _fit_apply(base, "p_partkey", [FeatureOp.of("sqrt_transform", "p_retailprice", "f")], ["f"], doubles=["f"])


@workload("feat_interactions", f"""
SELECT p_partkey, {_split_sql('p_partkey')},
       round(CAST(p_size AS DOUBLE) * p_retailprice, 6) AS mul,
       round(p_retailprice / (CAST(p_size AS DOUBLE) + 1e-8), 6) AS ratio,
       round(CAST(p_size AS DOUBLE) * p_size, 6) AS sq
FROM part
""")
def feat_interactions(spark, d):
    """interaction_multiply, interaction_ratio and polynomial_degree2 on part."""
    base = _part(spark, d).select("p_partkey", "p_size", "p_retailprice")
    ops = [FeatureOp.of("interaction_multiply", ["p_size", "p_retailprice"], "mul"),
           FeatureOp.of("interaction_ratio", ["p_retailprice", "p_size"], "ratio"),
           FeatureOp.of("polynomial_degree2", "p_size", "sq")]
    return _fit_apply(base, "p_partkey", ops, ["mul", "ratio", "sq"], doubles=["mul", "ratio", "sq"])


@workload("feat_bin_equal_width", f"""
WITH b AS (SELECT o_orderkey, o_totalprice, {_split_sql('o_orderkey')} FROM orders),
s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM b WHERE split = 'train')
SELECT o_orderkey, split,
       CAST(len(list_filter(list_transform(range(1, 10), lambda i: lo + i * ((hi - lo) / 10)),
                            lambda e: o_totalprice > e)) AS INTEGER) AS f
FROM b, s
""")
def feat_bin_equal_width(spark, d):
    """bin_equal_width (10 bins, right-closed, open ends) of the order total."""
    base = _orders(spark, d).select("o_orderkey", "o_totalprice")
    return _fit_apply(base, "o_orderkey", [FeatureOp.of("bin_equal_width", "o_totalprice", "f", bins=10)], ["f"])


@workload("feat_bin_equal_freq", f"""
WITH b AS (SELECT o_orderkey, o_totalprice, {_split_sql('o_orderkey')} FROM orders),
s AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice,
        [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM b WHERE split = 'train')
SELECT o_orderkey, split, CAST(len(list_filter(e[2:len(e) - 1], lambda x: o_totalprice > x)) AS INTEGER) AS f
FROM b, s
""")
def feat_bin_equal_freq(spark, d):
    """bin_equal_freq (10 exact linear quantile bins, right-closed)."""
    base = _orders(spark, d).select("o_orderkey", "o_totalprice")
    return _fit_apply(base, "o_orderkey", [FeatureOp.of("bin_equal_freq", "o_totalprice", "f", bins=10)], ["f"])


@workload("feat_count_encoding", f"""
WITH b AS (SELECT o_orderkey, o_custkey, {_split_sql('o_orderkey')} FROM orders),
c AS (SELECT o_custkey AS k, count(*) AS n FROM b WHERE split = 'train' GROUP BY 1)
SELECT o_orderkey, split, coalesce(c.n, 0) AS f FROM b LEFT JOIN c ON b.o_custkey = c.k
""")
def feat_count_encoding(spark, d):
    """count_encoding of the customer key (train frequency, unseen → 0)."""
    base = _orders(spark, d).select("o_orderkey", "o_custkey")
    return _fit_apply(base, "o_orderkey", [FeatureOp.of("count_encoding", "o_custkey", "f")], ["f"])


@workload("feat_datetime_parts", f"""
WITH b AS (SELECT event_id, ts, {_split_sql('event_id')} FROM events),
m AS (SELECT min(epoch_us(ts)) AS t0 FROM b WHERE split = 'train')
SELECT event_id, split, CAST(year(ts) AS INTEGER) AS d_year, CAST(month(ts) AS INTEGER) AS d_month,
       CAST(isodow(ts) - 1 AS INTEGER) AS d_dow, CAST(hour(ts) AS INTEGER) AS d_hour,
       CAST(floor((epoch_us(ts) - t0) / 86400000000.0) AS BIGINT) AS d_days_since_min
FROM b, m
""")
def feat_datetime_parts(spark, d):
    """datetime_parts of the event timestamp (Mon=0, floored days since the train minimum)."""
    base = table(spark, d, "events").select("event_id", "ts")
    outs = [f"d_{p}" for p in ("year", "month", "dow", "hour", "days_since_min")]
    return _fit_apply(base, "event_id", [FeatureOp.of("datetime_parts", "ts", "d")], outs)


@workload("feat_extract_title", f"""
WITH b AS (SELECT p_partkey, 'x, ' || p_type || '. ' || p_name AS nm, {_split_sql('p_partkey')} FROM part),
t AS (SELECT p_partkey, split, nullif(regexp_extract(nm, ' ([A-Za-z]+)\\.', 1), '') AS title FROM b),
c AS (SELECT title, count(*) AS n FROM t WHERE split = 'train' AND title IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
SELECT p_partkey, split, CASE WHEN c.title IS NOT NULL THEN t.title ELSE 'Rare' END AS f
FROM t LEFT JOIN c ON t.title = c.title
""")
def feat_extract_title(spark, d):
    """extract_title from a name built as 'x, <type>. <name>' (min_count 10)."""
    base = _part(spark, d).select("p_partkey", F.concat(F.lit("x, "), "p_type", F.lit(". "), "p_name").alias("nm"))
    return _fit_apply(base, "p_partkey", [FeatureOp.of("extract_title", "nm", "f")], ["f"])


@workload("feat_family_deck", f"""
WITH b AS (SELECT p_partkey, p_size % 3 AS sib, nullif(p_size % 2, 1) AS par,
                  nullif(substring(p_brand, 7), '1') AS cabin, {_split_sql('p_partkey')} FROM part)
SELECT p_partkey, split,
       round(coalesce(CAST(sib AS DOUBLE), 0) + coalesce(CAST(par AS DOUBLE), 0) + 1, 6) AS fam,
       CAST(coalesce(CAST(sib AS DOUBLE), 0) + coalesce(CAST(par AS DOUBLE), 0) + 1 = 1 AS INTEGER) AS alone,
       coalesce(nullif(substring(cabin, 1, 1), ''), 'U') AS deck
FROM b
""")
def feat_family_deck(spark, d):
    """family_size, is_alone and cabin_deck on stand-in household/cabin columns."""
    base = _part(spark, d).select(
        "p_partkey", (F.col("p_size") % 3).alias("sib"), F.nullif(F.col("p_size") % 2, F.lit(1)).alias("par"),
        F.nullif(F.substring("p_brand", 7, 100), F.lit("1")).alias("cabin"))
    ops = [FeatureOp.of("family_size", ["sib", "par"], "fam"), FeatureOp.of("is_alone", ["sib", "par"], "alone"),
           FeatureOp.of("cabin_deck", "cabin", "deck")]
    return _fit_apply(base, "p_partkey", ops, ["fam", "alone", "deck"], doubles=["fam"])


@workload("feat_lag_rolling", f"""
SELECT event_id, {_split_sql('event_id')},
       round(lag(value, 1) OVER (PARTITION BY event_id % 5 = 4 ORDER BY event_id), 6) AS lag1,
       round(avg(value) OVER (PARTITION BY event_id % 5 = 4 ORDER BY event_id
                              ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS roll3
FROM events
""")
def feat_lag_rolling(spark, d):
    """lag(1) and rolling_mean(3) of the event value in event order, train and test each in its own order."""
    base = table(spark, d, "events").select("event_id", "value")
    ops = [FeatureOp.of("lag", "value", "lag1", periods=1), FeatureOp.of("rolling_mean", "value", "roll3", window=3)]
    return _fit_apply(base, "event_id", ops, ["lag1", "roll3"], order_by=["event_id"], doubles=["lag1", "roll3"])


@workload("matrix_prepare", f"""
WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS tp,
                  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS prio,
                  o_orderstatus AS st, {_split_sql('o_orderkey')} FROM orders),
m AS (SELECT median(tp) AS med FROM b WHERE split = 'train'),
cp AS (SELECT k, row_number() OVER (ORDER BY f, k) - 1 AS code
       FROM (SELECT coalesce(prio, '__na__') AS k, min(o_orderkey) AS f FROM b WHERE split = 'train' GROUP BY 1)),
cs AS (SELECT k, row_number() OVER (ORDER BY f, k) - 1 AS code
       FROM (SELECT coalesce(st, '__na__') AS k, min(o_orderkey) AS f FROM b WHERE split = 'train' GROUP BY 1))
SELECT o_orderkey, split, round(coalesce(tp, m.med), 6) AS tp,
       CAST(coalesce(cp.code, -1) AS BIGINT) AS prio, CAST(coalesce(cs.code, -1) AS BIGINT) AS st
FROM b CROSS JOIN m LEFT JOIN cp ON coalesce(b.prio, '__na__') = cp.k LEFT JOIN cs ON coalesce(b.st, '__na__') = cs.k
""")
def matrix_prepare(spark, d):
    """Median fill of a numeric column and first-appearance ordinal codes of
    two categoricals (NULL as its own category, unseen → -1)."""
    o = _orders(spark, d)
    base = o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("tp"),
        F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderpriority")).alias("prio"),
        F.col("o_orderstatus").alias("st"),
        F.when(is_test("o_orderkey"), "test").otherwise("train").alias("split"))
    train = base.filter(F.col("split") == "train")
    fm = fit_matrix(train, ["tp", "prio", "st"], order_by="o_orderkey")
    out = fm.apply(base, keep=["o_orderkey", "split"])
    return out.select("o_orderkey", "split", r("tp"), "prio", "st")
