"""Profiling, typing, leakage and time-order workloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import profile as P
from foldwise.workloads.common import r, table, workload

#: Rows of a file of ``sketches_within_error``.
SKETCH_FILE_ROWS = 1_000_000

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_LINEITEM = {"l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
             "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
             "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "datetime"}
_DOCS = {"doc_id": "numeric", "text": "string", "lang": "string", "source": "string", "n_chars": "numeric",
         "quality": "numeric", "toxic": "numeric"}


def _profile_sql(src: str, cols: dict[str, str]) -> str:
    parts = []
    for c, fam in cols.items():
        nn = f"count({c})"
        if fam == "numeric":
            d = f"CAST({c} AS DOUBLE)"
            num = (f"min({d}), max({d}), avg({d}), stddev_samp({d}), quantile_cont({d}, 0.25), "
                   f"quantile_cont({d}, 0.5), quantile_cont({d}, 0.75), NULL::DOUBLE, "
                   f"count(CASE WHEN {d} NOT IN (0.0, 1.0) THEN 1 END) = 0")
        elif fam == "datetime":
            d = f"CAST(epoch_us({c}) AS DOUBLE)"
            num = f"min({d}), max({d}), NULL, NULL, NULL, NULL, NULL, NULL::DOUBLE, NULL::BOOLEAN"
        else:
            num = f"NULL, NULL, NULL, NULL, NULL, NULL, NULL, avg(length({c})), NULL::BOOLEAN"
        parts.append(f"SELECT '{c}' AS col, '{fam}' AS family, count(*) AS n_rows, count(*) - {nn} AS n_null, "
                     f"count(DISTINCT {c}) AS n_distinct, {num} FROM {src}")
    body = "\nUNION ALL ".join(parts)
    return f"""
WITH p(col, family, n_rows, n_null, n_distinct, mn, mx, av, sd, q25, q50, q75, ln, zo) AS ({body})
SELECT col AS "column", family, n_rows, n_null, round(n_null / n_rows, 6) AS null_frac, n_distinct,
       round(mn, 6) AS min_value, round(mx, 6) AS max_value, round(av, 8) AS mean, round(sd, 6) AS sd,
       round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(ln, 6) AS avg_len,
       CASE WHEN family = 'datetime' THEN 'datetime'
            WHEN family = 'numeric' THEN CASE WHEN n_distinct <= 2 AND zo THEN 'boolean' ELSE 'numeric' END
            WHEN coalesce(ln, 0) > 30 THEN 'text'
            WHEN n_rows - n_null > 0 AND n_distinct >= 20 AND n_distinct / (n_rows - n_null) > 0.5
                 THEN 'high_cardinality'
            ELSE 'categorical' END AS kind
FROM p"""


def _profile_out(df):
    p = P.profile_columns(df)
    return p.select("column", "family", "n_rows", "n_null", r("null_frac"), "n_distinct", r("min_value"),
                    r("max_value"), F.round("mean", 8).alias("mean"), r("sd"), r("q25"), r("q50"), r("q75"), r("avg_len"), "kind")


_DOCS_SQL = ("(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic "
             "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def _docs(spark, d):
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "text", "lang", "source", "n_chars", "quality", "toxic")


@workload("profile_columns", _profile_sql("lineitem", _LINEITEM))
def profile_lineitem(spark, d):
    """Per-column profile (counts, nulls, exact distinct, min/max/mean/sd,
    exact quartiles, length) and kind classification of lineitem."""
    return _profile_out(table(spark, d, "lineitem"))


@workload("profile_documents", _profile_sql(_DOCS_SQL, _DOCS))
def profile_documents(spark, d):
    """Profile and kinds of documents ⟕ labels: text, identity-like, 0/1
    boolean-like and partly missing columns."""
    return _profile_out(_docs(spark, d))


@workload("profile_summary", """
WITH b AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic, count(*) AS cnt FROM b GROUP BY ALL)
SELECT CAST(sum(cnt) AS BIGINT) AS n_rows, 7 AS n_cols, CAST(sum(cnt - 1) AS BIGINT) AS duplicate_rows,
       array_to_string(list_sort(list_filter(
         [CASE WHEN sum(CASE WHEN lang IS NULL THEN cnt ELSE 0 END) / sum(cnt) > 0.3 THEN 'lang' END,
          CASE WHEN sum(CASE WHEN source IS NULL THEN cnt ELSE 0 END) / sum(cnt) > 0.3 THEN 'source' END,
          CASE WHEN sum(CASE WHEN quality IS NULL THEN cnt ELSE 0 END) / sum(cnt) > 0.3 THEN 'quality' END,
          CASE WHEN sum(CASE WHEN toxic IS NULL THEN cnt ELSE 0 END) / sum(cnt) > 0.3 THEN 'toxic' END],
         lambda x: x IS NOT NULL)), ',') AS high_missing,
       CAST(sum((8 + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) + 8 + 4 + 4) * cnt) AS BIGINT) AS logical_bytes
FROM g
""")
def profile_summary(spark, d):
    """Row/column counts, duplicate rows, high-missing columns (> 30 % NULL)
    and logical size of documents ⟕ labels, over all their columns."""
    s = P.summary(_docs(spark, d))
    return s.select(F.col("n_rows").cast("bigint").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"),
                    F.col("duplicate_rows").cast("bigint").alias("duplicate_rows"),
                    F.array_join("high_missing", ",").alias("high_missing"),
                    F.col("logical_bytes").cast("bigint").alias("logical_bytes"))


@workload("leakage_name_flags", f"""
SELECT table_name AS dataset, CAST(ordinal_position AS INTEGER) AS position, column_name AS "column",
       coalesce(list_has_any(list_filter(string_split_regex(lower(column_name), '[^a-z0-9]+'), lambda t: t <> ''),
                             ['target', 'label', 'answer', 'result', 'pred', 'score', 'probability', 'output', 'leak'])
                OR regexp_matches(column_name, '(?i)(_id$|^id$)'), false) AS name_flag
FROM information_schema.columns
WHERE table_name IN ({", ".join(f"'{t}'" for t in TABLES)})
""")
def leakage_name_flags(spark, d):
    """Leakage-by-name rule over the catalog of every driver table (schemas
    only, no data scan)."""
    cat = P.catalog(spark, {t: table(spark, d, t) for t in TABLES})
    return P.name_leak_flags(cat).select("dataset", "position", "column", "name_flag")


@workload("identify_id_targets", """
WITH s AS (SELECT column_name AS c, ordinal_position AS p FROM information_schema.columns WHERE table_name = 'labels'),
t AS (SELECT column_name AS c FROM information_schema.columns WHERE table_name = 'documents'),
i AS (SELECT coalesce(min(CASE WHEN t.c IS NOT NULL THEN s.p END), min(s.p)) AS idp FROM s LEFT JOIN t ON s.c = t.c)
SELECT 'documents' AS dataset, s.c AS "column", CAST(s.p AS INTEGER) AS position, s.p = i.idp AS is_id FROM s, i
""")
def identify_id_targets(spark, d):
    """Id and target columns of a (sample = labels, test = documents) pair
    from the catalog: first shared column is the id, the rest are targets."""
    cat = P.catalog(spark, {"labels": table(spark, d, "labels"), "documents": table(spark, d, "documents")})
    cat = cat.withColumn("role", F.when(F.col("dataset") == "labels", "sample").otherwise("test")) \
             .withColumn("dataset", F.lit("documents"))
    return P.identify_id_targets(cat)


@workload("leakage_correlation", """
WITH b AS (SELECT d.doc_id, d.n_chars, CAST(length(d.text) AS BIGINT) AS text_len, l.quality, l.toxic
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (
  SELECT 'text_len' AS "column", count(CASE WHEN text_len IS NOT NULL AND n_chars IS NOT NULL THEN 1 END) AS n,
         abs(covar_samp(text_len, n_chars) / (stddev_samp(text_len) * stddev_samp(n_chars))) AS r,
         min(text_len) < max(text_len) AS v FROM b WHERE text_len IS NOT NULL AND n_chars IS NOT NULL
  UNION ALL
  SELECT 'quality', count(*), abs(covar_samp(quality, n_chars) / (stddev_samp(quality) * stddev_samp(n_chars))),
         min(quality) < max(quality) FROM b WHERE quality IS NOT NULL AND n_chars IS NOT NULL
  UNION ALL
  SELECT 'toxic', count(*), abs(covar_samp(toxic, n_chars) / (stddev_samp(toxic) * stddev_samp(n_chars))),
         min(toxic) < max(toxic) FROM b WHERE toxic IS NOT NULL AND n_chars IS NOT NULL)
SELECT "column", 'n_chars' AS target, n AS n_pairs, round(r, 6) AS abs_r,
       n >= 3 AND coalesce(v, false) AND coalesce(r > 0.99, false) AS flagged
FROM p
""")
def leakage_correlation(spark, d):
    """Correlation leakage against the n_chars target on documents ⟕ labels
    (the id is protected; text length is the leaking feature)."""
    df = _docs(spark, d).select("doc_id", "n_chars", F.length("text").cast("bigint").alias("text_len"),
                                "quality", "toxic")
    res = P.correlation_leaks(df, ["n_chars"], exclude=["doc_id"])
    return res.select("column", "target", "n_pairs", r("abs_r"), "flagged")


@workload("profile_top_values", """
WITH v AS (SELECT 'l_returnflag' AS c, l_returnflag AS v FROM lineitem UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
           UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem
           UNION ALL SELECT 'l_partkey', CAST(l_partkey AS VARCHAR) FROM lineitem),
n AS (SELECT c, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS k FROM n)
SELECT c AS "column", CAST(k AS INTEGER) AS rank, v AS value, n AS n_rows FROM r WHERE k <= 5
""")
def profile_top_values(spark, d):
    """The five most frequent values of four lineitem columns (the limit is the report)."""
    return P.top_values(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_partkey"], 5)


@workload("leakage_union", """
WITH b AS (SELECT d.doc_id, d.n_chars AS target, length(d.text) AS text_len, 2 * d.n_chars AS twice, l.quality, l.toxic AS label_x
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
p AS (SELECT 'text_len' AS c, text_len AS x, target AS y FROM b UNION ALL SELECT 'quality', quality, target FROM b UNION ALL SELECT 'label_x', label_x, target FROM b),
r AS (SELECT c, count(*) AS n, abs(covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y))) AS r, min(x) < max(x) AS v FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
SELECT c AS "column", c = 'label_x' AS by_name, coalesce(n >= 3 AND v AND r > 0.99, false) AS by_correlation FROM r
WHERE c = 'label_x' OR coalesce(n >= 3 AND v AND r > 0.99, false)
""")
def leakage_union(spark, d):
    """Columns flagged by name or by correlation with the target: the id and
    the target are protected, and a known feature (twice the target) is exempt
    from the correlation rule."""
    docs = _docs(spark, d).select("doc_id", F.col("n_chars").alias("target"), F.length("text").alias("text_len"),
                                  (2 * F.col("n_chars")).alias("twice"), "quality", F.col("toxic").alias("label_x"))
    return P.leakage_columns(docs, "doc_id", ["target"], known_features=["twice"])


_NUM_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _topcorr_sql() -> str:
    parts = []
    k = 0
    for i, a in enumerate(_NUM_LI):
        for b in _NUM_LI[i + 1:]:
            parts.append(f"SELECT {k} AS k, '{a}' AS col_a, '{b}' AS col_b, "
                         f"abs(covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b}))) AS r FROM lineitem")
            k += 1
    return ("WITH p AS (" + "\nUNION ALL ".join(parts) + ")\n"
            "SELECT col_a, col_b, round(r, 6) AS abs_r FROM p WHERE r IS NOT NULL AND NOT isnan(r) "
            "ORDER BY r DESC, k LIMIT 20")


@workload("top_correlations", _topcorr_sql())
def top_correlations(spark, d):
    """Top-20 numeric column pairs of lineitem by |Pearson r| (the limit is the top-k report)."""
    res = P.top_correlations(table(spark, d, "lineitem"), 20)
    return res.select("col_a", "col_b", r("abs_r"))


@workload("time_series_detection", """
WITH e AS (SELECT event_id AS id, CAST(epoch_us(ts) AS DOUBLE) AS v, 'ts' AS c, 'datetime' AS t FROM events
           UNION ALL SELECT event_id, CAST(weekofyear(ts) AS DOUBLE), 'week', 'number' FROM events
           UNION ALL SELECT o_orderkey, CAST(epoch_us(o_orderdate) AS DOUBLE), 'o_orderdate', 'datetime' FROM orders),
d AS (SELECT c, t, v - lag(v) OVER (PARTITION BY c, t ORDER BY id) AS dv FROM e WHERE v IS NOT NULL)
SELECT c AS "column", t AS as_type, count(*) AS n_nonnull,
       round(avg(CASE WHEN dv IS NULL THEN NULL WHEN dv >= 0 THEN 1.0 ELSE 0.0 END), 6) AS share_nondecreasing,
       count(*) >= 3 AND coalesce(avg(CASE WHEN dv IS NULL THEN NULL WHEN dv >= 0 THEN 1.0 ELSE 0.0 END) >= 0.95, false)
         AS is_monotonic
FROM d GROUP BY 1, 2
""")
def time_series_detection(spark, d):
    """Near-monotonic check (>= 95 % non-decreasing steps in row order) of
    datetime columns and time-named columns of events and orders."""
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"), "ts", F.weekofyear("ts").alias("week"))
    od = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    res = P.time_series_columns(ev, ["id"]).unionByName(P.time_series_columns(od, ["id"]))
    return res.select("column", "as_type", "n_nonnull", r("share_nondecreasing"), "is_monotonic")


@workload("time_series_text_dates", """
WITH e AS (SELECT o_orderkey AS id, CAST(NULL AS DOUBLE) AS v, 'order date' AS c, 'number' AS t FROM orders
           UNION ALL SELECT o_orderkey, CAST(epoch_us(CAST('1990-01-01' AS TIMESTAMP) + to_days(CAST(o_orderkey // 40 AS INTEGER))) AS DOUBLE), 'order date', 'date' FROM orders
           UNION ALL SELECT o_orderkey, CAST(1990 + o_orderkey // 9000 AS DOUBLE), 'year', 'number' FROM orders
           UNION ALL SELECT o_orderkey, CAST(epoch_us(make_timestamp(CAST(1990 + o_orderkey // 9000 AS BIGINT), 1, 1, 0, 0, 0.0)) AS DOUBLE), 'year', 'date' FROM orders),
d AS (SELECT c, t, v - lag(v) OVER (PARTITION BY c, t ORDER BY id) AS dv FROM e WHERE v IS NOT NULL)
SELECT c AS "column", t AS as_type, count(*) AS n_nonnull, round(avg(CASE WHEN dv IS NULL THEN NULL WHEN dv >= 0 THEN 1.0 ELSE 0.0 END), 6) AS share_nondecreasing,
       count(*) >= 3 AND coalesce(avg(CASE WHEN dv IS NULL THEN NULL WHEN dv >= 0 THEN 1.0 ELSE 0.0 END) >= 0.95, false) AS is_monotonic
FROM d GROUP BY 1, 2
""")
def time_series_text_dates(spark, d):
    """Time-named columns that hold texts or numbers: each is tried as a
    number and as a parsed date (stand-in dates rise with the order key)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.date_add(F.lit("1990-01-01").cast("date"), F.floor(F.col("o_orderkey") / 40).cast("int")).cast("string").alias("order date"),
                                         (1990 + F.floor(F.col("o_orderkey") / 9000)).cast("int").alias("year"))
    res = P.time_series_columns(o, ["id"])
    return res.select("column", "as_type", "n_nonnull", r("share_nondecreasing"), "is_monotonic")


@workload("sketches_within_error", """
WITH l AS (SELECT 'l_orderkey' AS c, CAST(l_orderkey AS VARCHAR) AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', CAST(l_extendedprice AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'l_shipdate', CAST(l_shipdate AS VARCHAR) FROM lineitem UNION ALL SELECT 'l_returnflag', CAST(l_returnflag AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'discount_or_null', CASE WHEN l_linenumber % 3 > 0 THEN CAST(l_discount AS VARCHAR) END FROM lineitem)
SELECT c AS "column", count(*) AS n, count(*) - count(v) AS n_null, true AS distinct_within, CASE WHEN c IN ('l_orderkey', 'l_extendedprice', 'discount_or_null') THEN true END AS quartiles_within FROM l GROUP BY c
""")
def sketches_within_error(spark, d):
    """HLL and KLL sketches of lineitem kept per file and merged: rows and
    nulls, and whether distinct counts and the ranks of the quartiles lie
    within the stated errors of the exact ones."""
    from foldwise.operators import sketches as K
    from foldwise.operators.ordering import value_counts
    from foldwise.workloads.io import _scratch

    base = _scratch(spark)
    columns = ["l_orderkey", "l_extendedprice", "l_shipdate", "l_returnflag", "discount_or_null"]
    li = table(spark, d, "lineitem").withColumn("discount_or_null", F.when(F.col("l_linenumber") % 3 > 0, F.col("l_discount"))).select(*columns)
    # files that a task can write and sketch, however many rows there are
    li.repartition(max(4, -(-li.count() // SKETCH_FILE_ROWS))).write.parquet(f"{base}/l")
    K.update_sketches(spark, f"{base}/l", columns, f"{base}/store")
    kept = K.update_sketches(spark, f"{base}/l", columns, f"{base}/store")  # nothing new
    back = spark.read.parquet(f"{base}/l")
    exact, guess = P.distinct_counts(back, columns), K.distinct_estimates(kept)
    probs = [0.25, 0.5, 0.75]
    asked = [(c, p, q) for c, qs in K.quantile_estimates(kept, probs).items() for p, q in zip(probs, qs) if q is not None]
    points = spark.createDataFrame(asked, "c string, p double, q double")  # three rows a column
    numeric = sorted({c for c, _, _ in asked})
    below = value_counts(back.select(*[F.col(c).cast("double").alias(c) for c in numeric]), numeric).join(F.broadcast(points), "c").groupBy("c", "p").agg(
        (F.sum(F.when(F.col("v") < F.col("q"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("low"), (F.sum(F.when(F.col("v") <= F.col("q"), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("high"))
    ranks = below.groupBy(F.col("c").alias("column")).agg(F.bool_and((F.col("low") - K.RANK_ERROR <= F.col("p")) & (F.col("p") <= F.col("high") + K.RANK_ERROR)).alias("quartiles_within"))
    close = spark.createDataFrame([(c, abs(guess[c] - exact[c]) <= K.DISTINCT_ERROR * max(1, exact[c])) for c in columns], "column string, distinct_within boolean")
    counts = K.merged(kept).select("column", "n", "n_null")
    return counts.join(close, "column").join(ranks, "column", "left").select("column", "n", "n_null", "distinct_within", "quartiles_within")
