"""Text-feature workloads (TF-IDF weights and their SVD projection)."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators.text import fit_tfidf_svd, fit_vocabulary, weights
from foldwise.workloads.common import is_test, r, table, workload


@workload("tfidf_weights", """
WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN 'test' ELSE 'train' END AS split,
                  regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN\\pM_]{2,}') AS toks FROM documents),
t AS (SELECT doc_id, split, unnest(toks) AS term FROM b),
tc AS (SELECT doc_id, split, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n FROM b WHERE split = 'train'),
st AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc WHERE split = 'train' GROUP BY 1),
v AS (SELECT term, ln((1 + n.n) / (1 + df)) + 1 AS idf FROM st, n ORDER BY cf DESC, term LIMIT 500),
w AS (SELECT doc_id, split, tc.term, tf * idf AS w FROM tc JOIN v ON tc.term = v.term)
SELECT doc_id, split, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
""")
def tfidf_weights(spark, d):
    """TF-IDF weights (train vocabulary of the 500 most frequent terms,
    smoothed idf, L2 per document) of every document, train and test roles."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    train = docs.filter(~is_test("doc_id"))
    vocab = fit_vocabulary(train, "text", train.count(), 500)
    w = weights(docs, "text", "doc_id", vocab)
    return w.select("doc_id", F.when(is_test("doc_id"), "test").otherwise("train").alias("split"), "term",
                    r("weight"))


@workload("tfidf_svd_projection")
def tfidf_svd_projection(spark, d):
    """tfidf_svd feature op: 500-term TF-IDF of the documents fitted on the
    train role, truncated SVD (50 components), projection of every document."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    train = docs.filter(~is_test("doc_id"))
    fitted = fit_tfidf_svd(train, "text", "doc_id", components=50, max_features=500, prefix="t")
    out = fitted.transform(docs, "doc_id")
    return out.select("doc_id", *[r(c) for c in fitted.output_columns])


_ENERGY_SQL = """
WITH b AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN\\pM_]{2,}') AS toks FROM documents WHERE doc_id % 5 <> 4),
t AS (SELECT doc_id, unnest(toks) AS term FROM b), tc AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
st AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tc GROUP BY 1),
v AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, ln((1 + (SELECT count(*) FROM b)) / (1 + df)) + 1 AS idf FROM (SELECT * FROM st ORDER BY cf DESC, term LIMIT 12)),
w AS (SELECT doc_id, idx, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS x FROM tc JOIN v USING (term)),
g AS (SELECT a.idx AS i, b.idx AS j, sum(a.x * b.x) AS g FROM w a JOIN w b USING (doc_id) GROUP BY 1, 2)
SELECT round(sum(CASE WHEN i = j THEN g END), 6) AS energy, round(sum(g * g), 4) AS energy_squared FROM g
"""


@workload("tfidf_svd_energy", _ENERGY_SQL)
def tfidf_svd_energy(spark, d):
    """Singular values of a 12-term TF-IDF matrix of the documents (train
    role) with all its components: the sum of their squares is the trace of
    the Gram matrix, that of their fourth powers its squared norm."""
    return _energy(spark, d)


def _energy(spark, d, **how):
    docs = table(spark, d, "documents").select("doc_id", "text").filter(~is_test("doc_id"))
    sv = fit_tfidf_svd(docs, "text", "doc_id", components=12, max_features=12, all_components=True, **how).singular_values
    rows = spark.createDataFrame([(float(x),) for x in sv], "s double")
    return rows.agg(r(F.sum(F.col("s") ** 2), "energy"), F.round(F.sum(F.col("s") ** 4), 4).alias("energy_squared"))


@workload("tfidf_svd_range_finder", _ENERGY_SQL)
def tfidf_svd_range_finder(spark, d):
    """The same singular values from the randomised range finder and the
    tall-skinny QR, which wide vocabularies go through."""
    return _energy(spark, d, gram_terms=0)
