"""Source and sink workloads: the orders table written out per partition in
each input format, scanned back through the library's readers; prediction
tables written partitioned and read back with partition pruning."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foldwise.session import ensure_checkpoint_dir
from foldwise.sources import files as S
from foldwise.sources import sinks as K
from foldwise.workloads.common import r, table, workload
from foldwise.workloads.scoring import binary_preds


#: Rows of one stand-in JSON file of columns.
JSON_FILE_ROWS = 25_000


def _scratch(spark) -> str:
    """A fresh directory under the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _write_per_partition(df, base: str, fmt: str, orient: str = "records") -> None:
    """Stand-in input files: every task writes its own partition as one
    feather file (in batches of 500 rows) or one JSON file of that orientation."""
    def write(batches):
        import io

        import pandas as pd
        import pyarrow as pa
        import pyarrow.feather as feather

        from foldwise.sources.feather import output_stream

        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables)
        from pyspark import TaskContext

        # one file per input partition, named by partition id: a retried
        # task overwrites its own file instead of adding a duplicate
        name = f"{base}/part-{TaskContext.get().partitionId():05d}.{fmt}"
        with output_stream(name) as out:
            if fmt == "feather":
                feather.write_feather(t, out, chunksize=500)
            else:
                buf = io.StringIO()
                t.to_pandas().to_json(buf, orient=orient, date_format="iso", double_precision=15)
                out.write(buf.getvalue().encode("utf-8"))
        yield pa.RecordBatch.from_pandas(pd.DataFrame({"file": [name]}))

    df.mapInArrow(write, "file string").collect()  # one row per written file


@workload("scan_formats", """
SELECT fmt AS format, count(*) AS n_rows, round(sum(o_totalprice), 4) AS sum_total,
       count(DISTINCT o_orderpriority) AS n_priorities, max(o_orderkey) AS max_key
FROM orders, (VALUES ('csv'), ('parquet'), ('feather'), ('json')) t(fmt) GROUP BY 1
""")
def scan_formats(spark, d):
    """Orders written out as CSV, Feather and JSON arrays of records and
    scanned back with the library's readers (CSV with header and inferred
    types, Feather through the Python data source with one partition per
    file, multi-line JSON), plus the given Parquet file through the Parquet
    reader; the same aggregates per format."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    base = _scratch(spark)
    o.write.option("header", "true").csv(f"{base}/csv")
    _write_per_partition(o, f"{base}/feather", "feather")
    _write_per_partition(o, f"{base}/json", "json")
    scans = {"csv": S.load_table(spark, f"{base}/csv", "csv"),
             "parquet": S.load_table(spark, f"{d}/orders.parquet", "parquet"),
             "feather": S.load_table(spark, f"{base}/feather", "feather"),
             "json": S.load_table(spark, f"{base}/json", "json")}
    out = None
    for fmt, df in scans.items():
        a = df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("o_totalprice").cast("double")), 4)
                   .alias("sum_total"), F.count_distinct("o_orderpriority").alias("n_priorities"),
                   F.max(F.col("o_orderkey").cast("bigint")).alias("max_key")).withColumn("format", F.lit(fmt))
        out = a if out is None else out.unionByName(a)
    return out.select("format", "n_rows", "sum_total", "n_priorities", "max_key")


@workload("scan_columns_json", """
SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS o_orderpriority, o_orderkey % 3 = 0 AS third FROM orders
""")
def scan_columns_json(spark, d):
    """Orders written as JSON objects of columns (one file a partition, some
    cells null) and read back as rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderpriority")).alias("o_orderpriority"),
                                         (F.col("o_orderkey") % 3 == 0).alias("third"))
    base = _scratch(spark)
    # a file is one JSON value, which one task parses: many files rather than large ones
    _write_per_partition(o.repartition(max(8, -(-o.count() // JSON_FILE_ROWS))), f"{base}/json", "json", "columns")
    back = S.load_table(spark, f"{base}/json", "json")
    return back.select("o_orderkey", r("o_totalprice"), "o_orderpriority", "third")


@workload("scan_feather_batches", """
SELECT o_orderpriority, count(*) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey >= 500 GROUP BY 1
""")
def scan_feather_batches(spark, d):
    """One Feather file read by many tasks, each some of its record batches,
    and only the buffers of two of its columns."""
    from foldwise.sources.feather import register

    base = _scratch(spark)
    _write_per_partition(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").coalesce(1), f"{base}/f", "feather")
    register(spark)
    df = spark.read.format("feather").option("columns", "o_orderkey,o_orderpriority").option("partitionBytes", 1 << 14).load(f"{base}/f")
    if df.rdd.getNumPartitions() < 2 or len(df.columns) != 2:
        raise RuntimeError("the file is not split")
    return df.filter("o_orderkey >= 500").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").cast("bigint").alias("keys"))


@workload("sink_predictions", """
WITH o AS (SELECT o_orderkey FROM orders)
SELECT kind, model, count(*) AS n_rows FROM (
  SELECT 'oof' AS kind, 'm_a' AS model FROM o UNION ALL SELECT 'oof', 'm_b' FROM o
  UNION ALL SELECT 'test', 'm_a' FROM o) GROUP BY 1, 2
""")
def sink_predictions(spark, d):
    """Prediction table written partitioned by (kind, model), a versioned
    Parquet matrix, a JSON score file and a CSV output (row count checked
    after reading it back); the prediction table read back per partition."""
    p = binary_preds(spark, d)
    oof = p.select(F.lit("oof").alias("kind"), "model", F.col("o_orderkey").alias("row_id"), "fold", "pred")
    test = p.filter(F.col("model") == "m_a").select(
        F.lit("test").alias("kind"), "model", F.col("o_orderkey").alias("row_id"),
        F.lit(None).cast("int").alias("fold"), "pred")
    base = _scratch(spark)
    K.write_predictions(oof.unionByName(test), f"{base}/preds")
    K.write_matrix(p.select("o_orderkey", "pred"), f"{base}/matrix", 1)
    K.write_scores_json(p.groupBy("model").agg(F.avg("pred").alias("mean_pred")), f"{base}/scores")
    K.write_output_csv(test.select(F.col("row_id").alias("o_orderkey"), "pred"), f"{base}/output.csv",
                       order_by="o_orderkey")
    back = spark.read.parquet(f"{base}/preds")
    out_rows = S.load_table(spark, f"{base}/output.csv", "csv").count()
    if out_rows != back.filter(F.col("kind") == "test").count():
        raise RuntimeError("CSV output lost rows")
    return back.groupBy("kind", "model").agg(F.count(F.lit(1)).alias("n_rows"))


@workload("sinks_round_trip", """
WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders)
SELECT 'matrix' AS sink, count(*) AS n_rows, round(sum(o_totalprice), 4) AS total, max(o_orderkey) AS last_key FROM o
UNION ALL SELECT 'csv', count(*), round(sum(o_totalprice), 4), max(o_orderkey) FROM o
UNION ALL SELECT 'json', count(*), round(sum(s), 4), NULL FROM (SELECT o_orderpriority, round(avg(o_totalprice), 6) AS s FROM o GROUP BY 1)
""")
def sinks_round_trip(spark, d):
    """The versioned Parquet matrix, the ordered CSV output and the JSON
    scores, each read back: rows, totals, and the last key (of the CSV, by its
    place at the end of the files in order)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    base = _scratch(spark)
    matrix = K.write_matrix(o.select("o_orderkey", "o_totalprice"), f"{base}/matrix", 3)
    K.write_output_csv(o.select("o_orderkey", "o_totalprice"), f"{base}/out.csv", order_by="o_orderkey")
    K.write_scores_json(o.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 6).alias("s")), f"{base}/scores")
    scores = spark.read.json(f"{base}/scores")
    summed = lambda df, name, last: df.agg(F.lit(name).alias("sink"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("o_totalprice"), 4).alias("total"), last.cast("bigint").alias("last_key"))
    csv = summed(S.with_row_order(S.load_table(spark, f"{base}/out.csv", "csv")), "csv", F.max_by("o_orderkey", "_row"))
    js = scores.agg(F.lit("json").alias("sink"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("s"), 4).alias("total"), F.lit(None).cast("bigint").alias("last_key"))
    return summed(spark.read.parquet(matrix), "matrix", F.max("o_orderkey")).unionByName(csv).unionByName(js)


@workload("header_catalog", """
SELECT table_name AS dataset, CAST(ordinal_position AS INTEGER) AS position, column_name AS "column"
FROM information_schema.columns
WHERE table_name IN ('orders', 'lineitem', 'customer', 'part', 'events', 'documents')
""")
def header_catalog(spark, d):
    """Header-only reads (schema metadata, no data scan) of six tables into
    the ``(dataset, position, column)`` catalog."""
    from foldwise.operators.profile import catalog

    names = ["orders", "lineitem", "customer", "part", "events", "documents"]
    return catalog(spark, {n: table(spark, d, n) for n in names}).select("dataset", "position", "column")


@workload("load_target_limit", """
SELECT count(*) AS n_rows, round(CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS DOUBLE), 6) AS n_f FROM orders
""")
def load_target(spark, d):
    """Target load as a two-column projection (pruned at the scan) of the
    whole table."""
    o = S.load_table(spark, f"{d}/orders.parquet", "parquet")
    t = S.load_target(o, "o_orderkey", ["o_orderstatus"])
    return t.agg(F.count(F.lit(1)).alias("n_rows"),
                 r(F.sum((F.col("o_orderstatus") == "F").cast("int")), "n_f"))


@workload("first_rows", """
SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus FROM orders LIMIT 1000)
""")
def first_rows(spark, d):
    """Row-limited read (the limit is the feature): the first 1,000 rows of
    orders in file order."""
    return S.load_table(spark, f"{d}/orders.parquet", "parquet", nrows=1000).select("o_orderkey", "o_orderstatus")


_STEMS = ("train", "my_train_v2", "test", "test_data", "sample_submission", "test_submission", "notes", "Training", "submission", "holdout")
_SUFFIXES = ("csv", "parquet", "feather", "json", "txt", "CSV")


@workload("resolve_roles", f"""
WITH f AS (SELECT 'c' || o_custkey AS dataset, ({list(_STEMS)})[CAST(o_orderkey % {len(_STEMS)} AS BIGINT) + 1] || CASE WHEN o_orderkey % 3 = 0 THEN '_' || o_orderkey ELSE '' END AS stem,
  ({list(_SUFFIXES)})[CAST(o_orderkey % {len(_SUFFIXES)} AS BIGINT) + 1] AS suffix FROM orders),
k AS (SELECT DISTINCT dataset, stem || '.' || suffix AS file, lower(stem) AS stem, list_position(['csv', 'parquet', 'feather', 'json'], lower(suffix)) AS rank FROM f),
c AS (SELECT *, 'train' AS role FROM k WHERE contains(stem, 'train') UNION ALL SELECT *, 'sample' FROM k WHERE contains(stem, 'submission')
  UNION ALL SELECT *, 'test' FROM k WHERE contains(stem, 'test') AND NOT contains(stem, 'submission'))
SELECT dataset, role, file FROM c WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dataset, role ORDER BY rank, length(stem), file) = 1
""")
def resolve_dataset_roles(spark, d):
    """Role resolution over a listing of one folder per customer, a file per
    order (stem and suffix from its key): format order, keyword in the stem,
    a sample file never taken as test, any role optional."""
    key = F.col("o_orderkey")
    pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))
    stem = F.concat(pick(_STEMS), F.when(key % 3 == 0, F.concat(F.lit("_"), key.cast("string"))).otherwise(""))
    path = F.concat(F.lit("file:/data/c"), F.col("o_custkey").cast("string"), F.lit("/"), stem, F.lit("."), pick(_SUFFIXES))
    listing = table(spark, d, "orders").select(path.alias("path"), F.lit(1).cast("bigint").alias("length")).distinct()
    found = S.resolve_roles(listing, "/data")
    return found.select("dataset", "role", F.element_at(F.split("path", "/"), -1).alias("file"))
