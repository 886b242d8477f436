"""Mergeable sketches as fitted state: approximate distinct counts and quantiles.

A file's column becomes an HLL sketch (distinct values) and, if numeric, a KLL
sketch (quantiles), by Spark's own aggregates.  Sketches are rows (file, column,
n, n_null, hll, kll) of a table; merging rows gives the sketch of all their
files, so new files are sketched alone and nothing is read twice.  Exact
statistics stay the default everywhere; these are asked for by name.

Errors: a distinct count is within ``DISTINCT_ERROR`` of the true one (three
standard errors of 2^14 registers), a quantile's rank within ``RANK_ERROR`` of the asked one
(99 % of the time for KLL of this size).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from foldwise.sources.logs import append_log, has_log, read_log

LG_REGISTERS, KLL_SIZE = 14, 1600
DISTINCT_ERROR, RANK_ERROR = 0.025, 0.005
SKETCHES = "file string, column string, n long, n_null long, hll binary, kll binary"


def column_sketches(df: DataFrame, columns: Sequence[str], file=None) -> DataFrame:
    """``(file, column, n, n_null, hll, kll)``: one aggregate of all columns a
    file (``file``: a Column; one row a column without it).  NaN is missing."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (NumericType, BooleanType))}
    clean = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) if c in numeric else F.col(f"`{c}`")
    rows = df.select((F.lit("") if file is None else file).alias("_file"), *[clean(c).alias(f"c{k}") for k, c in enumerate(columns)])
    aggs = []
    for k, c in enumerate(columns):
        x = F.col(f"c{k}")
        kll = F.kll_sketch_agg_double(x, F.lit(KLL_SIZE)) if c in numeric else F.max(F.lit(None).cast("binary"))
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n"), F.count_if(x.isNull()).alias("n_null"),
                             F.hll_sketch_agg(F.when(x.isNotNull(), F.xxhash64(x)), F.lit(LG_REGISTERS)).alias("hll"), kll.alias("kll")))
    wide = rows.groupBy("_file").agg(F.array(*aggs).alias("s"))
    return wide.select(F.col("_file").alias("file"), F.explode("s").alias("s")).select("file", "s.*")


def merged(sketches: DataFrame) -> DataFrame:
    """One row a column: the sketches of all its files."""
    return sketches.groupBy("column").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.hll_union_agg("hll").alias("hll"),
                                          F.when(F.count("kll") > 0, F.kll_merge_agg_double("kll")).alias("kll"))


def update_sketches(spark: SparkSession, path: str, columns: Sequence[str], store: str) -> DataFrame:
    """The sketches of a Parquet dataset's files, kept in the table at
    ``store``: files that it has already are not read again, those that are
    gone are left out."""
    whole = spark.read.parquet(path)
    known = read_log(spark, store, ["file"]) if has_log(spark, store) else spark.createDataFrame([], SKETCHES)
    files = spark.createDataFrame([(f,) for f in whole.inputFiles()], "file string")
    new = [r["file"] for r in files.join(known.select("file").distinct(), "file", "left_anti").collect()]
    if new:
        made = None
        names = {f: f.rsplit("/", 1)[-1] for f in new}
        rows = spark.read.schema(whole.schema).parquet(*new)
        # a scan may write its paths otherwise than the listing: files meet by name where names tell them apart
        if len(set(names.values())) == len(new):
            table = F.create_map(*[x for f, n in names.items() for x in (F.lit(n), F.lit(f))])
            made = column_sketches(rows, columns, F.substring_index(F.col("_metadata.file_path"), "/", -1)).withColumn("file", table[F.col("file")])
        else:
            for f in new:
                one = column_sketches(spark.read.schema(whole.schema).parquet(f), columns, F.lit(f))
                made = one if made is None else made.unionByName(one)
        append_log(made, store)
    return read_log(spark, store, ["file"]).join(files, "file", "left_semi")


def distinct_estimates(sketches: DataFrame) -> dict[str, int]:
    return {r["column"]: r["d"] for r in merged(sketches).select("column", F.hll_sketch_estimate("hll").alias("d")).collect()}


def quantile_estimates(sketches: DataFrame, probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Values of about the asked ranks by column; None where a column has no value."""
    rows = merged(sketches)
    some = F.col("kll").isNotNull() & (F.col("n") > F.col("n_null"))
    got = rows.select("column", *[F.when(some, F.kll_sketch_get_quantile_double("kll", F.lit(float(p)))).alias(f"q{k}") for k, p in enumerate(probs)]).collect()
    return {r["column"]: [r[f"q{k}"] for k in range(len(probs))] for r in got}
