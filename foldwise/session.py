"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast only fitted-state tables up to this many bytes; bigger tables are
# joined with a shuffle (AQE may still pick a broadcast at run time).
BROADCAST_BYTES = 64 << 20


def get_spark(master: str | None = None, app: str = "foldwise",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library assumes: UTC, AQE with skew
    handling, Arrow transfer, no UI (no ports beyond Spark's own RPC).
    ``shuffle_partitions`` is set only where the caller gives it; otherwise
    the cluster's own setting holds."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.driver.memory", os.environ.get("FOLDWISE_DRIVER_MEM", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare_session(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``foldwise`` importable in Python workers (Arrow UDFs, the
    Feather data source): zip the package once per application and register
    it with ``addPyFile``, Spark's own mechanism for shipping Python code to
    executors."""
    import shutil

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import foldwise

    pkg = os.path.dirname(os.path.abspath(foldwise.__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="foldwise-py-"), "foldwise")
    archive = shutil.make_archive(base, "zip", root_dir=os.path.dirname(pkg), base_dir="foldwise")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def prepare_session(spark: SparkSession) -> str:
    """Checkpoint directory plus the package on the executors' Python path."""
    ship_package(spark)
    return ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint directory that the cluster names in
    ``spark.checkpoint.dir``.  Only a local master, where the driver's disk is
    every task's disk, gets a private scratch directory when nothing is
    configured; on a cluster a missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="foldwise-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (files in the shared checkpoint directory): cuts the
    lineage so a lost executor does not force recomputation of the whole
    upstream plan, and pins non-reproducible values."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8,
           "timestamp": 8, "timestamp_ntz": 8}
# what a row costs in a hash relation beside its values
_ROW_OVERHEAD = 48


def row_bytes(df: DataFrame):
    """Column of a row's size: fixed widths, byte lengths of texts, and the
    JSON text of nested values."""
    total = F.lit(_ROW_OVERHEAD)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in _WIDTHS:
            total = total + _WIDTHS[kind]
        elif kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(c), F.lit(0)) + 16
        else:
            total = total + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 16
    return total


def size_checked_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES,
                           known_max_rows: int | None = None) -> tuple[DataFrame, bool]:
    """Mark ``df`` for broadcast only when its size is proven small.

    ``known_max_rows`` is a bound on the rows that holds by construction (one
    row per partition, say) for frames of fixed-width columns; otherwise the
    table is persisted and its bytes are added up.  Returns the (possibly
    hinted) frame and whether it was broadcast; beyond the bound the caller's
    join stays a shuffle join."""
    if known_max_rows is not None and all(t in _WIDTHS for _, t in df.dtypes):
        width = _ROW_OVERHEAD + sum(_WIDTHS[t] for _, t in df.dtypes)
        if known_max_rows * width <= max_bytes:
            return F.broadcast(df), True
    # Fitted-state tables are deterministic aggregates: keep them in the
    # block cache (recomputed from lineage if an executor is lost) and size them.
    m = df.persist(StorageLevel.MEMORY_AND_DISK)
    size = m.agg(F.sum(row_bytes(m))).first()[0] or 0
    if size <= max_bytes:
        return F.broadcast(m), True
    return m, False


def lookup_join(df: DataFrame, table: DataFrame, key: str, table_key: str, broadcast: bool, extra: tuple = ()) -> DataFrame:
    """Left join of ``df`` to a lookup ``table`` on ``key`` (and on further
    ``extra`` conditions).  A broadcast table joins as it is.  In a shuffle
    join, rows of a NULL key, which match nothing, would all meet in one task:
    they are dealt out by a hash of the row instead; hot keys are left to
    Spark's skew handling, which splits them."""
    same = df[key] == table[table_key]
    if broadcast:
        return df.join(table, [same, *extra], "left")
    spread = F.when(df[key].isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).otherwise(F.lit(0).cast("bigint"))
    salted, zero = df.withColumn("_fw_salt", spread), table.withColumn("_fw_zero", F.lit(0).cast("bigint"))
    out = salted.join(zero, [same, F.col("_fw_salt") == F.col("_fw_zero"), *extra], "left")
    return out.drop("_fw_salt", "_fw_zero")
