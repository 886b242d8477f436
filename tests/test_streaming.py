"""Fitted batch state applied to a file stream equals the batch result."""

import tempfile

from pyspark.sql import functions as F

from foldwise.operators.features import fit_immediate
from foldwise.operators.infold import Deferred
from foldwise.operators.matrix import fit_matrix
from foldwise.plans.spec import FeatureOp
from foldwise.streaming.apply import apply_to_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority",
        (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    train, test = o.filter("o_orderkey % 5 != 4"), o.filter("o_orderkey % 5 = 4").drop("y")
    ops = [FeatureOp.of("log_transform", "o_totalprice", "lt"), FeatureOp.of("count_encoding", "o_custkey", "ce")]
    ff = fit_immediate(train, ops)
    fm = fit_matrix(ff.apply(train), ["o_totalprice", "o_orderpriority", "lt", "ce"], order_by="o_orderkey")
    deferred = [Deferred("target_encode", ("o_orderpriority",), "te")]
    d = tempfile.mkdtemp(prefix="fw-stream-")
    test.write.mode("overwrite").parquet(f"{d}/in")
    stream = spark.readStream.schema(test.schema).parquet(f"{d}/in")
    scored = apply_to_stream(stream, ff, fm, deferred, train, "y", keep=["o_orderkey"])
    q = scored.writeStream.format("memory").queryName("fw_scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("SELECT * FROM fw_scored").collect()))
    from foldwise.operators.infold import full_fit_encode

    expect = fm.apply(full_fit_encode(train, ff.apply(spark.read.parquet(f"{d}/in")), deferred, "y"),
                      keep=["o_orderkey", "te"])
    assert got == sorted(map(tuple, expect.select(*spark.sql("SELECT * FROM fw_scored").columns).collect()))
    assert len(got) == test.count()
