"""Registered ops and the in-fold encoder as a saved ML stage."""
import tempfile

import pytest
from pyspark.sql import functions as F

from foldwise.operators.encoder import InFoldEncoder, InFoldEncoderModel
from foldwise.operators.features import fit_immediate
from foldwise.operators.folds import FORWARD, KFOLD, assign_folds
from foldwise.operators.infold import Deferred, full_fit_encode, infold_encode
from foldwise.plans.compile import compile_plan
from foldwise.plans.spec import REGISTRY, FeatureOp, PlanError, register, registered, unregister
from foldwise.streaming.apply import apply_to_stream


def _rows(spark, n=120):
    rows = [(i, f"k{i % 7}" if i % 11 else None, float(i % 13), i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "rid long, k string, v double, y int")


@pytest.mark.parametrize("kind,operation,cols", [(KFOLD, "target_encode", ["k"]), (KFOLD, "group_std_encode", ["k", "v"]), (FORWARD, "target_encode", ["k"]), (FORWARD, "group_mean_encode", ["k", "v"])])
def test_reloaded_encoder_equals_the_in_fold_encoding(spark, kind, operation, cols):
    df = assign_folds(_rows(spark), "rid", k=4, kind=kind)
    want = infold_encode(df, [Deferred(operation, tuple(cols), "e")], "rid", "y", k=4, kind=kind)
    path = tempfile.mkdtemp(prefix="fw-enc-") + "/m"
    InFoldEncoder(operation=operation, inputCols=cols, outputCol="e", numFolds=4, foldKind=kind).fit(df).write().overwrite().save(path)
    model = InFoldEncoderModel.load(path)
    pairs = lambda d: {(r.rid, r.fit_fold, r.heldout): r.e for r in d.collect()}
    got, want = pairs(model.expand(df)), pairs(want)
    assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x]) for x in want)
    held = {r.rid: r.e for r in model.transform(df).collect() if r.fold is not None}
    assert all(held[rid] == pytest.approx(e) for (rid, _, out), e in want.items() if out)
    # rows without a fold, as new rows are: the fit on all training rows
    new = df.drop("fold")
    full = {r.rid: r.e for r in full_fit_encode(df, new, [Deferred(operation, tuple(cols), "e")], "y").collect()}
    assert {r.rid: pytest.approx(r.e) for r in model.transform(new).collect()} == full


def test_encoder_refuses_what_the_registry_refuses(spark):
    with pytest.raises(ValueError):
        InFoldEncoder(operation="log_transform", inputCols=["k"]).fit(assign_folds(_rows(spark), "rid", k=3))


def _mean(train, op):
    return train.agg(F.avg(op.columns[0]).alias("m"))


def test_registered_ops_in_plans_and_streams(spark):
    df = _rows(spark)
    with registered("minus_mean", 1, _mean, lambda op, s: F.col(op.columns[0]) - s["m"]), registered("twice", 1, None, lambda op, s: F.col(op.columns[0]) * 2), \
            registered("share", 2, lambda t, op: t.groupBy(op.columns[0]).agg(F.sum(op.columns[1]).alias("total")), lambda op, s: F.col(op.columns[1]) / s["total"], keyed=True):
        ops = [FeatureOp.of("minus_mean", "v", "c"), FeatureOp.of("twice", "v", "t"), FeatureOp.of("share", ["k", "v"], "s"), FeatureOp.of("share", "k", "bad")]
        cp = compile_plan(df, df, ops, id_column="rid", targets=["y"], order_by="rid")
        fitted = fit_immediate(df, ops[:3])
        assert cp.errors == [("bad", "wrong_arity")] and {"c", "t", "s"} <= set(cp.features)
    assert len(REGISTRY) == 19
    mean = df.agg(F.avg("v")).first()[0]
    total = {r.k: r.t for r in df.groupBy("k").agg(F.sum("v").alias("t")).collect()}
    for r in fitted.apply(df).collect():
        assert r.c == pytest.approx(r.v - mean) and r.t == 2 * r.v and (r.s is None if r.k is None else r.s == pytest.approx(r.v / total[r.k]))
    path = tempfile.mkdtemp(prefix="fw-stream-")
    df.write.mode("overwrite").parquet(path)
    stream = apply_to_stream(spark.readStream.schema(df.schema).parquet(path), fitted)
    q = stream.writeStream.format("memory").queryName("ext_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("ext_stream").agg(F.sum("t")).first()[0] == 2 * df.agg(F.sum("v")).first()[0]


def test_registry_rules(spark):
    for call in (lambda: register("lag", 1, None, lambda op, s: None), lambda: unregister("lag"), lambda: register("x", 0, None, lambda op, s: None), lambda: register("x", 1, None, lambda op, s: None, keyed=True)):
        with pytest.raises(PlanError):
            call()
    # a fit that repeats a key, or gives several rows for one, is logged and skipped
    with registered("dup", 1, lambda t, op: t.select(op.columns[0], "v"), lambda op, s: s["v"], keyed=True), registered("many", 1, lambda t, op: t.select("v"), lambda op, s: s["v"]):
        cp = compile_plan(_rows(spark), None, [FeatureOp.of("dup", "k", "a"), FeatureOp.of("many", "v", "b"), FeatureOp.of("polynomial_degree2", "v", "q")], id_column="rid", targets=["y"], order_by="rid")
    assert [e for e, _ in cp.errors] == ["a", "b"] and "q" in cp.features
