"""Sinks and small selection helpers."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from foldwise.operators.folds import FORWARD, KFOLD, STRATIFIED, choose_fold_kind
from foldwise.sources import sinks as K


def test_fold_kind_choice():
    assert choose_fold_kind("classification", True) == FORWARD
    assert choose_fold_kind("classification", False) == STRATIFIED
    assert choose_fold_kind("regression", False) == KFOLD


def test_versioned_matrix_and_outputs(spark):
    base = tempfile.mkdtemp(prefix="fw-sink-")
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "id long, x double")
    p1 = K.write_matrix(df, f"{base}/m", 1)
    p2 = K.write_matrix(df.filter("id < 5"), f"{base}/m", 2)   # never overwrites the input version
    assert spark.read.parquet(p1).count() == 10 and spark.read.parquet(p2).count() == 5
    K.write_output_csv(df, f"{base}/out", order_by="id", single_file=True)
    files = [f for f in os.listdir(f"{base}/out") if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(f"{base}/out/{files[0]}").read().splitlines()
    assert lines[0] == "id,x" and lines[1].startswith("0,")
    K.write_scores_json(df.limit(2), f"{base}/scores")
    rec = [json.loads(l) for f in os.listdir(f"{base}/scores") if f.endswith(".json")
           for l in open(f"{base}/scores/{f}")]
    assert len(rec) == 2


def test_partitioned_predictions(spark):
    base = tempfile.mkdtemp(prefix="fw-preds-")
    p = spark.createDataFrame([("oof", "a", 1, 0, 0.1), ("oof", "b", 1, 0, 0.2), ("test", "a", 2, None, 0.3)],
                              "kind string, model string, row_id long, fold int, pred double")
    K.write_predictions(p, f"{base}/preds")
    assert {"kind=oof", "kind=test"} <= set(os.listdir(f"{base}/preds"))
    back = K.read_predictions(spark, f"{base}/preds", "oof", ["a"])
    assert [r["pred"] for r in back.collect()] == [0.1]
    # rewriting one partition leaves the others in place
    K.write_predictions(p.filter("kind = 'test'").withColumn("pred", F.lit(0.9)), f"{base}/preds")
    assert K.read_predictions(spark, f"{base}/preds", "oof").count() == 2
    assert K.read_predictions(spark, f"{base}/preds", "test").first()["pred"] == 0.9
