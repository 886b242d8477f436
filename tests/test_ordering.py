"""Distributed ordering primitives against direct computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import ordering as O


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    a = np.round(rng.normal(size=500), 2)
    b = rng.integers(0, 5, 500).astype(float)
    rows = [(int(i), float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "rid long, a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    exp = {"a": np.quantile(a, probs), "b": np.quantile([r[2] for r in rows if r[2] is not None], probs)}
    for got in (O.quantiles(df, ["a", "b"], probs), O.quantiles(df, ["a", "b"], probs, O.value_counts(df, ["b", "a"]))):
        for c in ("a", "b"):
            assert got[c] == pytest.approx(list(exp[c]), abs=1e-12)


def test_hash_positions_do_not_depend_on_partitions_or_prefix(spark):
    df = spark.range(500).select(F.col("id").alias("rid"), (F.col("id") % 3).alias("g"))
    hashed = F.md5(F.col("rid").cast("string"))
    order = sorted(range(500), key=lambda k: __import__("hashlib").md5(str(k).encode()).hexdigest())
    want = {k: i for i, k in enumerate(order)}
    for parts, digits in ((1, 1), (7, 4), (3, 0)):
        got = O.with_hash_position(df.repartition(parts), hashed, "rid", "pos", digits=digits) if digits else O.with_position(df.repartition(parts), [hashed, F.col("rid")], "pos")
        assert {r["rid"]: r["pos"] for r in got.collect()} == want
    grouped = O.with_hash_position(df, hashed, "rid", "pos", partition_by=["g"]).collect()
    for g in range(3):
        assert [r["rid"] for r in sorted((r for r in grouped if r["g"] == g), key=lambda r: r["pos"])] == [k for k in order if k % 3 == g]


def test_first_rows_and_file_order(spark, tmp_path):
    from foldwise.sources import files as S

    df = spark.range(1000).select(F.col("id").alias("k"))
    df.repartitionByRange(7, "k").write.parquet(str(tmp_path / "p"))
    df.coalesce(1).write.option("header", "true").csv(str(tmp_path / "c"))
    numbered = S.with_row_order(spark.read.parquet(str(tmp_path / "p")))
    assert sorted((r["k"], r["_row"]) for r in numbered.collect()) == [(k, k) for k in range(1000)]
    for n in (0, 1, 130, 5000):
        for kind, path in (("parquet", "p"), ("csv", "c")):
            got = S.load_table(spark, str(tmp_path / path), kind, nrows=n).collect()
            assert sorted(r["k"] for r in got) == list(range(min(n, 1000)))


def test_exact_quantiles_all_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "rid int, x double")
    assert O.quantiles(df, ["x"], [0.5]) == {"x": [None]}


def test_position_and_running_sums(spark):
    rng = np.random.default_rng(3)
    g = rng.integers(0, 3, 300)
    v = rng.permutation(300)
    df = spark.createDataFrame([(int(i), int(gi), int(vi)) for i, (gi, vi) in enumerate(zip(g, v))],
                               "rid long, g int, v long").repartition(5)
    pos = {r["rid"]: r["p"] for r in O.with_position(df, ["v", "rid"], "p", partition_by=["g"], max_groups=3)
           .collect()}
    for gi in range(3):
        idx = [i for i in range(300) if g[i] == gi]
        order = sorted(idx, key=lambda i: v[i])
        assert [pos[i] for i in order] == list(range(len(idx)))
    cs = O.running_sums(df.withColumn("one", F.lit(1)), ["v", "rid"], ["one"], partition_by=["g"]).collect()
    assert all(r["one_cum"] == pos[r["rid"]] + 1 for r in cs)
