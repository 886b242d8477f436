"""In-fold encodings as ``pyspark.ml`` stages that can be saved.

``InFoldEncoder`` fits, for every fold at once, the statistics that encode the
fold (``infold.fold_statistics``); its model holds them as a table, one row a
(fit fold, key).  ``transform`` gives each row its own fold's encoding, from
rows of other folds only, and, for rows of no fold, that of all training
rows; ``expand`` gives every (row, fit fold) pair that training needs.  The
table is what is written and read back, as Parquet, so its size is bounded by
no driver.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsReadable, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.folds import KFOLD, fit_mask
from foldwise.operators.infold import Deferred, check_ops, encode_value, fold_statistics
from foldwise.session import lookup_join, materialize, size_checked_broadcast

#: The fit fold of statistics over all rows.
ALL_ROWS = -1


class _EncoderParams(Params):
    operation = Param(Params._dummy(), "operation", "target_encode, group_mean_encode or group_std_encode", TypeConverters.toString)
    inputCols = Param(Params._dummy(), "inputCols", "the key, and the value of a group encoding", TypeConverters.toListString)
    targetCol = Param(Params._dummy(), "targetCol", "the target", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "the encoding", TypeConverters.toString)
    foldCol = Param(Params._dummy(), "foldCol", "each training row's fold", TypeConverters.toString)
    numFolds = Param(Params._dummy(), "numFolds", "number of folds", TypeConverters.toInt)
    foldKind = Param(Params._dummy(), "foldKind", "kind of the folds", TypeConverters.toString)

    def _op(self) -> Deferred:
        return Deferred(self.getOrDefault("operation"), tuple(self.getOrDefault("inputCols")), self.getOrDefault("outputCol"))


class InFoldEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, operation: str = "target_encode", inputCols: list[str] | None = None, targetCol: str = "y", outputCol: str = "encoded",
                 foldCol: str = "fold", numFolds: int = 5, foldKind: str = KFOLD):
        super().__init__()
        self._setDefault(operation="target_encode", targetCol="y", outputCol="encoded", foldCol="fold", numFolds=5, foldKind=KFOLD)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "InFoldEncoderModel":
        op, target = self._op(), self.getOrDefault("targetCol")
        check_ops([op])
        fold, k, kind = self.getOrDefault("foldCol"), self.getOrDefault("numFolds"), self.getOrDefault("foldKind")
        rows = dataset.select(F.col(fold).alias("fold"), F.col(op.key()).alias("key"), F.col(op.value(target)).cast("double").alias("value"))
        by_key, overall = fold_statistics(rows, "key", "value", k, kind)
        whole_key, whole = fold_statistics(rows.withColumn("fold", F.lit(0)), "key", "value", 2, KFOLD)  # fit fold 1 trains on all
        every = lambda of, all_rows: of.unionByName(all_rows.filter("fit_fold = 1").withColumn("fit_fold", F.lit(ALL_ROWS)))
        keyed = every(by_key, whole_key).filter(F.col("key").isNotNull()).withColumn("overall", F.lit(False))
        alone = every(overall, whole).withColumn("key", F.lit(None).cast(keyed.schema["key"].dataType)).withColumn("overall", F.lit(True))
        model = InFoldEncoderModel(stats=materialize(keyed.unionByName(alone.select(*keyed.columns))))
        return self._copyValues(model)


class InFoldEncoderModel(Model, _EncoderParams, MLReadable, MLWritable):
    """``stats``: (fit_fold, key, n, mean, sd, overall)."""

    def __init__(self, stats: DataFrame | None = None):
        super().__init__()
        self.stats = stats

    def _encode(self, rows: DataFrame, fit_fold) -> DataFrame:
        op = self._op()
        stats, small = size_checked_broadcast(self.stats.filter("not overall").select(
            F.col("fit_fold").alias("_en_fold"), F.col("key").alias("_en_key"), *[F.col(c).alias(f"_en_{c}") for c in ("n", "mean", "sd")]))
        overall = self.stats.filter("overall").select(F.col("fit_fold").alias("_en_of"), F.col("mean").alias("_en_gmean"), F.col("sd").alias("_en_gsd"))
        out = rows.withColumn("_en_fit", fit_fold)
        out = lookup_join(out, stats, op.key(), "_en_key", small, (out["_en_fit"] == stats["_en_fold"],))
        out = out.join(F.broadcast(overall), F.col("_en_fit") == F.col("_en_of"), "left")  # a row a fold
        value = encode_value(op.operation, *[F.col(f"_en_{c}") for c in ("n", "mean", "sd", "gmean", "gsd")])
        return out.withColumn(op.output_name, value.cast("double")).drop(*[c for c in out.columns if c.startswith("_en_")])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fold = self.getOrDefault("foldCol")
        own = F.coalesce(F.col(fold).cast("int"), F.lit(ALL_ROWS)) if fold in dataset.columns else F.lit(ALL_ROWS)
        return self._encode(dataset, own)

    def expand(self, dataset: DataFrame) -> DataFrame:
        """One row per fit fold that a row trains or is held out of, with ``fit_fold`` and ``heldout``."""
        j, f = F.col(self.getOrDefault("foldCol")), F.col("fit_fold")
        rows = dataset.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.getOrDefault("numFolds") - 1))).alias("fit_fold"))
        rows = rows.filter(fit_mask(j, f, self.getOrDefault("foldKind")) | (j == f)).withColumn("heldout", F.coalesce(j == f, F.lit(False)))
        return self._encode(rows, F.col("fit_fold"))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: InFoldEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.stats.write.mode("overwrite").parquet(f"{path}/stats")


class _ModelReader(MLReader):
    def load(self, path: str) -> InFoldEncoderModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = InFoldEncoderModel(stats=self.sparkSession.read.parquet(f"{path}/stats"))
        DefaultParamsReader.getAndSetParams(model, metadata)
        model._resetUid(metadata["uid"])
        return model
