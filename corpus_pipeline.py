"""The corpus pipeline: quality, language, near duplicates, benchmark contamination, then the mix of sources."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import decontaminate, fm, language, mixing, simhash
from foldwise.llm.common import scratch_folder, table
from foldwise.session import prepare_session


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the first ``name`` with a number that no column has."""
    taken = {c.lower() for c in docs.columns}
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(taken) + 1))) if n not in taken)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good; it learns from those of ``docs`` that have a label."""
    prepare_session(spark)
    model = fm.train_quality(docs, table(spark, sf_dir, "labels"))
    out = free_name(docs, "__quality")
    return fm.quality_scores(docs, model, out=out).filter(F.col(out)["predicted"] == 1).drop(out)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough evidence; a document's source stands for its host."""
    prepare_session(spark)
    model = language.train_text_model(docs)
    out = free_name(docs, "__language")
    return language.language_fusion(docs, model, text="text", host="source", out=out).filter(F.col(out)["kept"]).drop(out)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id."""
    prepare_session(spark)
    return simhash.keep_one_each(docs, shingle=3, radius=2)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    prepare_session(spark)
    out = free_name(docs, "__found")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out=out).filter(~F.col(out)["contaminated"]).drop(out)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its block and place in the mix of sources (targets: square roots of their document counts);
    columns of the names that the stage adds are replaced."""
    prepare_session(spark)
    made = [f"mix_{n}" for n in ("block", "release", "deadline", "slot", "position")]
    columns = [c for c in docs.columns if c.lower() not in made]
    out = free_name(docs, "__mix")
    mixed = mixing.pfair_mix(docs.select(*[F.col(f"`{c}`") for c in columns]), out=out)
    return mixed.select(*[F.col(f"`{c}`") for c in columns], *[F.col(out)[n.removeprefix("mix_")].alias(n) for n in made])


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("simhash_dedup", dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("pfair_mix", mix_stage),
]

#: The classifier and the fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
