"""Helpers that the operators share: table reads, tokens on bytes, per-task workers as Arrow UDFs."""
import uuid
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldwise.session import ensure_checkpoint_dir, prepare_session, size_checked_broadcast

#: ASCII letters to lower case, every other ASCII byte that is no digit to a space; bytes from 0x80 on belong to words.
ALNUM_TABLE = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the session's checkpoint directory, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def alnum_words(data: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; UTF-8 keeps bytes over 0x7F for longer characters."""
    return data.translate(ALNUM_TABLE).split()


def space_words(data: bytes, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``, the very bytes that ``bytes.split`` separates at; lower-casing is ASCII only."""
    return (data.lower() if lower else data).split()


def crc_bucket(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids get null."""
    return F.crc32(F.col(id_col).cast("string")) % mod


def per_text(make_worker: Callable[[], Callable[[list], list[tuple]]], schema: StructType) -> Callable[[Column], Column]:
    """A column function over texts.  ``make_worker`` runs once a task; what it returns maps a list of UTF-8
    texts (None for null) to one tuple of ``schema``'s fields each.  A struct column gives a tuple of its fields
    for each row instead, strings as UTF-8.  Marked non-deterministic only so that Spark never evaluates it twice
    (in a filter and again in a projection)."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.pandas.types import to_arrow_schema

    names = schema.names
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        worker = make_worker()
        for texts in batches:
            rows = []
            for at in range(0, len(texts), 512):
                part = texts.slice(at, 512)
                rows += worker(list(zip(*map(_plain, part.flatten()))) if pa.types.is_struct(part.type) else _plain(part))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names)

    return arrow_udf(run, returnType=schema).asNondeterministic()


def _plain(values: pa.Array) -> list:
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary())
    return values.to_pylist()


class Buckets(dict):
    """Word to hash value, kept for the words seen lately; at most ``limit`` of them."""

    def __init__(self, hashed: Callable[[bytes], int], limit: int = 400_000):
        super().__init__()
        self.hashed, self.limit = hashed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.hashed(word)
        return value


def labelled_rows(docs: DataFrame, labels: DataFrame, *, label: str, columns: list[str], doc_id: str, held_out: tuple[int, int]) -> DataFrame:
    """All labelled documents to learn from: ``__id``, ``columns`` and ``label`` (0 or 1).  Rows whose crc32 of the id
    is remainder ``held_out[1]`` modulo ``held_out[0]`` are never among them.  A document labelled twice counts with the
    larger label; null labels and ids are left out."""
    known = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias(label)).filter(F.col(label).isin(0, 1) & F.col("__id").isNotNull())
    known = known.filter(crc_bucket("__id", held_out[0]) != held_out[1]).groupBy("__id").agg(F.max(label).alias(label))
    known, _ = size_checked_broadcast(known)
    rest = docs.select(F.col(f"`{doc_id}`").alias("__id"), *[F.col(f"`{c}`") for c in columns])
    return rest.join(known, "__id")
