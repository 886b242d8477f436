"""Models learnt from all rows: shards of them are learnt from in parallel, parameters are averaged after each round.

Rows are dealt to shards by a hash of their id; their number follows from the rows and the length of their texts, so
a task's share is bounded whatever the input.  The driver holds one model at a time; it goes out as a broadcast that
ends with its round and comes back in small blocks, a partition of them at a time.
"""
import zlib
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.gram import FAN_IN
from foldwise.session import materialize

#: Rows, and bytes of text, of about one shard.
SHARD_ROWS = 25_000
SHARD_BYTES = 256 << 20
#: Numbers of a block in which sums of vectors are handed on: no large object in the driver's JVM.
CELLS = 1 << 15
#: Passes of a shard over its rows between two averages.
PASSES = 2
#: A piece of a vector: the vector's number, the piece's start and length, its weight, the places held as bits, the kind
#: of their numbers and these; of a sum also the weight at each place held.
PART = "k int, at int, n int, weight double, places binary, kind string, block binary, weights binary"
PART_SCHEMA = pa.schema([("k", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("weight", pa.float64()), ("places", pa.binary()), ("kind", pa.string()), ("block", pa.binary()), ("weights", pa.binary())])


def n_shards(rows: DataFrame, text: str) -> int:
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(f"`{text}`").cast("binary"))).alias("bytes")).first()
    return max(1, -(-found["n"] // SHARD_ROWS), -(-(found["bytes"] or 0) // SHARD_BYTES))


def deal(rows: DataFrame, shards: int, row_id: str = "__id") -> DataFrame:
    """One row an id, in ``shards`` partitions by it, sorted there and pinned."""
    return materialize(rows.repartition(shards, row_id).dropDuplicates([row_id]).sortWithinPartitions(row_id))


def packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def unpacked(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=dtype)


def planes(values: np.ndarray) -> bytes:
    """First bytes of all numbers, then second ones and so on, packed: exponents are much alike."""
    values = np.ascontiguousarray(values)
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def from_planes(data: bytes, kind: str) -> np.ndarray:
    held = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(held.T).view(kind).ravel()


def part_row(k: int, at: int, weight: float, values: np.ndarray, there: np.ndarray, weights: np.ndarray | None = None) -> pa.RecordBatch:
    """The values of the places ``there``, in their own kind."""
    row = (k, at, len(values), weight, np.packbits(there).tobytes(), values.dtype.str, planes(values[there]), None if weights is None else planes(weights[there]))
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, PART_SCHEMA)], schema=PART_SCHEMA)


def there_and_values(n: int, places: bytes, kind: str, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.unpackbits(np.frombuffer(places, np.uint8), count=n).astype(bool), from_planes(block, kind)


def _add(batches) -> Iterator[pa.RecordBatch]:
    """For parts sorted by k and at: one part for each, the sum of all, each times its weight, and a weight for each place."""
    now, total, weights = None, None, None
    for batch in batches:
        for at in range(batch.num_rows):
            part = {name: batch.column(name)[at].as_py() for name in PART_SCHEMA.names}
            if (part["k"], part["at"]) != now:
                if now is not None:
                    yield part_row(*now, 1.0, total, weights != 0, weights)
                now, total, weights = (part["k"], part["at"]), np.zeros(part["n"]), np.zeros(part["n"])
            there, values = there_and_values(part["n"], part["places"], part["kind"], part["block"])
            total[there] += part["weight"] * values.astype(np.float64)
            weights[there] += part["weight"] if part["weights"] is None else from_planes(part["weights"], "<f8")
    if now is not None:
        yield part_row(*now, 1.0, total, weights != 0, weights)


def sum_blocks(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """One part for each k and at: the weighted sum of all.  Those of many ``tasks`` are first added in groups."""
    if tasks and tasks > FAN_IN:
        group = F.pmod(F.spark_partition_id(), F.lit(max(2, int(tasks**0.5))))
        parts = parts.withColumn("_group", group).repartition("k", "at", "_group").sortWithinPartitions("k", "at", "_group").drop("_group").mapInArrow(_add, PART)
    return parts.repartition("k", "at").sortWithinPartitions("k", "at").mapInArrow(_add, PART)


def shard_sum(rows: DataFrame, shards: int, work: Callable[[dict, int], tuple[float, Iterable]]) -> tuple[float, list[dict]] | None:
    """``work`` maps a shard's columns (lists by name) and its number to a weight and vectors; the sum of the weights,
    and for each vector what ``joined`` makes its weighted sum of.  A vector that comes with a mask is shuffled at the
    mask's places only, one without where it is not zero, in its own kind; sums are of doubles.  None without rows."""
    names = rows.columns

    def run(batches) -> Iterator:
        held = {n: [] for n in names}
        for batch in batches:
            for n, column in zip(names, batch.columns):
                held[n] += column.to_pylist()
        if held[names[0]]:
            weight, vectors = work(held, TaskContext.get().partitionId())
            yield part_row(-1, 0, 1.0, np.array([weight]), np.array([True]))
            for k, vector in enumerate(vectors):
                vector, there = vector if isinstance(vector, tuple) else (vector, vector != 0)
                for at in range(0, max(1, len(vector)), CELLS):
                    yield part_row(k, at, weight, vector[at:at + CELLS], there[at:at + CELLS])

    found: dict[int, dict[int, tuple]] = {}
    for row in sum_blocks(rows.mapInArrow(run, PART), shards).toLocalIterator():
        found.setdefault(row["k"], {})[row["at"]] = (row["n"], bytes(row["places"]), bytes(row["block"]), bytes(row["weights"]))
    if not found:
        return None
    weight = float(from_planes(found.pop(-1)[0][2], "<f8")[0])
    return weight, [found[k] for k in sorted(found)]


def joined(parts: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The weighted sum of a vector and the weights at its places; takes the pieces."""
    sums, weights = (np.zeros(sum(n for n, *_ in parts.values())) for _ in range(2))
    for at in sorted(parts):
        n, places, *blocks = parts.pop(at)
        for out, block in zip((sums, weights), blocks):
            there, values = there_and_values(n, places, "<f8", block)
            out[at:at + n][there] = values
    return sums, weights


def numbers(a) -> np.ndarray:
    return np.ravel(np.asarray(a, dtype=np.float64))


def moved(new, old) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of an array (in its own kind) or a number, and which of them moved."""
    return (np.ravel(new) if isinstance(new, np.ndarray) else numbers(new)), numbers(new) != numbers(old)


def _mean(old, weight: float, total: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shards that did not move a number hold it as it was."""
    total += (weight - weights) * numbers(old)
    total /= weight
    return total


def rounds_of(passes: int, epochs: int, shards: int) -> int:
    """A single shard makes its passes in one task; several meet after ``PASSES`` each, small ones after more."""
    return max(1, min(passes, epochs) // PASSES) if shards > 1 else 1


def shaped(vector: np.ndarray, like):
    """In the shape and kind of ``like``; numbers stay numbers."""
    return vector.reshape(like.shape).astype(like.dtype) if isinstance(like, np.ndarray) else float(vector[0])


def averaged(rows: DataFrame, shards: int, start: list, rounds: int, learn: Callable[[list, dict, np.random.Generator], list], seed: int) -> list:
    """``learn`` moves a model (a list of arrays and numbers) by a shard's rows; after each round the shards' models
    become their mean, weighted by rows.  A shard hands on the numbers that it moved, an array's in its own kind."""
    for turn in range(rounds):
        model = rows.sparkSession.sparkContext.broadcast(start)

        def work(held, shard, model=model, turn=turn):
            own = learn([a.copy() if isinstance(a, np.ndarray) else a for a in model.value], held, np.random.default_rng([seed, turn, shard]))
            # the rows of words that a shard lacks have not moved
            return float(len(next(iter(held.values())))), (moved(a, b) for a, b in zip(own, model.value))

        try:
            found = shard_sum(rows, shards, work)
        finally:
            model.destroy()
        if found is None:
            return start
        weight, vectors = found
        start = [shaped(_mean(a, weight, *joined(parts)), a) for a, parts in zip(start, vectors)]
    return start
