"""Sums of matrix blocks that tasks hand on.

A block is a row (a, b, c, height, block): a key of three numbers and a matrix
of doubles as bytes.  Tasks add up what they see and hand on one block a key;
``sum_blocks`` adds the tasks' blocks of a key, streaming, with one block in
memory at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "a int, b int, c int, height int, block binary"
BLOCK_SCHEMA = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int32()), ("height", pa.int32()), ("block", pa.binary())])
#: Tasks from which their blocks of a key are first added in groups.
FAN_IN = 128


def block_row(a: int, b: int, c: int, values: np.ndarray) -> pa.RecordBatch:
    values = np.ascontiguousarray(values, dtype=np.float64)
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((a, b, c, values.shape[0], values.tobytes()), BLOCK_SCHEMA)], schema=BLOCK_SCHEMA)


def _add(batches):
    """For rows sorted by key: one row a key."""
    now, height, total = None, 0, None
    for batch in batches:
        for a, b, c, h, block in zip(*(batch.column(k) for k in range(5))):
            key = (a.as_py(), b.as_py(), c.as_py())
            values = np.frombuffer(block.as_buffer(), dtype=np.float64)
            if key != now:
                if now is not None:
                    yield block_row(*now, total.reshape(height, -1))
                now, height, total = key, h.as_py(), values.copy()
            else:
                total += values
    if now is not None:
        yield block_row(*now, total.reshape(height, -1))


def sum_blocks(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """One block a key: the sum of all blocks of that key.  With many
    ``tasks``, blocks of a key are first added in groups of them."""
    if tasks and tasks > FAN_IN:
        group = F.pmod(F.spark_partition_id(), F.lit(max(2, int(tasks**0.5))))
        blocks = blocks.withColumn("_group", group).repartition("a", "b", "c", "_group").sortWithinPartitions("a", "b", "c", "_group").drop("_group").mapInArrow(_add, BLOCK)
    return blocks.repartition("a", "b", "c").sortWithinPartitions("a", "b", "c").mapInArrow(_add, BLOCK)
