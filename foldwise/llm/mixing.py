"""Mixing sources to target weights by Pfair scheduling of blocks.

The mix follows a fluid in which every source flows at a rate proportional to its weight and, once it has no blocks
left, hands its share on to the rest.  T(v) = sum of min(w v, n) over the sources is the slot that the fluid reaches
when v units have flowed for each unit of weight.  Block k (from 1) of a source with weight w is released at slot
floor(T((k - 1) / w)) and due at slot ceil(T(k / w)): while no source has ended, that is floor((k - 1) / share) and
ceil(k / share).  Earliest deadline first over released blocks serves every block inside its window, which keeps each
source less than one block away from its share at any slot.  Weights are taken exactly, as rational numbers.  The
slots come one after another on the driver, which holds the sources and ``PLAN_ROWS`` blocks at a time; every document
has its place: none is dropped or repeated.
"""
import heapq
from bisect import bisect_left
from fractions import Fraction
from itertools import accumulate, islice
from math import gcd, lcm
from typing import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import scratch_folder
from foldwise.session import size_checked_broadcast

BLOCK_DOCS = 32
BUCKET_DOCS = 1_000
#: Blocks of the schedule that the driver holds at a time; a longer schedule goes through files.
PLAN_ROWS = 1_000_000
REST = "(rest)"


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of all blocks by slot.  Sources of no weight come after all others,
    in equal shares."""
    left = {s: n for s, n in blocks.items() if n > 0}
    start = 0
    for part in ({s: Fraction(weights[s]) for s in left if weights[s] > 0}, {s: Fraction(1) for s in left if not weights[s] > 0}):
        for s, k, release, deadline, slot in _earliest_deadline_first({s: left[s] for s in part}, part):
            yield s, k, start + release, start + deadline, start + slot
        start += sum(left[s] for s in part)


def _earliest_deadline_first(blocks: dict[str, int], weights: dict[str, Fraction]) -> Iterator[tuple[str, int, int, int, int]]:
    names = sorted(blocks, key=lambda s: (blocks[s] / weights[s], s))  # by the end of their flow
    scale = lcm(*[weights[s].denominator for s in names])
    whole = [weights[s].numerator * (scale // weights[s].denominator) for s in names]
    common = gcd(*whole) or 1
    w, n = [x // common for x in whole], [blocks[s] for s in names]
    ends = [a / b for a, b in zip(n, w)]
    served = [0, *accumulate(n)]  # by the sources before
    active = [*accumulate(w[::-1])][::-1]  # weight of a source and those that end later

    def flowed(i: int, k: int) -> tuple[int, int]:
        """T(k / w[i]), rounded down and up; floats only find about where, integers decide."""
        p = min(bisect_left(ends, k / w[i]), i)
        while p and n[p - 1] * w[i] >= k * w[p - 1]:
            p -= 1
        while p < i and n[p] * w[i] < k * w[p]:
            p += 1
        whole, part = divmod(k * active[p], w[i])
        return served[p] + whole, served[p] + whole + (part > 0)

    waiting = [(0, i, 1) for i in range(len(names))]  # a heap: sorted
    ready: list[tuple[int, int, int, int, int]] = []
    for slot in range(served[-1]):
        while waiting and waiting[0][0] <= slot:
            release, i, k = heapq.heappop(waiting)
            then, deadline = flowed(i, k)
            heapq.heappush(ready, (deadline, i, k, release, then))
        deadline, i, k, release, then = heapq.heappop(ready)
        yield names[i], k, release, deadline, slot
        if k < n[i]:
            heapq.heappush(waiting, (then, i, k + 1))


PLAN = pa.schema([("mix_source", pa.string()), ("block", pa.int64()), ("release", pa.int64()), ("deadline", pa.int64()), ("slot", pa.int64())])


def plan_table(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """The rows of a schedule as a frame: from memory up to PLAN_ROWS, else from files written part by part."""
    rows, folder = iter(rows), None
    part = list(islice(rows, PLAN_ROWS))
    while True:
        following = list(islice(rows, PLAN_ROWS))
        frame = spark.createDataFrame(pa.table([pa.array(x, t) for x, t in zip(zip(*part) if part else [[]] * len(PLAN), PLAN.types)], schema=PLAN))
        if not following and folder is None:
            return frame
        folder = folder or scratch_folder(spark, "mix")
        frame.write.mode("append").parquet(folder)
        if not following:
            return spark.read.parquet(folder)
        part = following


def default_weights(counts: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Targets between even (power 0) and proportional (power 1) shares of the documents."""
    return {s: float(n) ** power for s, n in counts.items()}


def numbered(docs: DataFrame, counts: DataFrame, group: str, order_id: str) -> DataFrame:
    """``docs`` with ``nr`` (from 0) within ``group`` in order of a hash of ``order_id``.  Rows are numbered inside
    hash buckets of about BUCKET_DOCS rows, as many as the group's row of ``counts`` (group, n) asks for, and buckets offset
    by the counts before them, so no group meets in one task."""
    buckets, _ = size_checked_broadcast(counts.select(F.col(group).alias("__group"), F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_DOCS)).alias("__buckets")))
    rows = docs.join(buckets, F.col(group) == F.col("__group")).drop("__group")
    rows = rows.withColumn("__h", F.xxhash64(order_id)).withColumn("__bucket", F.pmod(F.col("__h"), F.col("__buckets"))).drop("__buckets")
    sizes = rows.groupBy(group, "__bucket").agg(F.count("*").alias("n"))
    # one row per group and bucket: sums over it are small
    before = sizes.alias("x").selectExpr(f"{group}", "__bucket", f"sum(n) over (partition by {group} order by __bucket rows between unbounded preceding and 1 preceding) as __before")
    within = rows.selectExpr("*", f"row_number() over (partition by {group}, __bucket order by __h, {order_id}) - 1 as __nr")
    return within.join(before, [group, "__bucket"]).withColumn("nr", F.coalesce("__before", F.lit(0)) + F.col("__nr")).drop("__h", "__bucket", "__before", "__nr")


def pfair_mix(docs: DataFrame, *, source: str = "source", doc_id: str = "doc_id", weights: dict[str, float] | None = None, power: float = 0.5,
              block_docs: int = BLOCK_DOCS, out: str = "mix") -> DataFrame:
    """``docs`` with a struct column ``out``: source (the group mixed), block (from 1, within the source), release, deadline
    (in slots of the whole mix), slot, position (slot * block_docs + place in the block; unique and rising through the mix).

    ``weights`` gives targets by source; without it, document counts to the ``power``.  Targets are met exactly.  Every source is
    mixed by its name.  Only sources that ``weights`` leaves out are mixed as one group REST, which takes the average of the
    other weights where none is given; all rows stay.  Null sources count as the source ''.  Rows of one id lie next to each
    other in an order left open; null ids hash alike; an empty table gives an empty one; an input column named ``out`` is
    replaced, all others pass through unchanged, whatever their names.
    """
    spark = docs.sparkSession
    columns = [c for c in docs.columns if c.lower() != out.lower()]
    group = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit(""))
    # group sizes: one row a source comes to the driver
    counts = {r.s: r.n for r in docs.select(group.alias("s")).groupBy("s").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if weights is not None:
        counts = {s: n for s, n in counts.items() if s in weights}
    rest = total - sum(counts.values())
    targets = {s: weights[s] for s in counts} if weights is not None else default_weights(counts, power)
    known = [s for s in counts if s != REST]
    if rest:
        average = sum(targets.values()) / len(targets) if targets else 1.0
        targets[REST] = weights.get(REST, average) if weights is not None else float(rest) ** power
        counts[REST] = counts.get(REST, 0) + rest
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    plan = plan_table(spark, schedule(blocks, targets))
    plan, _ = size_checked_broadcast(plan.withColumnRenamed("mix_source", "__source").withColumn("__at", F.col("block") - 1).select("__source", "__at", "release", "deadline", "slot"))
    # the input columns travel in one struct, so that no name of theirs meets a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), group.alias("mix_source"), F.col(f"`{doc_id}`").alias("__id"))
    if rest:
        named, _ = size_checked_broadcast(spark.createDataFrame(pa.table({"__known": pa.array(known, pa.string())})))
        rows = rows.join(named, F.col("mix_source") == F.col("__known"), "left").withColumn("mix_source", F.coalesce("__known", F.lit(REST))).drop("__known")
    rows = numbered(rows, spark.createDataFrame(pa.table({"mix_source": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})), "mix_source", "__id")
    rows = rows.withColumn("__block", F.floor(F.col("nr") / block_docs)).withColumn("__in", F.col("nr") % block_docs)
    wide = rows.join(plan, (rows["mix_source"] == plan["__source"]) & (rows["__block"] == plan["__at"]))
    made = F.struct(rows["mix_source"].alias("source"), (F.col("__block") + 1).alias("block"), plan["release"], plan["deadline"],
                    plan["slot"], (plan["slot"] * block_docs + F.col("__in")).alias("position"))
    return wide.select(*[F.col("__row")[c].alias(c) for c in columns], made.alias(out))
