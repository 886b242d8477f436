"""Connected components of a graph given as a table of links, by alternating large-star and small-star steps."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import materialize


#: Links of one partition between rounds.
PARTITION_LINKS = 200_000


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node of the component.

    Each round hooks every node to the smallest neighbour it knows, so hubs are only ever reduced by min
    aggregates and joins, never gathered.  Rounds are checkpointed, in as many partitions as the links of the round
    before need, and end when the links stop changing; their number grows with the logarithm of the longest path.
    Self links and repeated links change nothing; links with a null end are left out; no links give an empty table.
    """
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = materialize(links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct())
    state = _state(links)
    while state[0]:
        parts = -(-state[0] // PARTITION_LINKS)
        links = links.coalesce(parts)
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = materialize(small.filter("u <> v").distinct().coalesce(parts))
        before, state = state, _state(links)
        if state == before:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
