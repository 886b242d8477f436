"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a few bits through BK-trees.

Distinct fingerprints are dealt to shards whose members agree on one of ``radius + 1`` bit blocks: two
fingerprints within the radius agree on at least one block, so each link falls inside a shard.  A shard over
``SHARD_NODES`` members is dealt anew by blocks of the bits that its members may still differ in; their number
shrinks at each level, so the last level holds few enough by itself and nothing is left out.  Each shard is one
BK-tree: children keyed by the integer Hamming distance to their parent; a search follows only edges whose key is
within the radius of the distance at hand.  A shard hands on a spanning forest of its links, not all pairs.
"""
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import per_text, space_words
from foldwise.llm.components import connected_components
from foldwise.session import materialize

SHARD_NODES = 4096
SEED = 42
_BATCH = 1 << 18

FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint; a bit is 1 if over half of the shingles' hashes have it; no words give 0."""
    words = space_words(text or b"")
    if not words:
        return 0
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BATCH):
        part = words[at:at + _BATCH + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle))) if len(words) >= shingle else [words]
        h = np.array([hashed(join(g), SEED) for g in grams], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _worker(shingle: int):
    def make():
        return lambda texts: [(_signed(fingerprint(x, shingle)),) for x in texts]

    return make


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long in ``out`` (null and empty texts: 0)."""
    made = per_text(_worker(shingle), FINGERPRINT)(F.col(f"`{text}`"))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    return docs.select(*kept, made.alias("__made")).withColumn(out, F.col("__made.fp")).drop("__made")


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self, value: int):
        self.values = [value]
        self.children: list[dict[int, int]] = [{}]

    def add(self, value: int) -> None:
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return
            at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values within the radius."""
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) <= 2 * radius + 1:
                todo += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``radius`` among distinct ``values``."""
    tree, parent, links = BKTree(values[0]), [0], []

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, value in enumerate(values[1:], 1):
        parent.append(k)
        for near in tree.within(value, radius):
            if (r := top(near)) != top(k):
                parent[r] = top(k)
                links.append((tree.values[near], value))
        tree.add(value)
    return links


def _masks(held: int, parts: int) -> list[int]:
    """Bit masks that add one of ``parts`` even blocks of the bits outside ``held``."""
    free = [b for b in range(64) if not held >> b & 1]
    return [held | sum(1 << b for b in block.tolist()) for block in np.array_split(np.array(free, dtype=int), parts) if len(block)]


def _search(radius: int):
    """For batches sorted by shard: one BK-tree a shard, whose links go on.  A shard has a bounded number of rows."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        mask = value = fp = np.zeros(0, dtype=np.int64)
        for last, batch in _with_end(batches):
            if batch is not None:
                mask, value, fp = (np.concatenate([x, batch.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate((mask, value, fp)))
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1 if len(fp) else np.zeros(0, dtype=int)
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            done = len(bounds) - 1 if last else len(bounds) - 2
            links = []
            for k in np.flatnonzero(np.diff(bounds[:done + 1]) > 1):
                links += shard_links((fp[bounds[k]:bounds[k + 1]].view(np.uint64)).tolist(), radius)
            keep = bounds[done] if not last else len(fp)
            mask, value, fp = mask[keep:], value[keep:], fp[keep:]
            if links:
                pairs = np.array(links, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    return run


def _with_end(batches):
    for batch in batches:
        yield False, batch
    yield True, None


def near_links(prints: DataFrame, fp: str = "fp", radius: int = 2, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """(a, b): links that span each component of distinct fingerprints within ``radius`` bits (radius 0 to 20)."""
    level = [(0, m) for m in _masks(0, radius + 1)]
    rows = prints.select(F.col(fp).alias("fp")).distinct()
    found = None
    while True:
        # `held` is the mask a row comes with; its successors add one block each
        choices = F.array(*[F.struct(F.lit(_signed(h)).alias("held"), F.lit(_signed(m)).alias("mask")) for h, m in level])
        if found is None:
            dealt = rows.select("fp", F.explode(F.transform(choices, lambda c: c["mask"])).alias("mask"))
        else:
            dealt = rows.select("fp", F.explode(F.transform(F.filter(choices, lambda c: c["held"] == F.col("mask")), lambda c: c["mask"])).alias("mask")).distinct()
        dealt = dealt.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        sizes = dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > shard_nodes)
        free = 64 - min(m.bit_count() for _, m in level)
        hot = materialize(sizes.select("mask", "value")) if 1 << free > shard_nodes else None
        crowded = hot is not None and not hot.isEmpty()
        fit = dealt.join(hot, ["mask", "value"], "left_anti") if crowded else dealt
        links = fit.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_search(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if not crowded:
            return found
        rows = dealt.join(hot, ["mask", "value"], "left_semi").select("mask", "fp")
        level = [(m, deeper) for _, m in level for deeper in _masks(m, radius + 1)]


def near_duplicates(prints: DataFrame, *, doc_id: str = "doc_id", fp: str = "fp", radius: int = 2) -> DataFrame:
    """(fp, component_id, component_fp) for every distinct fingerprint of ``prints``: the smallest ``doc_id``
    reachable over links of at most ``radius`` differing bits, and the component's smallest fingerprint.

    Repeated rows add nothing; null ids are never the smallest (a component of null ids alone has a null
    component_id); texts without words share fingerprint 0; an empty table gives an empty one.
    """
    each = materialize(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")))
    linked = connected_components(near_links(each, "fp", radius), "a", "b")
    linked = linked.select(F.col("node").alias("fp"), "root")
    best = each.join(linked, "fp").groupBy("root").agg(F.min("least").alias("best"))
    named = linked.join(best, "root")
    return each.join(named, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("best")).alias("component_id"), F.coalesce("root", "fp").alias("component_fp"))


def simhash_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), fingerprint (16 hex digits), component_id, component_fp."""
    prints = materialize(fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", shingle).select("doc_id", "fp"))
    # written out first, so that a fingerprint of very many documents meets it in a plain join, which Spark can split
    groups = materialize(near_duplicates(prints, radius=radius))
    return prints.join(groups, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_fp")


def keep_one_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id (null ids last; among rows of one
    id the smallest fingerprint, among equal rows any).  Columns stay as they are."""
    groups = simhash_groups(docs, doc_id=doc_id, text=text, shingle=shingle, radius=radius)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), F.col("fp").alias("fp")))
    keep = groups.groupBy("component_fp").agg(first.alias("k")).select(F.col("k.none").alias("__none"), F.col("k.id").alias("__id"), F.col("k.fp").alias("__fp"))
    marked = fingerprints(docs, text, shingle, "__fp").withColumn("__none", F.col(f"`{doc_id}`").isNull()).withColumn("__id", F.coalesce(F.col(f"`{doc_id}`"), F.lit(0).cast("bigint")))
    keys = ["__none", "__id", "__fp"]
    return marked.join(keep, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])
