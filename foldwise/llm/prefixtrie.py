"""Conversation prefix trie: what conversations share from their first turn on, counted in double-array tries.

A turn is a 128-bit digest of its role and text, a conversation the string of its turns' digests; texts themselves move
no further than their first projection.  Equal conversations become one path with a count, the smallest id and the digest of all their ids.
Paths are dealt to shards by a hash of their first turn; a shard that holds too much is dealt anew by the first two, four, ...
turns, so that from its split depth on every node lies in one shard.  There the turns get dense ids, the paths are
packed into BASE and CHECK arrays, and a walk over them gives the nodes with their sums.  The nodes above the split depth
are shared by several shards: their partial sums are merged over all shards, and then added up along their own ancestors.
"""
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.session import lookup_join, materialize, size_checked_broadcast

DIGEST = 16
#: Turns of one shard; ids of one piece of a node's id list (a power of two).
SHARD_TURNS = 8192
PIECE_BITS = 12
SLOT_TRIES = 32
NONE = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of a turn's role and text; no two different pairs give the same bytes."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * DIGEST)


def conversations(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns, as structs of turn, digest and bytes, in order of their number (null
    first; turns of one number in order of their digests).  Null roles and texts are empty; rows of a null id belong to no
    conversation; repeated rows are turns of their own.  A task holds the digests (not the texts) of a conversation's turns."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    each = rows.filter(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"),
        F.struct(F.col(f"`{turn}`").cast("bigint").alias("turn"), turn_digest(empty(role), empty(text)).alias("digest"), F.octet_length(empty(text)).cast("bigint").alias("bytes")).alias("t"))
    return each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, *, group: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, turns): conversation c gets the first h turns of conversation c - c % ``group`` (all if fewer, none if it is
    absent), then its own after its first h; h is the unsigned crc32 of the decimal c modulo ``heads``."""
    head = convs.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = convs.withColumn("own_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    met = own.join(head, F.col("own_base") == F.col("base"), "left")
    after = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    first = F.slice("head", F.lit(1), F.col("h"))
    return met.select("conv_id", F.when(F.col("head").isNull(), after).otherwise(F.concat(first, after)).alias("turns"))


PATHS = "path binary, sizes array<bigint>, n long, least long, ends string"
PATHS_SCHEMA = pa.schema([("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n", pa.int64()), ("least", pa.int64()), ("ends", pa.string())])


def _paths(batches):
    """For pieces sorted by path and id range: one row a path; its ids run through SHA-256 piece after piece."""
    now, held = None, None

    def row():
        path, sizes, n, least, ids = held
        return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([sizes], pa.list_(pa.int64())), pa.array([n], pa.int64()), pa.array([least], pa.int64()), pa.array([ids.hexdigest()])], schema=PATHS_SCHEMA)

    for rows in batches:
        for key, path, sizes, n, least, piece in zip(*(rows.column(k).to_pylist() for k in range(6))):
            if key != now:
                if now is not None:
                    yield row()
                now, held = key, [path, sizes, n, least, hashlib.sha256(piece.encode())]
            else:
                held[2] += n
                held[4].update(b"," + piece.encode())
    if now is not None:
        yield row()


def distinct_paths(convs: DataFrame, piece_bits: int = PIECE_BITS) -> DataFrame:
    """(path, sizes, n, least, ends) for each distinct sequence of turns: its digests, its texts' bytes, how many
    conversations it has, the smallest id, and the SHA-256 of all ids in order.  Ids are joined in pieces of a range of
    2 ** ``piece_bits`` ids; what a single task reads of a sequence that very many share is a row a piece."""
    made = convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    made = made.withColumn("key", F.sha2("path", 256))
    pieces = made.groupBy("key", F.shiftright("conv_id", piece_bits).alias("range")).agg(
        F.first("path").alias("path"), F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("least"),
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition("key").sortWithinPartitions("key", "range")
    return ordered.select("key", "path", "sizes", "n", "least", "ids").mapInArrow(_paths, PATHS)


class DoubleArray:
    """A trie over sequences of dense ids (from 0): the child of state s by id c is state BASE[s] + c, if its CHECK is s.
    State 0 is the root."""

    def __init__(self, sequences: list[list[int]]):
        """``sequences`` are distinct, and those of a common prefix lie next to each other, the prefix itself first."""
        base, check = [0], [0]
        free = 1

        def slot(state: int, ids: list[int]) -> int:
            """Sets the base of a state so that all its children's places are free."""
            nonlocal free
            while free < len(check) and check[free] >= 0:
                free += 1
            at = free
            for _ in range(SLOT_TRIES if len(ids) > 1 else 1):
                shift = at - ids[0]
                if all(shift + c >= len(check) or (shift + c > 0 and check[shift + c] < 0) for c in ids):
                    break
                at += 1
                while at < len(check) and check[at] >= 0:
                    at += 1
            else:
                shift = len(check) - ids[0]
            last = shift + ids[-1]
            if last >= len(check):
                more = last + 1 - len(check)
                base.extend([0] * more)
                check.extend([-1] * more)
            base[state] = shift
            for c in ids:
                check[shift + c] = state
            return shift

        todo = [(0, 0, len(sequences), 0)]
        while todo:
            state, a, b, depth = todo.pop()
            while a < b and len(sequences[a]) == depth:
                a += 1
            if a == b:
                continue
            starts, ids = [], []
            for k in range(a, b):
                c = sequences[k][depth]
                if not ids or ids[-1] != c:
                    ids.append(c)
                    starts.append(k)
            ends = [*starts[1:], b]
            shift = slot(state, sorted(ids))
            todo += [(shift + c, x, y, depth + 1) for c, x, y in zip(ids, starts, ends)]
        self.base, self.check = np.array(base, dtype=np.int64), np.array(check, dtype=np.int64)

    def step(self, states: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The children by these ids, -1 where there is none."""
        to = self.base[states] + ids
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def dense_ids(paths: list[bytes]) -> list[list[int]]:
    """Each path's turns by number; numbers are given depth by depth in the paths' order, so that siblings lie close."""
    split = [[p[k:k + DIGEST] for k in range(0, len(p), DIGEST)] for p in paths]
    numbers: dict[bytes, int] = {}
    live, depth = split, 0
    while live:
        live = [s for s in live if len(s) > depth]
        for s in live:
            numbers.setdefault(s[depth], len(numbers))
        depth += 1
    return [[numbers[t] for t in s] for s in split]


NODES = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "upper boolean, node binary, parent binary, bytes long, ancestors array<binary>")
NODES_SCHEMA = pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
                          ("ends_sha256", pa.string()), ("upper", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64()), ("ancestors", pa.list_(pa.binary()))])


def shard_nodes(split: int, rows: list[tuple]) -> pa.RecordBatch:
    """A shard's nodes.  From depth ``split`` on they are whole; only those of that depth name their parent by its
    key, since it may lie in other shards too.  Nodes above are partial: their children, leaves and savings count
    what lies from the split depth on."""
    rows = sorted(rows)
    paths = [r[0] for r in rows]
    sequences = dense_ids(paths)
    trie = DoubleArray(sequences)
    size = len(trie.check)
    lengths = np.array([len(s) for s in sequences])
    flat, first = np.array([c for s in sequences for c in s], dtype=np.int64), np.cumsum(lengths) - lengths
    sizes = np.array([b for r in rows for b in r[1]], dtype=np.int64)
    times, least = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    n, low = np.zeros(size, dtype=np.int64), np.full(size, np.iinfo(np.int64).max)
    sample, own_bytes = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    states = np.zeros(len(rows), dtype=np.int64)
    n[0], low[0] = times.sum(), least.min()
    levels, live, depth = [np.zeros(1, dtype=np.int64)], np.arange(len(rows)), 0
    while True:
        live = live[lengths[live] > depth]
        if not len(live):
            break
        at = first[live] + depth
        to = trie.step(states[live], flat[at])
        if (to < 0).any():
            raise AssertionError("a path is not in its trie")
        states[live] = to
        np.add.at(n, to, times[live])
        np.minimum.at(low, to, least[live])
        sample[to], own_bytes[to] = live, sizes[at]
        levels.append(np.unique(to))
        depth += 1
    children, leaves, saved = (np.zeros(size, dtype=np.int64) for _ in range(3))
    for depth in range(len(levels) - 1, -1, -1):
        at = levels[depth]
        if depth >= split:
            leaves[at[children[at] == 0]] = 1
            saved[at] += (n[at] - 1) * own_bytes[at]
        if depth:
            up = trie.check[at]
            if depth >= split:
                np.add.at(children, up, 1)
            np.add.at(leaves, up, leaves[at])
            np.add.at(saved, up, saved[at])
    ends = dict(zip(states.tolist(), (r[4] for r in rows)))
    states, depths = np.concatenate(levels), np.repeat(np.arange(len(levels)), [len(x) for x in levels])
    key = lambda s, d: hashlib.sha256(paths[sample[s]][:DIGEST * d]).digest()
    upper = depths < split
    chains: list = [None] * len(states)
    for k in np.flatnonzero(upper):
        chains[k] = [key(states[k], d) for d in range(depths[k] + 1)]
    up = trie.check[states]
    parents = [chains[k][-2] if upper[k] and d else key(states[k], d - 1) if d == split else None for k, d in enumerate(depths.tolist())]
    return pa.RecordBatch.from_arrays([
        pa.array(depths), pa.array(low[states]), pa.array(low[up], mask=depths <= split), pa.array(n[states]), pa.array(children[states]), pa.array(leaves[states]), pa.array(saved[states]),
        pa.array([ends.get(s, None if u else NONE) for s, u in zip(states.tolist(), upper)], pa.string()), pa.array(upper), pa.array([c and c[-1] for c in chains], pa.binary()), pa.array(parents, pa.binary()),
        pa.array(own_bytes[states]), pa.array(chains, pa.list_(pa.binary()))], schema=NODES_SCHEMA)


def _shards(batches):
    """For rows sorted by shard: each shard's nodes; a shard has a bounded number of turns, or a single path."""
    now, held = None, []
    for rows in batches:
        for split, bucket, *row in zip(*(rows.column(k).to_pylist() for k in range(7))):
            if (split, bucket) != now:
                if held:
                    yield shard_nodes(now[0], held)
                now, held = (split, bucket), []
            held.append(row)
    if held:
        yield shard_nodes(now[0], held)


def deal(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, int]:
    """(split, bucket, path, sizes, n, least, ends), and the number of shards: shards by a hash of a path's first
    ``split`` turns; those of more than twice ``shard_turns`` turns are dealt anew by twice as many turns."""
    turns = F.octet_length("path") / DIGEST
    total, longest = paths.agg(F.sum(turns), F.max(turns)).first()
    split, shards, rest, dealt = 1, 0, paths, None
    while True:
        buckets = max(1, int(-(-(total or 0) // shard_turns)))
        shards += buckets
        own = rest.withColumn("bucket", F.pmod(F.xxhash64(F.expr(f"substring(path, 1, {DIGEST * split})")), F.lit(buckets)))
        part = own.select(F.lit(split).alias("split"), "bucket", *paths.columns)
        hot = None
        if split < (longest or 0):
            hot = materialize(own.groupBy("bucket").agg(F.sum(turns).alias("t"), F.count("*").alias("k")).filter((F.col("t") > 2 * shard_turns) & (F.col("k") > 1)).select("bucket", "t"))
            total = hot.agg(F.sum("t")).first()[0]
        if hot is None or not total:
            return (part if dealt is None else dealt.unionByName(part)), shards
        # a row a crowded bucket; a shuffle by a bucket would gather it in one task
        named, _ = size_checked_broadcast(hot.select(F.col("bucket").alias("hot")))
        fit = part.join(named, F.col("bucket") == F.col("hot"), "left_anti")
        dealt = fit if dealt is None else dealt.unionByName(fit)
        rest = own.join(named, F.col("bucket") == F.col("hot"), "left_semi").select(*paths.columns)
        split *= 2


def prefix_trie(convs: DataFrame, *, shard_turns: int = SHARD_TURNS, piece_bits: int = PIECE_BITS) -> DataFrame:
    """The nodes of the trie over conversations (conv_id, turns) as ``conversations`` gives them: depth, conv_id (the smallest
    member), parent_conv_id (the parent's, null for the root), n_convs, n_children, n_leaves (childless nodes in the
    subtree, itself included), saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text),
    ends_sha256 (of the ids that end there, ascending, joined by commas).

    A conversation without turns is a member of the root alone.  No conversations give no node, not even the root.
    """
    spark = convs.sparkSession
    paths = materialize(distinct_paths(convs, piece_bits))
    dealt, shards = deal(paths, shard_turns)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards // 32)
    nodes = materialize(dealt.repartition(parts, "split", "bucket").sortWithinPartitions("split", "bucket").mapInArrow(_shards, NODES))
    shared = nodes.filter("upper").groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"), F.first("ancestors").alias("ancestors"), F.min("conv_id").alias("conv_id"),
        F.max("ends_sha256").alias("ends"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    below = shared.filter(F.col("parent").isNotNull()).groupBy("parent").agg(F.count("*").alias("shared_children")).withColumnRenamed("parent", "above")
    shared = materialize(shared.join(below, F.col("node") == F.col("above"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("shared_children", F.lit(0))).drop("above", "shared_children"))
    # a shared node's own leaf and savings go to all its ancestors, itself included
    own_leaf, own_saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("bytes")
    sums = shared.select(F.explode("ancestors").alias("at"), own_leaf.alias("leaf"), own_saved.alias("saved")).groupBy("at").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    names, small = size_checked_broadcast(shared.select(F.col("node").alias("named"), F.col("conv_id").alias("named_id")))
    upper = shared.join(sums, F.col("node") == F.col("at")).select("depth", "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
                                                                 (F.col("saved_tokens") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"), "parent")
    whole = nodes.filter("not upper").select(*upper.columns).unionByName(upper)
    # nodes inside a shard know their parent's id
    return lookup_join(whole, names, "parent", "named", small).select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "named_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
