"""Exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer components: dimension (term) and weight.  All rows are dealt evenly to blocks of
about ``BLOCK_ROWS``, and each block becomes an inverted index: one posting list a term, with the places of its rows and
their weights.  Every query row visits every block.  There, term after term, the query's weight times the posting's
weight is scattered into dense score arrays, one score a row of the block and query of the batch; the arrays start at zero, so
that rows without a common term are scored too.  Each batch hands on its highest scores by partition selection, and
the blocks' answers are merged by rank.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import materialize

BLOCK_ROWS = 8192
#: Queries whose score arrays lie side by side; a scatter then adds whole runs of memory.
BATCH_QUERIES = 64
SCALE = 256
LONG = np.iinfo(np.int64)

#: Postings and queries of a block: kind 0 rows (places' ids), 1 postings (term; places; weights), 2 a query (terms; weights).
ROWS = "block int, kind int, term int, key long, id long, places array<int>, weights array<long>"
SCHEMA = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("term", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("places", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))])
IDS, POSTINGS, QUERY = range(3)
FOUND = "key long, query_id long, vec_id long, score long"
FOUND_SCHEMA = pa.schema([("key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def components(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), held at the ends of the long range."""
    with np.errstate(over="ignore"):
        x = np.floor(scale * values.astype(np.float64))
    out = np.clip(x, -2.0**62, 2.0**62).astype(np.int64)
    out[x >= 2.0**63], out[x < -2.0**63] = LONG.max, LONG.min
    between = (np.abs(x) > 2.0**62) & (x < 2.0**63) & (x >= -2.0**63)
    out[between] = x[between].astype(np.int64)
    return out


def _index(scale: int):
    """The posting lists of each block: rows come sorted by block, a block's rows one after the other."""

    def lists(block, ids, sizes, values):
        ids = pa.array(ids, pa.int64())
        sizes, values = np.concatenate(sizes), components(np.concatenate(values), scale)
        term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = np.repeat(np.arange(len(sizes)), sizes)
        some = values != 0
        term, place, values = term[some], place[some], values[some]
        order = np.argsort(term, kind="stable")
        term, place, values = term[order], place[order].astype(np.int32), values[order]
        cuts = np.concatenate([[0], np.flatnonzero(term[1:] != term[:-1]) + 1, [len(term)]]) if len(term) else np.zeros(1, np.int64)
        n = len(cuts) - 1
        # ids lie in `weights`; a null id's place is told by `places`
        null = np.flatnonzero(np.asarray(ids.is_null())).astype(np.int32)
        made = lambda flat, kind, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([IDS], pa.int32()), pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()),
                                          made(null, pa.int32(), [0, len(null)]), made(ids.fill_null(0).to_numpy(), pa.int64(), [0, len(ids)])], schema=SCHEMA)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int32()), pa.array([POSTINGS] * n, pa.int32()), pa.array(term[cuts[:-1]], pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                              made(place, pa.int32(), cuts), made(values, pa.int64(), cuts)], schema=SCHEMA)

    def run(batches):
        now, ids, sizes, values = None, [], [], []
        for rows in batches:
            block = rows.column(0).to_numpy()
            vectors = rows.column(2)
            size = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            own = rows.column(1).to_pylist()
            start = np.cumsum(size) - size
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if now is not None and block[a] != now:
                    yield from lists(now, ids, sizes, values)
                    ids, sizes, values = [], [], []
                now = int(block[a])
                ids += own[a:b]
                sizes.append(size[a:b])
                values.append(flat[start[a]:start[b - 1] + size[b - 1]])
        if now is not None:
            yield from lists(now, ids, sizes, values)

    return run


class Block:
    """A block's posting lists, ready to answer."""

    def __init__(self, ids: np.ndarray, null: np.ndarray):
        self.ids, self.null = ids, np.zeros(len(ids), dtype=bool)
        self.null[null] = True
        self.postings: dict[int, tuple[np.ndarray | slice, np.ndarray]] = {}
        self.largest, self.by_id = 0, {}
        for place in np.flatnonzero(~self.null).tolist():
            self.by_id.setdefault(int(ids[place]), []).append(place)

    def add(self, term: int, places: np.ndarray, weights: np.ndarray) -> None:
        self.largest = max(self.largest, abs(int(weights.max())), abs(int(weights.min())))
        # a term that all rows hold needs no places
        self.postings[term] = (slice(None) if len(places) == len(self.ids) else places, weights)

    def answer(self, queries: list[tuple], k: int):
        """(key, query id, ids, null flags, scores) of the k best rows for each (key, id, terms, weights)."""
        width = max((len(w) for *_, w in queries), default=0)
        most = max((abs(int(x)) for *_, w in queries if len(w) for x in (w.max(), w.min())), default=0)
        bound = most * self.largest * max(1, width)
        kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
        by_term: dict[int, tuple[list, list]] = {}
        for q, (_, _, terms, weights) in enumerate(queries):
            for t, w in zip(terms.tolist(), weights.tolist()):
                if t in self.postings:
                    at, value = by_term.setdefault(t, ([], []))
                    at.append(q)
                    value.append(w)
        scores = np.zeros((len(self.ids), len(queries)), dtype=kind)
        for t, (at, value) in by_term.items():
            places, weights = self.postings[t]
            product = weights.astype(kind)[:, None] * np.array(value, dtype=kind)
            if len(at) == len(queries):
                scores[places] += product
            elif isinstance(places, slice):
                scores[:, at] += product
            else:
                scores[np.ix_(places, at)] += product
        if kind is object:
            scores = np.clip(scores, LONG.min, LONG.max).astype(np.int64)
        for q, (key, own, _, _) in enumerate(queries):
            column = scores[:, q]
            mine = self.by_id.get(own, [])
            keep = min(len(column), k + len(mine))
            # every row that ties with the last one kept takes part in the order by id
            least = np.partition(column, len(column) - keep)[len(column) - keep]
            at = np.flatnonzero(column >= least)
            if mine:
                at = at[~np.isin(at, mine)]
            at = at[np.lexsort((self.ids[at], self.null[at], -column[at].astype(object) if kind is object else -column[at].astype(np.int64)))][:k]
            yield key, own, self.ids[at], self.null[at], column[at].astype(np.int64)


def _search(k: int):
    """For rows sorted by block and kind: the block's lists come first, then its queries, a batch at a time."""

    def answers(block, queries):
        found = list(block.answer(queries, k))
        n = [len(x[2]) for x in found]
        ids, null, scores = (np.concatenate([x[j] for x in found]) for j in (2, 3, 4))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in found], n), pa.int64()), pa.array(np.repeat([x[1] for x in found], n), pa.int64()), pa.array(ids, pa.int64(), mask=null), pa.array(scores, pa.int64())], schema=FOUND_SCHEMA)

    def run(batches):
        now, block, queries = None, None, []
        for rows in batches:
            own, kind, term, key, ident = (rows.column(j).to_pylist() for j in range(5))
            places, weights = rows.column(5), rows.column(6)
            for r in range(len(own)):
                if own[r] != now:
                    if queries:
                        yield answers(block, queries)
                    now, block, queries = own[r], None, []
                a, b = (x[r].values.to_numpy() for x in (places, weights))
                if kind[r] == IDS:
                    block = Block(b.copy(), a)
                elif kind[r] == POSTINGS:
                    block.add(term[r], a.copy(), b.copy())
                else:
                    queries.append((key[r], ident[r], a, b))
                    if len(queries) == BATCH_QUERIES:
                        yield answers(block, queries)
                        queries = []
        if queries:
            yield answers(block, queries)

    return run


def _query_rows(scale: int):
    """Sparse query rows: terms and weights that are not zero."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("places", pa.list_(pa.int32())), ("weights", pa.list_(pa.int64()))])

    def run(batches):
        for rows in batches:
            terms, weights = [], []
            for v in rows.column(2):
                w = components(v.values.to_numpy(zero_copy_only=False), scale) if len(v) else np.zeros(0, np.int64)
                some = np.flatnonzero(w)
                terms.append(some.astype(np.int32))
                weights.append(w[some])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(terms, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.int64()))], schema=schema)

    return run


def usable(vector: str):
    """Whether a vector and all its components are there and finite."""
    inf = float("inf")
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))


def top_k(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``k`` rows of ``vectors`` of the highest integer
    inner products of floor(scale * x), ties to the smaller id (null ids last); all of them where there are fewer.

    Rows of the query's own id are no candidates; a query of a null id has all rows as candidates.  Repeated rows are candidates
    and queries of their own.  Vectors that are null or hold null or non-finite components take no part; shorter
    vectors count as zero beyond their end, and an empty vector scores zero.  Components and scores beyond the
    long range are held at its ends.  Empty tables give an empty result; other columns play no part.

    Every query row is sent once to every block of ``block_rows`` vectors, a block's score arrays are the only dense
    state (``block_rows`` x BATCH_QUERIES numbers), and k rows a query and block go on to the merge.
    """
    narrow = lambda df: df.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).filter(usable("v"))
    rows = narrow(vectors)
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    # dealt round-robin: an id or a vector that very many rows share fills no block
    dealt = rows.repartition(blocks).select(F.spark_partition_id().alias("block"), "id", "v")
    index = materialize(dealt.mapInArrow(_index(scale), ROWS))
    asked = materialize(narrow(queries).select(F.monotonically_increasing_id().alias("key"), "id", "v").mapInArrow(_query_rows(scale), "key long, id long, places array<int>, weights array<long>"))
    # only blocks that hold rows are asked
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(QUERY).alias("kind"), F.lit(-1).alias("term"), "key", "id", "places", "weights") if n else asked.select(
        F.lit(0).alias("block"), F.lit(QUERY).alias("kind"), F.lit(-1).alias("term"), "key", "id", "places", "weights").limit(0)
    met = index.unionByName(sent).repartitionByRange(blocks, "block").sortWithinPartitions("block", "kind", "term")
    found = met.mapInArrow(_search(k), FOUND)
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", best).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def queries_by_id(vectors: DataFrame, vec_id: str = "vec_id", every: int = 50) -> DataFrame:
    """The rows whose id is divisible by ``every``."""
    return vectors.filter(F.col(f"`{vec_id}`") % every == 0)
