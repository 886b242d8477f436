"""Ranked lexical search over hashed max-sketches.

One scan folds each document into a sketch: a byte array about ``LOAD`` times as long as the document has distinct
terms, where each term has HASHES places and every place keeps the largest term frequency that falls on it.
An impact rises with the frequency, so the maxima of frequencies are those of the impacts whatever the corpus statistics turn out to be.
A batch of sketches is looked up at the places of all terms that a set of items asks for; the least of a term's places
bounds its impact from above, and so the weighted sums bound the items' scores.  The ``k`` documents of the highest
bounds are scored exactly first: the k-th of those scores is the item's threshold.  Every other document whose bound
reaches it is then scored exactly from its text, highest bounds first, and left out as soon as its bound is under the
k-th score at hand.  A bound is never under the score, so the ranking is exact.
"""
import heapq
import math
from collections import Counter
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import Buckets, alnum_words, per_text, scratch_folder
from foldwise.session import materialize, size_checked_broadcast

LOAD, HASHES, SEED = 4, 2, 11
#: Distinct terms of the items that are searched for together; a larger benchmark is taken in slices.
SLICE_TERMS = 200_000
#: Numbers of one lookup matrix.
CELLS = 4_000_000
FULL = 255
SKETCH, STATISTIC = range(2)
DOCUMENTS, WORDS = -1, -2
SCAN = "kind int, doc_id long, n long, term int, amount long, sketch binary"
SCAN_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.int32()), ("amount", pa.int64()), ("sketch", pa.binary())])
TERMS = T.StructType([T.StructField("terms", T.ArrayType(T.BinaryType()))])


def term_hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, SEED)


def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """A term's places in a sketch of ``size`` (a power of two)."""
    return [((hashes >> np.uint64(32 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(HASHES)]


def sketch(hashes: np.ndarray, times: np.ndarray, load: int = LOAD) -> bytes:
    """Maxima of the terms' frequencies by place; FULL stands for FULL or more."""
    size = 1 << max(4, int(load * len(hashes) - 1).bit_length())
    out = np.zeros(size, dtype=np.uint8)
    small = np.minimum(times, FULL).astype(np.uint8)
    for at in places(hashes, size):
        np.maximum.at(out, at, small)
    return out.tobytes()


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_factor(n, documents: int, words: int):
    return 100 - 90 + (90 * n * documents) // words


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def _scan(vocabulary: list[bytes], sketches: bool, load: int):
    """For (doc_id, text): a sketch a document with terms, and a task's counts of documents, words, and documents by term of
    the vocabulary."""

    def run(batches):
        number = {t: k for k, t in enumerate(vocabulary)}
        wanted, hashed = number.keys(), Buckets(term_hash)
        held = Counter()
        for rows in batches:
            ids, sizes, made = [], [], []
            for doc, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                words = alnum_words(text.as_py() or b"")
                if not words:
                    continue
                times = Counter(words)
                held[DOCUMENTS] += 1
                held[WORDS] += len(words)
                for t in wanted & times.keys():
                    held[number[t]] += 1
                if sketches:
                    ids.append(doc)
                    sizes.append(len(words))
                    made.append(sketch(np.fromiter(map(hashed.__getitem__, times), dtype=np.uint64, count=len(times)), np.fromiter(times.values(), dtype=np.int64, count=len(times)), load))
            if ids:
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([SKETCH] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.array(made, pa.binary())], schema=SCAN_SCHEMA)
        n = len(held)
        yield pa.RecordBatch.from_arrays([pa.array([STATISTIC] * n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(list(held), pa.int32()), pa.array(list(held.values()), pa.int64()), pa.nulls(n, pa.binary())], schema=SCAN_SCHEMA)

    return run


class Items:
    """The items of a slice with the weights of their terms; shipped to tasks, within SLICE_TERMS."""

    def __init__(self, ids: list, terms: list[list[bytes]], vocabulary: list[bytes], statistics: dict[int, int]):
        self.ids = ids
        self.documents, self.words = statistics.get(DOCUMENTS, 0), statistics.get(WORDS, 0)
        known = {t: k for k, t in enumerate(vocabulary) if statistics.get(k)}
        self.vocabulary = list(known)
        short = {t: k for k, t in enumerate(self.vocabulary)}
        self.weights = np.array([weight(self.documents, statistics[known[t]]) for t in self.vocabulary], dtype=np.int64)
        #: numbers of each item's terms; terms that no document holds add nothing
        self.terms = [np.array(sorted(short[t] for t in own if t in short), dtype=np.int64) for own in terms]

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items that have terms, all their terms end to end, and where each begins."""
        some = np.array([k for k, t in enumerate(self.terms) if len(t)], dtype=np.int64)
        if not len(some):
            return some, some, some
        sizes = np.array([len(self.terms[k]) for k in some])
        return some, np.concatenate([self.terms[k] for k in some]), np.cumsum(sizes) - sizes

    def bounds(self, hashes: np.ndarray, n: np.ndarray, sketches: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, upper bounds by row and item of ``flat``) in pieces of at most CELLS numbers."""
        _, terms, begin = self.flat()
        sizes = np.array([len(s) for s in sketches])
        step = max(1, CELLS // max(1, len(terms), len(hashes)))
        for size in np.unique(sizes).tolist():
            same = np.flatnonzero(sizes == size)
            where = places(hashes, size)
            for a in range(0, len(same), step):
                rows = same[a:a + step]
                maxima = np.frombuffer(b"".join([sketches[r] for r in rows]), dtype=np.uint8).reshape(len(rows), size)
                tf = maxima[:, where[0]]
                for at in where[1:]:
                    np.minimum(tf, maxima[:, at], out=tf)
                tf = tf.astype(np.int64)
                m = length_factor(n[rows], self.documents, self.words)[:, None]
                top = np.where(tf == FULL, 1_000_000, impact(tf, m)) * self.weights
                yield rows, np.add.reduceat(top[:, terms], begin, axis=1)


def _order(doc):
    """Sorts ids with null last."""
    return doc is None, doc or 0


BOUNDS = "item int, bound long, doc_id long"
BOUNDS_SCHEMA = pa.schema([("item", pa.int32()), ("bound", pa.int64()), ("doc_id", pa.int64())])


def _highest_bounds(items: Items, k: int):
    """A task's ``k`` highest bounds of each item."""

    def run(batches):
        hashes = np.array([term_hash(t) for t in items.vocabulary], dtype=np.uint64)
        some, *_ = items.flat()
        best, holders = np.zeros((len(some), k), dtype=np.int64), np.full((len(some), k), -1, dtype=np.int64)
        ids: list = []
        for rows in batches if len(some) else ():
            base, own, n = len(ids), rows.column(0).to_pylist(), rows.column(1).to_numpy()
            ids += own
            for at, bound in items.bounds(hashes, n, rows.column(2).to_pylist()):
                both = np.concatenate([best, bound.T], axis=1)
                who = np.concatenate([holders, np.broadcast_to(base + at, bound.T.shape)], axis=1)
                top = np.argpartition(both, both.shape[1] - k, axis=1)[:, -k:]
                best, holders = np.take_along_axis(both, top, axis=1), np.take_along_axis(who, top, axis=1)
            # only documents that still lead keep their place in the list
            kept = np.unique(holders[holders >= 0])
            ids = [ids[j] for j in kept]
            holders = np.where(holders >= 0, np.searchsorted(kept, holders), -1)
        for j, item in enumerate(some):
            full = np.flatnonzero(best[j] > 0)
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(full), pa.int32()), pa.array(best[j][full]), pa.array([ids[h] for h in holders[j][full]], pa.int64())], schema=BOUNDS_SCHEMA)

    return run


CANDIDATES = "cand_id long, items array<int>, bounds array<long>"
CANDIDATES_SCHEMA = pa.schema([("cand_id", pa.int64()), ("items", pa.list_(pa.int32())), ("bounds", pa.list_(pa.int64()))])


def _reaching(items: Items, thresholds: dict[int, int]):
    """Documents with the items whose threshold their bound reaches."""

    def run(batches):
        hashes = np.array([term_hash(t) for t in items.vocabulary], dtype=np.uint64)
        some, *_ = items.flat()
        least = np.array([thresholds.get(int(j), 1) for j in some], dtype=np.int64)
        for rows in batches if len(some) else ():
            own, n = rows.column(0).to_pylist(), rows.column(1).to_numpy()
            ids, which, bounds = [], [], []
            for at, bound in items.bounds(hashes, n, rows.column(2).to_pylist()):
                reach = bound >= least
                for r in np.flatnonzero(reach.any(axis=1)):
                    ids.append(own[at[r]])
                    which.append(some[reach[r]].astype(np.int32))
                    bounds.append(bound[r][reach[r]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(which, pa.list_(pa.int32())), pa.array(bounds, pa.list_(pa.int64()))], schema=CANDIDATES_SCHEMA)

    return run


SCORED = "item int, score long, doc_id long"
SCORED_SCHEMA = pa.schema([("item", pa.int32()), ("score", pa.int64()), ("doc_id", pa.int64())])


def _rescore(items: Items, thresholds: dict[int, int], k: int):
    """For (doc_id, text, items, bounds): a task's ``k`` best exact scores of each item, by descending bound until the
    k-th score at hand is over the bound."""

    def run(batches):
        number = {t: j for j, t in enumerate(items.vocabulary)}
        best: dict[int, list] = {}
        for rows in batches:
            ids, which, bounds = (rows.column(c).to_pylist() for c in (0, 2, 3))
            counted: dict[int, tuple] = {}
            for bound, r, item in sorted(((b, r, j) for r in range(len(ids)) for j, b in zip(which[r], bounds[r])), reverse=True):
                heap = best.setdefault(item, [])
                if bound < (heap[0][0] if len(heap) == k else thresholds.get(item, 1)):
                    continue
                if r not in counted:
                    words = alnum_words(rows.column(1)[r].as_py() or b"")
                    m = length_factor(len(words), items.documents, items.words)
                    counted[r] = {number[t]: impact(c, m) for t, c in Counter(words).items() if t in number}
                own = counted[r]
                score = sum(int(items.weights[t]) * own[t] for t in items.terms[item].tolist() if t in own)
                if score > 0:
                    none, doc = _order(ids[r])
                    entry = (score, not none, -doc)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        for item, heap in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(heap), pa.int32()), pa.array([e[0] for e in heap], pa.int64()), pa.array([-e[2] if e[1] else None for e in heap], pa.int64())], schema=SCORED_SCHEMA)

    return run


def _leading(scores: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc(by), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def item_terms(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(id, terms): the distinct terms of each id's texts."""
    words = per_text(lambda: lambda texts: [(sorted(set(alnum_words(t or b""))),) for t in texts], TERMS)
    each = items.select(F.col(f"`{item_id}`").alias("id"), words(F.col(f"`{item_text}`").cast("string"))["terms"].alias("t"))
    return each.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("t"))).alias("terms"))


def slices(terms: DataFrame, slice_terms: int) -> int:
    """In how many hash slices no slice of several items has more than ``slice_terms`` terms."""
    sizes = terms.select(F.xxhash64("id").alias("h"), F.size("terms").alias("n")).filter("n > 0")
    parts = 1
    while True:
        own = sizes.groupBy(F.pmod("h", F.lit(parts)).alias("s")).agg(F.sum("n").alias("n"), F.count("*").alias("items"))
        if own.filter((F.col("n") > slice_terms) & (F.col("items") > 1)).isEmpty() or parts >= 1 << 20:
            return parts
        parts *= 2


def lexical_search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   k: int = 10, load: int = LOAD, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents of a score above 0, equal scores by ascending id
    (null ids last).

    Rows of one item id (null is an id too) are one item with the terms of all its texts; items without terms and terms that no
    document holds find nothing.  Every row of ``docs`` is a document: repeated rows count, and rank, as often as they occur.  Null
    and empty texts have no terms and are not counted; other columns play no part; empty tables give an empty result.

    The sketches are written to the shared folder once.  Texts are read again only where a document's bound reaches
    an item's threshold; candidates meet them in a size-checked broadcast, else in a shuffle of the matching rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    terms = materialize(item_terms(items, item_id, item_text))
    parts, folder, found = slices(terms, slice_terms), None, None
    for s in range(parts):
        # one slice at a time is on the driver, within slice_terms (or a single item)
        own = terms.filter((F.pmod(F.xxhash64("id"), F.lit(parts)) == s) & (F.size("terms") > 0)).collect()
        if not own and folder is not None:
            continue
        vocabulary = sorted({bytes(t) for r in own for t in r.terms})
        scan = rows.mapInArrow(_scan(vocabulary, folder is None, load), SCAN)
        if folder is None:
            folder = scratch_folder(spark, "sketches")
            scan.write.option("compression", "zstd").parquet(folder)
            scan = spark.read.schema(SCAN).parquet(folder)
        counts = scan.filter(F.col("kind") == STATISTIC).groupBy("term").agg(F.sum("amount").alias("n"))
        chosen = Items([r.id for r in own], [[bytes(t) for t in r.terms] for r in own], vocabulary, {r.term: r.n for r in counts.collect()})
        ranked = _search(rows, spark.read.schema(SCAN).parquet(folder).filter(F.col("kind") == SKETCH).select("doc_id", "n", "sketch"), chosen, k)
        names = spark.createDataFrame(pa.table({"item": pa.array(range(len(own)), pa.int32())})).withColumn("item_id", F.lit(None).cast(terms.schema["id"].dataType)) if not own else \
            spark.createDataFrame([(j, r.id) for j, r in enumerate(own)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", terms.schema["id"].dataType)]))
        ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a row for each item of the slice
        found = ranked if found is None else found.unionByName(materialize(ranked))
    return found


def _search(rows: DataFrame, sketches: DataFrame, items: Items, k: int) -> DataFrame:
    first = _leading(sketches.mapInArrow(_highest_bounds(items, k), BOUNDS), "bound", k)
    first = materialize(first.groupBy("doc_id").agg(F.collect_list("item").alias("items"), F.collect_list("bound").alias("bounds")).withColumnRenamed("doc_id", "cand_id"))
    scored = _leading(_exact(rows, first, items, {}, k), "score", k)
    # the k-th score of the k highest bounds
    thresholds = {r.item: r.score for r in scored.filter(F.col("rank") == k).select("item", "score").collect()}
    rest = materialize(_merged(sketches.mapInArrow(_reaching(items, thresholds), CANDIDATES)))
    return _leading(_exact(rows, rest, items, thresholds, k), "score", k)


def _merged(candidates: DataFrame) -> DataFrame:
    """One row a doc_id: rows that share an id take all its items with the highest bound."""
    pairs = candidates.select("cand_id", F.explode(F.arrays_zip("items", "bounds")).alias("p")).groupBy("cand_id", F.col("p.items").alias("item")).agg(F.max("p.bounds").alias("bound"))
    return pairs.groupBy("cand_id").agg(F.collect_list("item").alias("items"), F.collect_list("bound").alias("bounds"))


def _exact(rows: DataFrame, candidates: DataFrame, items: Items, thresholds: dict[int, int], k: int) -> DataFrame:
    """The best exact scores among the candidates' documents; null ids meet by a key of their own."""
    known = candidates.select(F.coalesce("cand_id", F.lit(0).cast("bigint")).alias("cand"), F.col("cand_id").isNull().alias("cand_null"), "items", "bounds")
    known, small = size_checked_broadcast(known)
    texts = rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("own"), F.col("doc_id").isNull().alias("own_null"))
    met = texts.join(known, (F.col("own") == F.col("cand")) & (F.col("own_null") == F.col("cand_null")))
    return met.select("doc_id", "text", "items", "bounds").mapInArrow(_rescore(items, thresholds, k), SCORED)
