"""LM scoring: a bigram model in sharded Elias-Fano tries, learnt from and queried by whole documents.

Words are counted over all training rows in shards of their hashes, and numbered there.  Pairs of neighbours then
go to shards of the earlier word; each shard learns its trie from the training rows' pairs and answers all its
pairs from it, and the answers are added up by document.  What a shard holds is set by the input: their number grows
with the bytes of text.  An earlier word that is very frequent is dealt to several shards by the later word, which loses no
count, since totals of single words come with the pairs.

P(w | v) = (1 - b(v)) c(v, w) / c(v) + b(v) P(w), b(v) = c^h / (c + c^h) for c = c(v): the distinct followers of a word
that occurs c times are taken as c^h.  P(w) = (c(w) + a) / (N + a (V + 1)).  Unknown earlier words have b = 1.
"""
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import crc_bucket, space_words
from foldwise.llm.eliasfano import NgramTrie
from foldwise.session import materialize

ADD = 0.1
HEAPS = 0.75
HELD_OUT = (10, 0)
#: Tokens of one batch of documents, bytes of text that make a shard, occurrences from which an earlier word is split.
BATCH_TOKENS = 2_000_000
SHARD_BYTES = 16 << 20
SPLIT_COUNT = 500_000
LOOKUPS = 1 << 18
END_HASH, START = 1, 0

ROWS = "kind int, batch long, shard long, a long, b long, blob binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("shard", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("blob", pa.binary())])
TOKENS, WORDS, COUNTS, TYPES, PAIRS, BASE, SUMS = range(7)
_PRESS = zstandard.ZstdCompressor(level=1)
_OPEN = zstandard.ZstdDecompressor()


class Index(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        value = self[word] = len(self)
        return value


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its type and length, compressed; like bytes of the values lie together."""
    return _PRESS.compress(b"".join(x for a in arrays for x in (f"{a.dtype.str}:{len(a)};".encode(), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"")))


def unpack(blob: bytes) -> list[np.ndarray]:
    data, at, out = _OPEN.decompress(blob), 0, []
    while at < len(data):
        end = data.index(b";", at)
        kind, _, size = data[at:end].decode().partition(":")
        dtype, at = np.dtype(kind), end + 1
        raw = np.frombuffer(data, dtype=np.uint8, count=int(size) * dtype.itemsize, offset=at)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, int(size)).T).view(dtype).reshape(int(size)))
        at += len(raw)
    return out


def least(values: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads numbers over 64 bits."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def _row(kind: int, batch: int, shard: int, a: int, b: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((kind, batch, shard, a, b, blob), SCHEMA)], schema=SCHEMA)


def _tokenise(shards: int, batch_tokens: int):
    """Documents in batches: their tokens, and the batch's words for each shard with their training counts.  Local
    numbers of words follow the shards, so that the shards' answers laid end to end are in their order."""

    def close(batch, index, held):
        ids, nulls, trained, texts = zip(*held)
        tokens = np.concatenate([np.append(t, 0) for t in texts])  # 0 is the end token
        sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        hashes = np.array([END_HASH, *(xxhash.xxh64_intdigest(w, 7) for w in index if w is not None)], dtype=np.uint64)
        shard = (hashes % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        tokens = place[tokens]
        trained = np.array(trained)
        train_tokens = np.repeat(trained, sizes)
        counts = np.bincount(tokens[train_tokens], minlength=len(order))
        yield _row(TOKENS, batch, -1, int(train_tokens.sum()), int(trained.sum()),
                   pack(np.array(ids, dtype=np.int64), np.array(nulls, dtype=bool), trained, least(sizes), least(tokens), np.array([place[0]])))
        hashes, shard = hashes[order], shard[order]
        for s in np.unique(shard):
            part = slice(*np.searchsorted(shard, [s, s + 1]))
            yield _row(WORDS, batch, int(s), 0, 0, pack(hashes[part], least(counts[part])))

    def run(batches):
        from pyspark import TaskContext

        batch = TaskContext.get().partitionId() << 32
        index, held, size = Index({None: 0}), [], 0
        for rows in batches:
            for doc, trained, text in zip(*(rows.column(k) for k in range(3))):
                words = space_words(text.as_py() or b"")
                doc = doc.as_py()
                held.append((doc or 0, doc is None, bool(trained.as_py()), np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))))
                size += len(words) + 1
                if size >= batch_tokens:
                    yield from close(batch, index, held)
                    batch, index, held, size = batch + 1, Index({None: 0}), [], 0
        if held:
            yield from close(batch, index, held)

    return run


def _grouped(batches, key: int):
    """Rows of sorted batches by the value of column ``key``: (value, list of row tuples)."""
    now, held = None, []
    for rows in batches:
        for row in zip(*(rows.column(k).to_pylist() for k in range(5)), rows.column(5)):
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append((*row[:5], row[5].as_buffer()))
    if held:
        yield now, held


def _count_words(shards: int):
    """A shard's words: the total training count and the number of each, for every batch that asked."""

    def run(batches):
        for shard, rows in _grouped(batches, 2):
            parts = [unpack(r[5]) for r in rows]
            words, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
            yield _row(TYPES, -1, shard, int((counts > 0).sum()), 0, b"")
            cuts = np.cumsum([0, *(len(p[0]) for p in parts)])
            for r, a, b in zip(rows, cuts, cuts[1:]):
                yield _row(COUNTS, r[1], shard, 0, 0, pack(least(counts[back[a:b]]), least(back[a:b])))

    return run


def _pairs(shards: int, total: int, types: int, starts: int, add: float, split_count: int):
    """With the counts of a batch's words: each document's base score, and its pairs for the shards."""

    def run(batches):
        for batch, rows in _grouped(batches, 1):
            ids, nulls, trained, sizes, tokens, end = unpack(next(r[5] for r in rows if r[0] == TOKENS))
            answers = sorted((r for r in rows if r[0] == COUNTS), key=lambda r: r[2])
            parts = [unpack(r[5]) for r in answers]
            counts = np.concatenate([p[0].astype(np.int64) for p in parts])
            number = np.concatenate([p[1].astype(np.int64) * shards + r[2] + 1 for p, r in zip(parts, answers)])
            sizes = sizes.astype(np.int64)
            first = np.cumsum(sizes) - sizes
            tokens = tokens.astype(np.int64)
            logp = np.log10((counts + add) / (total + add * (types + 1)))
            base = np.add.reduceat(logp[tokens], first)
            known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), first)
            yield _row(BASE, batch, -1 - batch, 0, 0, pack(ids, nulls, trained, sizes, known, base))
            # the start of a text is a word of its own, number START
            before = np.empty_like(tokens)
            before[1:] = tokens[:-1]
            before[first] = len(counts)
            counts, number = np.append(counts, starts), np.append(number, START)
            spread = mixed(number)
            pieces = np.maximum(1, -(-counts // split_count))
            piece = (spread >> np.uint64(20)).astype(np.int64)[tokens] % pieces[before]
            shard = (mixed(spread[before] + piece.astype(np.uint64)) % np.uint64(shards)).astype(least(np.array([shards])).dtype)
            order = np.argsort(shard, kind="stable")
            doc = np.repeat(np.arange(len(sizes)), sizes)[order]
            before, tokens, shard = before[order], tokens[order], shard[order]
            present, short = np.zeros(len(counts), dtype=bool), np.zeros(len(counts), dtype=np.int64)
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(shard)]):
                v, w = before[a:b], tokens[a:b]
                present[v] = present[w] = True
                used = np.flatnonzero(present)
                present[used] = False
                used = used[np.argsort(number[used])]
                short[used] = np.arange(len(used))
                steps = np.diff(number[used], prepend=0)
                yield _row(PAIRS, batch, int(shard[a]), 0, 0, pack(least(steps), least(counts[used]), least(short[v]), least(short[w]), least(np.diff(doc[a:b], prepend=0)), np.packbits(trained)))

    return run


def learn_trie(context: np.ndarray, word: np.ndarray, times: np.ndarray, known: np.ndarray, known_counts: np.ndarray, logp_word: np.ndarray, heaps: float) -> NgramTrie:
    """The trie of sorted distinct pairs seen ``times`` (over 0); ``known`` contexts, with their counts, have a backoff
    weight even without a follower here; ``logp_word`` is by word number."""
    spread = known_counts.astype(float) ** heaps
    weight = spread / (known_counts + spread)
    row = np.searchsorted(known, context)
    p = (1 - weight[row]) * times / known_counts[row] + weight[row] * 10.0 ** logp_word[word]
    return NgramTrie(known, np.bincount(row, minlength=len(known)), word, np.log10(p), np.log10(weight))


def _score(total: int, types: int, add: float, heaps: float):
    """A shard's trie, and from it the sum over each document's pairs."""

    def run(batches):
        for shard, rows in _grouped(batches, 2):
            if rows[0][0] == BASE:
                yield from (_row(*r[:5], r[5].to_pybytes()) for r in rows)
                continue
            parts = [unpack(r[5]) for r in rows]
            numbers = [np.cumsum(p[0].astype(np.int64)) for p in parts]
            words = np.unique(np.concatenate(numbers))
            counts = np.zeros(len(words), dtype=np.int64)
            keys, trained = [], []
            for p, own in zip(parts, numbers):
                local = np.searchsorted(words, own)
                counts[local] = p[1]
                keys.append(local[p[2]] * len(words) + local[p[3]])
                trained.append(np.unpackbits(p[5])[np.cumsum(p[4].astype(np.int64))].astype(bool))
            logp_word = np.log10((counts + add) / (total + add * (types + 1)))
            distinct, back = np.unique(np.concatenate(keys), return_inverse=True)
            times = np.bincount(back[np.concatenate(trained)], minlength=len(distinct))
            context, word = distinct // len(words), distinct % len(words)
            seen = times > 0
            known = np.unique(context)
            known = known[counts[known] > 0]
            del keys
            trie = learn_trie(context[seen], word[seen], times[seen], known, counts[known], logp_word, heaps)
            answers = np.empty(len(distinct))
            for at in range(0, len(distinct), LOOKUPS):
                part = slice(at, at + LOOKUPS)
                logp, logb = trie.lookup(context[part], word[part])
                answers[part] = np.where(np.isnan(logp), logb + logp_word[word[part]], logp)
            at = 0
            for r, p in zip(rows, parts):
                doc = np.cumsum(p[4].astype(np.int64))
                yield _row(SUMS, r[1], shard, 0, 0, pack(np.bincount(doc, answers[back[at:at + len(doc)]])))
                at += len(doc)

    return run


DOCS = "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"


def _finish(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("trained", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    for _, rows in _grouped(batches, 1):
        ids, nulls, trained, sizes, known, base = unpack(next(r[5] for r in rows if r[0] == BASE))
        score = np.zeros(len(ids))
        for r in rows:
            if r[0] == SUMS:
                part = unpack(r[5])[0]
                score[:len(part)] += part
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(trained), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score)], schema=schema)


def lm_scores(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held_out: tuple[int, int] = HELD_OUT, add: float = ADD, heaps: float = HEAPS,
              batch_tokens: int = BATCH_TOKENS, shard_bytes: int = SHARD_BYTES, split_count: int = SPLIT_COUNT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10
    probability of the text and its end under the bigram model).

    Rows whose crc32 of the id is remainder ``held_out[1]`` modulo ``held_out[0]`` and rows of a null id (held_out null) are not
    learnt from.  Null texts are empty: their one token is the end.  Repeated rows count as often as they occur; an empty table gives an
    empty one; other columns are not carried.  All rows are counted, and scored whole.
    """
    bucket = crc_bucket(doc_id, held_out[0])
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.coalesce(bucket != held_out[1], F.lit(False)).alias("trained"), F.col(f"`{text}`").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(4, -(-size // shard_bytes))
    made = materialize(rows.mapInArrow(_tokenise(shards, batch_tokens), ROWS))
    words = made.filter(F.col("kind") == WORDS).repartition(shards, "shard").sortWithinPartitions("shard", "batch")
    counts = materialize(words.mapInArrow(_count_words(shards), ROWS))
    train = made.filter(F.col("kind") == TOKENS).agg(F.sum("a").alias("tokens"), F.sum("b").alias("docs")).first()
    types = counts.filter(F.col("kind") == TYPES).agg(F.sum("a").alias("n")).first()["n"] or 0
    total, starts = train["tokens"] or 0, train["docs"] or 0
    both = made.filter(F.col("kind") == TOKENS).unionByName(counts.filter(F.col("kind") == COUNTS))
    pairs = both.repartition("batch").sortWithinPartitions("batch").mapInArrow(_pairs(shards, total, types, starts, add, split_count), ROWS)
    sums = pairs.repartition(shards, "shard").sortWithinPartitions("shard", "batch").mapInArrow(_score(total, types, add, heaps), ROWS)
    done = sums.repartition("batch").sortWithinPartitions("batch").mapInArrow(_finish, DOCS)
    # the remainder of rows of a null id is unknown
    return done.select("doc_id", F.when(F.col("doc_id").isNotNull(), ~F.col("trained")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
