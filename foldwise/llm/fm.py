"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata, learnt from all
labelled rows in shards.

Scored in linear time by the sum-of-squares identity: the sum over pairs <v_i, v_j> x_i x_j is
0.5 * sum over factors of ((sum v x)^2 - sum (v x)^2).
"""
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq
from typing import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.averaging import averaged, deal, n_shards, packed, rounds_of, unpacked
from foldwise.llm.common import Buckets, alnum_words, labelled_rows, per_text, space_words
from foldwise.operators.ordering import quantiles

WORD_BITS = 17
FACTORS = 8
BINS = 12
THRESHOLD = 0.7
HELD_OUT = (4, 2)
#: Passes over the rows, minibatches at the least, rows of one, step size, pull to zero.
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 300, 256, 0.15, 1e-4
#: Structure statistics, then metadata: the declared length and how far it is from the real one.
STATISTICS = ("log_words", "mean_word", "distinct", "upper", "symbols", "exclaims", "digits", "bars", "pairs", "top_word", "lines", "dup_lines", "log_declared", "declared_off")
_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))

FEATURES = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("stats", T.ArrayType(T.DoubleType()))])
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def bucket_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7) & ((1 << WORD_BITS) - 1)


def statistics(text: bytes, words: list[bytes], declared: int | None) -> list[float]:
    """The STATISTICS of a text; shares are of words, bytes or lines."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    count = Counter(words)
    points = len(text.translate(None, _CONTINUED))
    return [np.log2(1 + len(words)), size / n, len(count) / n, (size - len(text.translate(None, _UPPER))) / size, (size - len(text.translate(None, _SYMBOLS))) / size,
            text.count(b"!") / n, sum(text.count(b"%d" % d) for d in range(10)) / size, text.count(b"|") / n, sum(map(eq, words, islice(words, 1, None))) / n,
            max(count.values(), default=0) / n, len(lines) / n, (len(lines) - len(set(lines))) / max(1, len(lines)),
            -1.0 if declared is None else float(np.log2(1 + max(0, declared))), -1.0 if declared is None else min(1.0, abs(declared - points) / max(1, points))]


def featuriser():
    """(text, declared length) to the hashed distinct words and the statistics."""
    buckets = Buckets(bucket_of)

    def features(text: bytes | None, declared: int | None) -> tuple[np.ndarray, list[float]]:
        text = text or b""
        distinct = set(alnum_words(text))
        return np.unique(np.fromiter(map(buckets.__getitem__, distinct), dtype=np.int32, count=len(distinct))), statistics(text, space_words(text), declared)

    return features


@dataclass
class FactorMachine:
    """Rows of ``w`` and ``v``: the word buckets, then BINS of each statistic."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def columns(self, stats: np.ndarray) -> np.ndarray:
        """Feature rows of the statistics' bins, for a matrix of statistics."""
        base = (1 << WORD_BITS) + BINS * np.arange(stats.shape[1])
        return np.stack([base[k] + np.searchsorted(self.edges[k], stats[:, k], side="right") for k in range(stats.shape[1])], axis=1)

    def csr(self, words: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature indices, values and row starts; the words of a text have length 1 together, statistics weigh 1 each."""
        bins = self.columns(stats)
        index = np.concatenate([x for w, b in zip(words, bins) for x in (w, b)]).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        value = np.concatenate([x for n in sizes for x in (np.full(n, 1 / np.sqrt(max(1, n)), dtype=np.float32), np.ones(bins.shape[1], dtype=np.float32))])
        starts = np.concatenate([[0], np.cumsum(sizes + bins.shape[1])])
        return index, value, starts

    def margin(self, index, value, starts):
        """Margins by the sum-of-squares identity, and what the gradient needs."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts[:-1], axis=0)
        linear = np.add.reduceat(self.w[index] * value, starts[:-1])
        return self.bias + linear + 0.5 * (sums ** 2 - np.add.reduceat(vx ** 2, starts[:-1], axis=0)).sum(axis=1), vx, sums

    def score(self, words: list[np.ndarray], stats: list[list[float]]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.csr(words, np.array(stats)))[0], -30, 30)))


def _start(edges: np.ndarray, n: float, positive: float, rng) -> FactorMachine:
    rows = (1 << WORD_BITS) + BINS * len(STATISTICS)
    share = (positive + 1) / (n + 2)
    return FactorMachine(float(np.log(share / (1 - share))), np.zeros(rows, np.float32), rng.normal(0, 0.02, (rows, FACTORS)).astype(np.float32), np.ascontiguousarray(edges))


def _gradient_sums(model: FactorMachine) -> list:
    return [np.full(model.w.shape, 1e-3, np.float32), np.full(model.v.shape, 1e-3, np.float32), 1.0]


def _passes(n: int, epochs: int, steps: int, batch: int) -> int:
    return max(epochs, -(-steps // -(-max(1, n) // batch)))


def _pass(model: FactorMachine, sums: list, order: np.ndarray, words: Callable[[int], np.ndarray], stats: np.ndarray, y: np.ndarray, batch: int, rate: float, decay: float) -> None:
    """AdaGrad steps over the rows in that order; ``sums`` holds the sums of squared gradients of w, v and bias."""
    gw, gv, _ = sums
    for at in range(0, len(order), batch):
        pick = order[at:at + batch]
        index, value, starts = model.csr([words(i) for i in pick], stats[pick])
        margin, vx, total = model.margin(index, value, starts)
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) / len(pick)
        each = np.repeat(error, np.diff(starts))
        used, place = np.unique(index, return_inverse=True)
        dw = np.bincount(place, each * value) + decay * model.w[used]
        dv = each[:, None] * value[:, None] * (np.repeat(total, np.diff(starts), axis=0) - vx)
        dv = np.stack([np.bincount(place, dv[:, f]) for f in range(FACTORS)], axis=1) + decay * model.v[used]
        gw[used] += dw ** 2
        gv[used] += dv ** 2
        sums[2] += error.sum() ** 2
        model.w[used] -= rate * dw / np.sqrt(gw[used])
        model.v[used] -= 0.3 * rate * dv / np.sqrt(gv[used])
        model.bias -= rate * error.sum() / np.sqrt(sums[2])


def fit(words: list[np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, decay: float = DECAY, seed: int = 5) -> FactorMachine:
    """Logistic loss by AdaGrad over minibatches, for ``epochs`` and at least ``steps`` of them.  One class alone gives a constant model at its smoothed share."""
    rng = np.random.default_rng(seed)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T if len(y) else np.zeros((len(STATISTICS), BINS - 1))
    model = _start(edges, len(y), y.sum(), rng)
    if len(set(y.tolist())) < 2:
        model.v[:] = 0
        return model
    sums = _gradient_sums(model)
    for _ in range(_passes(len(y), epochs, steps, batch)):
        _pass(model, sums, rng.permutation(len(y)), words.__getitem__, stats, y, batch, rate, decay)
    return model


def _inputs(docs: DataFrame, text: str, declared: str | None) -> Column:
    length = F.col(f"`{declared}`").cast("bigint") if declared and declared in docs.columns else F.lit(None).cast("bigint")
    return F.struct(F.col(f"`{text}`").cast("string").alias("text"), length.alias("declared"))


def _feature_worker():
    features = featuriser()

    def work(rows):
        made = [features(*r) for r in rows]
        return [(packed(w), [float(x) for x in s]) for w, s in made]

    return work


def train_quality(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", declared: str | None = "n_chars",
                  held_out: tuple[int, int] = HELD_OUT) -> FactorMachine:
    """Learns from every labelled row outside the held-out remainder, whole texts: Spark makes the features and the
    exact quantiles that bound the bins, and runs the passes on shards, whose models are averaged after each."""
    rng = np.random.default_rng(5)
    columns = [text] + ([declared] if declared and declared in docs.columns else [])
    known = labelled_rows(docs, labels, label=label, columns=columns, doc_id=doc_id, held_out=held_out)
    shards = n_shards(known, text)
    made = known.select("__id", F.col(label).alias("y"), per_text(_feature_worker, FEATURES)(_inputs(known, text, declared)).alias("f"))
    rows = deal(made.select("__id", "y", F.col("f.words").alias("words"), F.col("f.stats").alias("stats")), shards)
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n, positive = sum(sizes.values()), sizes.get(1, 0)
    edges = np.zeros((len(STATISTICS), BINS - 1))
    if len(sizes) > 1:
        found = quantiles(rows.select(*[F.col("stats")[k].alias(name) for k, name in enumerate(STATISTICS)]), STATISTICS, [b / BINS for b in range(1, BINS)])
        edges = np.array([found[name] for name in STATISTICS])
    model = _start(edges, n, positive, rng)
    if len(sizes) < 2:
        model.v[:] = 0
        return model
    passes = _passes(n, EPOCHS, STEPS, BATCH)
    rounds = rounds_of(passes, EPOCHS, shards)

    def move(parts, columns, rng):
        bias, w, v, *sums = parts
        own = FactorMachine(bias, w, v, edges)
        stats, y = np.array(columns["stats"], dtype=float), np.array(columns["y"], dtype=float)
        for _ in range(-(-passes // rounds)):
            _pass(own, sums, rng.permutation(len(y)), lambda i: unpacked(columns["words"][i], np.int32), stats, y, BATCH, RATE, DECAY)
        return [own.bias, own.w, own.v, *sums]

    model.bias, model.w, model.v, *_ = averaged(rows.select("y", "words", "stats"), shards, [model.bias, model.w, model.v, *_gradient_sums(model)], rounds, move, seed=5)
    return model


def quality_scores(docs: DataFrame, model: FactorMachine, *, text: str = "text", declared: str | None = "n_chars", threshold: float = THRESHOLD, out: str = "quality") -> DataFrame:
    """``docs`` with a struct column ``out``: score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts are scored by their statistics; a null or missing declared length has its own bin; repeated
    rows get equal scores; an input column named ``out`` is replaced.  The whole text is read, whatever its length.
    """

    def make():
        features = featuriser()

        def work(rows):
            made = [features(*r) for r in rows]
            return [(float(s),) for s in model.score([w for w, _ in made], [s for _, s in made])]

        return work

    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    wide = docs.select(*columns, per_text(make, SCORE)(_inputs(docs, text, declared)).alias("__s"))
    return wide.withColumn(out, F.struct(F.col("__s.score").alias("score"), (F.col("__s.score") >= threshold).cast("int").alias("predicted"))).drop("__s")
