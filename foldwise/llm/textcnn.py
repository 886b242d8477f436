"""Toxicity: a convolutional text classifier over hashed word embeddings, learnt from all labelled rows in shards.

Each word takes the sum of two rows of one embedding table (two hashes, so that a rare word that shares one row
with a telling word shares half of it only).  Filters of several widths slide over the words of the whole text;
the maximum of each over all positions goes to a logistic layer.  Thresholds are calibrated by language.
"""
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.averaging import averaged, deal, joined, n_shards, packed, rounds_of, shard_sum, unpacked
from foldwise.llm.common import Buckets, alnum_words, labelled_rows, per_text

ROW_BITS = 18
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
THRESHOLD = 0.3
HELD_OUT = (4, 2)
#: Words of one block of the convolution; long texts are taken block by block, overlapping by the widest filter.
BLOCK = 1 << 16
#: Strength of the smoothing of a word's log odds, and of a language's threshold towards the common one (in positives).
PRIOR = 4.0
LANGUAGE_PRIOR = 20.0
#: Passes over the rows, minibatches at the least, rows of one, step size.
EPOCHS, STEPS, BATCH, RATE = 6, 200, 32, 0.05
#: Decimals of the margins that the calibration counts.
MARGIN_DIGITS = 3

WORDS = T.StructType([T.StructField("words", T.BinaryType())])
SCORE = T.StructType([T.StructField("score", T.DoubleType())])


def code_of(word: bytes) -> int:
    """Two row numbers of ROW_BITS each."""
    return xxhash.xxh64_intdigest(word, 11) & ((1 << 2 * ROW_BITS) - 1)


def word_codes(text: bytes | None, buckets: Buckets) -> np.ndarray:
    words = alnum_words(text or b"")
    return np.fromiter(map(buckets.__getitem__, words), dtype=np.int64, count=len(words))


def rows_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return codes & ((1 << ROW_BITS) - 1), codes >> ROW_BITS


@dataclass
class TextCNN:
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    filter_bias: np.ndarray
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    common_threshold: float = THRESHOLD

    def embed(self, codes: np.ndarray) -> np.ndarray:
        a, b = rows_of(codes)
        return self.embedding[a] + self.embedding[b]

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, the filters' responses at every window of the rows ``x``: one product for all filters,
        whose shifted slices are added."""
        z = x @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        out, at = [], 0
        for width in WIDTHS:
            n = len(x) - width + 1
            y = z[:n, at:at + FILTERS]
            for j in range(1, width):
                y = y + z[j:n + j, at + j * FILTERS:at + (j + 1) * FILTERS]
            out.append(y)
            at += width * FILTERS
        return out

    def pooled(self, codes: np.ndarray, places: bool = False):
        """The largest response of every filter (and where), over all blocks.  A text shorter than a filter is padded with zeros."""
        wide = WIDTHS[-1]
        best = np.full(len(WIDTHS) * FILTERS, -np.inf, dtype=np.float32)
        where = np.zeros(len(best), dtype=np.int64)
        for start in range(0, max(1, len(codes)), BLOCK):
            x = self.embed(codes[start:start + BLOCK + wide - 1])
            if len(x) < wide:
                x = np.concatenate([x, np.zeros((wide - len(x), DIM), np.float32)])
            for k, y in enumerate(self.responses(x)):
                top = y.argmax(axis=0)
                value, part = y[top, np.arange(FILTERS)], slice(k * FILTERS, (k + 1) * FILTERS)
                better = value > best[part]
                best[part] = np.where(better, value, best[part])
                where[part] = np.where(better, top + start, where[part])
        return (best, where) if places else best

    def margins(self, texts: list[np.ndarray]) -> np.ndarray:
        """Raw margins of many texts; short ones share one convolution, with zeros between them."""
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK):
                held += len(texts[end]) + WIDTHS[-1]
                end += 1
            pooled = self.pooled(texts[at])[None] if end == at + 1 else self._pooled_together(texts[at:end])
            out[at:end] = np.maximum(pooled + self.filter_bias, 0) @ self.out + self.bias
            at = end
        return out

    def _pooled_together(self, texts: list[np.ndarray]) -> np.ndarray:
        wide = WIDTHS[-1]
        sizes = np.array([len(t) for t in texts])
        spans = np.maximum(sizes, wide) + wide - 1  # zeros after each text
        starts = np.concatenate([[0], np.cumsum(spans)])
        x = np.zeros((starts[-1], DIM), np.float32)
        x[np.repeat(starts[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = self.embed(np.concatenate(texts))
        best = []
        for width, y in zip(WIDTHS, self.responses(x)):
            # positions of a text's own windows only; one row more, so that the last bound may be the end
            ends = starts[:-1] + np.maximum(sizes, wide) - width + 1
            bounds = np.stack([starts[:-1], np.minimum(ends, len(y))], axis=1).ravel()
            y = np.concatenate([y, np.full((1, FILTERS), -np.inf, np.float32)])
            best.append(np.maximum.reduceat(y, bounds, axis=0)[::2])
        return np.concatenate(best, axis=1)

    def scaled(self, margins: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.scaled(self.margins(texts))


def _row_counts(texts, y) -> np.ndarray:
    """Documents of each label (row) that hold a word of each embedding row (column)."""
    counts = np.zeros((2, 1 << ROW_BITS))
    for codes, label in zip(texts, y):
        for part in rows_of(codes):
            counts[int(label), np.unique(part)] += 1
    return counts


def _init(counts: np.ndarray, n: float, positive: float, rng) -> TextCNN:
    """Small random weights; the first embedding dimension starts at the smoothed log odds of a word's documents."""
    rows = 1 << ROW_BITS
    embedding = rng.normal(0, 0.05, (rows, DIM)).astype(np.float32)
    counts = counts.copy()
    share = max(counts[1].sum() / max(1.0, counts.sum()), 1e-9)
    # less the one document at hand: a word of a single toxic document tells nothing of the next one
    counts[1] = np.maximum(counts[1] - 1, 0)
    total = counts.sum(axis=0)
    embedding[:, 0] += (np.log((counts[1] + PRIOR * share) / (total + PRIOR)) - np.log(share)).astype(np.float32) / 2
    filters = [rng.normal(0, 0.3 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] += 1.0
    size = len(WIDTHS) * FILTERS
    odds = (positive + 1) / (n - positive + 1)
    return TextCNN(embedding, filters, np.zeros(size, np.float32), rng.normal(0, 0.1, size).astype(np.float32), float(np.log(odds)))


def _constant(n: float, positive: float, rng) -> TextCNN:
    """For one class alone: a model at its smoothed share."""
    model = _init(np.zeros((2, 1 << ROW_BITS)), 0, 0, rng)
    share = (positive + 1) / (n + 2)
    model.out[:], model.bias = 0, float(np.log(share / (1 - share)))
    return model


def _gradient_sums(model: TextCNN) -> dict:
    return {"e": np.full(model.embedding.shape, 1e-2, np.float32), "f": [np.full_like(f, 1e-2) for f in model.filters], "c": np.full_like(model.filter_bias, 1e-2), "o": np.full_like(model.out, 1e-2), "b": 1e-2}


def _passes(n: int, epochs: int, steps: int, batch: int) -> int:
    return max(epochs, -(-steps // -(-max(1, n) // batch)))


def fit(texts: list[np.ndarray], y: np.ndarray, languages: list[str | None], epochs: int = EPOCHS, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 3) -> TextCNN:
    """Logistic loss by AdaGrad; gradients flow through the places of the maxima.  A tenth of the rows calibrates the
    score and the thresholds.  One class alone gives a constant model at its smoothed share."""
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        return _constant(len(y), y.sum(), rng)
    held = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        held[rng.permutation(np.flatnonzero(y == label))[:int((y == label).sum()) // 10]] = True
    learn = np.flatnonzero(~held)
    model = _init(_row_counts([texts[i] for i in learn], y[learn]), len(learn), y[learn].sum(), rng)
    grads = _gradient_sums(model)
    for _ in range(_passes(len(learn), epochs, steps, batch)):
        order = rng.permutation(learn)
        for at in range(0, len(order), batch):
            _step(model, grads, [texts[i] for i in order[at:at + batch]], y[order[at:at + batch]], rate)
    at = np.flatnonzero(held)
    _calibrate(model, model.margins([texts[i] for i in at]), y[at], [languages[i] for i in at], np.ones(len(at)))
    return model


def _step(model: TextCNN, grads: dict, texts: list[np.ndarray], y: np.ndarray, rate: float) -> None:
    pooled, where = map(np.array, zip(*(model.pooled(t, places=True) for t in texts)))
    hidden = np.maximum(pooled + model.filter_bias, 0)
    error = ((1 / (1 + np.exp(-np.clip(hidden @ model.out + model.bias, -30, 30)))) - y).astype(np.float32) / len(y)
    back = error[:, None] * model.out * (pooled + model.filter_bias > 0)

    def move(value, held, d):
        held += d * d
        value -= rate * d / np.sqrt(held)

    d_out = hidden.T @ error
    used_rows, used_grads, d_filters = [], [], [np.zeros_like(f) for f in model.filters]
    for codes, places, b in zip(texts, where, back):
        for k, width in enumerate(WIDTHS):
            for j in range(width):
                part = slice(k * FILTERS, (k + 1) * FILTERS)
                at = places[part] + j
                inside = at < len(codes)
                if not inside.any():
                    continue
                word = codes[at[inside]]
                g = b[part][inside]
                d_filters[k][j][:, inside] += model.embed(word).T * g
                d_word = g[:, None] * model.filters[k][j][:, inside].T
                for rows in rows_of(word):
                    used_rows.append(rows)
                    used_grads.append(d_word)
    move(model.out, grads["o"], d_out)
    move(model.filter_bias, grads["c"], back.sum(axis=0))
    for f, held, d in zip(model.filters, grads["f"], d_filters):
        move(f, held, d)
    if used_rows:
        rows, place = np.unique(np.concatenate(used_rows), return_inverse=True)
        d = np.zeros((len(rows), DIM), np.float32)
        np.add.at(d, place, np.concatenate(used_grads))
        grads["e"][rows] += d * d
        model.embedding[rows] -= rate * d / np.sqrt(grads["e"][rows])
    d_bias = float(error.sum())
    grads["b"] += d_bias ** 2
    model.bias -= rate * d_bias / np.sqrt(grads["b"])


def _calibrate(model: TextCNN, margins: np.ndarray, labels: np.ndarray, languages: list[str | None], times: np.ndarray) -> None:
    """Platt scaling and thresholds on the rows held back, each counted ``times``; with few of a class the scale stays
    as it is.  A language's threshold is its best by F1, drawn to the common one by its few positives."""
    positive, n = float((labels * times).sum()), float(times.sum())
    if min(positive, n - positive) >= 10:
        m, (a, b) = margins, (1.0, 0.0)
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
            # drawn to no change, so that separable rows don't scale without end
            a, b = a - 0.05 * (np.average((p - labels) * m, weights=times) + 0.05 * (a - 1)), b - 0.05 * (np.average(p - labels, weights=times) + 0.05 * b)
        model.scale = (float(max(a, 0.1)), float(b))
    scores = model.scaled(margins)
    model.common_threshold = _best_threshold(scores, labels, times)
    for language in sorted({x for x in languages if x}):
        own = np.array([x == language for x in languages])
        n = float((labels[own] * times[own]).sum())
        model.thresholds[language] = (n * _best_threshold(scores[own], labels[own], times[own]) + LANGUAGE_PRIOR * model.common_threshold) / (n + LANGUAGE_PRIOR) if n else model.common_threshold


def _best_threshold(scores: np.ndarray, labels: np.ndarray, times: np.ndarray) -> float:
    grid = np.arange(0.05, 0.96, 0.05)
    positive = labels * times
    f1 = [2 * positive[scores >= t].sum() / max(1, times[scores >= t].sum() + positive.sum()) for t in grid]
    best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
    return float(grid[best[np.argmin(np.abs(grid[best] - THRESHOLD))]])


def _code_worker():
    buckets = Buckets(code_of)
    return lambda texts: [(packed(word_codes(t, buckets)),) for t in texts]


def _parts(model: TextCNN, grads: dict) -> list:
    return [model.embedding, *model.filters, model.filter_bias, model.out, model.bias, grads["e"], *grads["f"], grads["c"], grads["o"], grads["b"]]


def _whole(parts: list) -> tuple[TextCNN, dict]:
    k = len(WIDTHS)
    e, f, (c, o, b), (ge, *gf), (gc, go, gb) = parts[0], parts[1:1 + k], parts[1 + k:4 + k], parts[4 + k:5 + 2 * k], parts[5 + 2 * k:]
    return TextCNN(e, list(f), c, o, b), {"e": ge, "f": gf, "c": gc, "o": go, "b": gb}


def train_toxicity(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", language: str = "lang",
                   held_out: tuple[int, int] = HELD_OUT) -> TextCNN:
    """Learns from every labelled row outside the held-out remainder, whole texts: Spark hashes the words, counts the
    rows of each and runs the passes on shards, whose models are averaged after each.  A tenth, by a hash of the id,
    calibrates the score and the thresholds, by counts of its margins to ``MARGIN_DIGITS`` decimals.  The language
    column calibrates thresholds and enters no score."""
    rng = np.random.default_rng(3)
    columns = [text] + ([language] if language in docs.columns else [])
    known = labelled_rows(docs, labels, label=label, columns=columns, doc_id=doc_id, held_out=held_out)
    shards = n_shards(known, text)
    lang = F.col(f"`{language}`").cast("string") if language in docs.columns else F.lit(None).cast("string")
    rows = deal(known.select("__id", F.col(label).alias("y"), lang.alias("lang"), per_text(_code_worker, WORDS)(F.col(f"`{text}`")).alias("f")).select("__id", "y", "lang", F.col("f.words").alias("words")), shards)
    held = F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(10)) == 0
    learn, rest = rows.filter(~held).select("y", "words"), rows.filter(held)
    sizes = {r["y"]: r["count"] for r in learn.groupBy("y").count().collect()}
    n, positive = sum(sizes.values()), sizes.get(1, 0)
    if len(sizes) < 2:
        both = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        return _constant(sum(both.values()), both.get(1, 0), rng)

    def count(columns, shard):
        return 1.0, [_row_counts((unpacked(x, np.int64) for x in columns["words"]), columns["y"]).ravel()]

    model = _init(joined(shard_sum(learn, shards, count)[1][0])[0].reshape(2, -1), n, positive, rng)
    passes = _passes(n, EPOCHS, STEPS, BATCH)
    rounds = rounds_of(passes, EPOCHS, shards)

    def move(parts, columns, rng):
        model, grads = _whole(parts)
        y = np.array(columns["y"], dtype=float)
        for _ in range(-(-passes // rounds)):
            order = rng.permutation(len(y))
            for at in range(0, len(order), BATCH):
                pick = order[at:at + BATCH]
                _step(model, grads, [unpacked(columns["words"][i], np.int64) for i in pick], y[pick], RATE)
        return _parts(model, grads)

    model, _ = _whole(averaged(learn, shards, _parts(model, _gradient_sums(model)), rounds, move, seed=3))

    def margins(batches):
        for batch in batches:
            found = model.margins([unpacked(x, np.int64) for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(found, MARGIN_DIGITS))], names=["y", "lang", "margin"])

    seen = rest.select("y", "lang", "words").mapInArrow(margins, "y int, lang string, margin double").groupBy("lang", "margin", "y").agg(F.count(F.lit(1)).alias("times")).orderBy("lang", "margin", "y").toPandas()
    _calibrate(model, seen["margin"].to_numpy(dtype=float), seen["y"].to_numpy(dtype=float), [x if isinstance(x, str) else None for x in seen["lang"]], seen["times"].to_numpy(dtype=float))
    return model


def toxicity_scores(docs: DataFrame, model: TextCNN, *, text: str = "text", language: str = "lang", threshold: float = THRESHOLD, out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``out``: score (0 to 1), predicted (1 if score >= threshold, else 0),
    language_threshold (by the language column; the common one for null, unknown or missing languages) and
    flagged (score >= language_threshold).

    Null and empty texts are scored as texts without words; repeated rows get equal scores; an input column named
    ``out`` is replaced.  Whole texts are read, in blocks where they are long.
    """

    def make():
        buckets = Buckets(code_of)
        return lambda texts: [(float(s),) for s in model.score([word_codes(t, buckets) for t in texts])]

    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    limit = F.lit(model.common_threshold)
    if language in docs.columns:
        for name, value in model.thresholds.items():
            limit = F.when(F.col(f"`{language}`") == name, F.lit(value)).otherwise(limit)
    wide = docs.select(*columns, per_text(make, SCORE)(F.col(f"`{text}`")).alias("__s"), limit.alias("__limit"))
    score = F.col("__s.score")
    made = F.struct(score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.col("__limit").alias("language_threshold"), (score >= F.col("__limit")).alias("flagged"))
    return wide.withColumn(out, made).drop("__s", "__limit")
