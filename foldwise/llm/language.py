"""Language identification by Bayesian evidence fusion.

log posterior = log prior of the host + text log likelihood + log likelihood of the declared markup language.
Priors are smoothed along address levels: all rows, address suffix, registered domain, host; each level leans on
the one above it.  Their counts are sums of text posteriors by grouped aggregation, and a row's own share is taken
out again at every level, so that no evidence counts twice.
"""
import json
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import alnum_words, crc_bucket, per_text
from foldwise.session import size_checked_broadcast

BUCKET_BITS = 14
#: Bytes of the word table of a task, and labels whose bucket counts a task holds at a time.
WORD_TABLE_BYTES, HELD_LABELS = 51_200_000, 64
#: Smoothing counts: of a bucket, of each address level towards the one above, of declared languages.
ALPHA, LEVEL_PRIOR, MARKUP_PRIOR = 0.5, 20.0, 10.0
#: Words of evidence that a text counts for at most, and the share of a declared language taken as true beforehand.
TEXT_WORDS, MARKUP_TRUST = 40.0, 0.9
MIN_POSTERIOR = 0.5
HELD_OUT = (4, 2)
LEVELS = ("suffix", "domain", "host")
#: Second-level labels under which a country's domains are registered.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu")

_RAW = re.compile(rb"(?i)(script|style)\b")
_RAW_END = {n: re.compile(rb"(?i)</%s\s*+>" % n) for n in (b"script", b"style")}
_ENTITY = re.compile(rb"&#?\w{1,10};")
_CODE = rb"\s*+=\s*+(?:[\"']\s*+)?([a-z]{2,3})(?![a-z])"
_OPENED = {n: re.compile(rb"(?i)<%s\b" % n) for n in (b"html", b"meta")}
#: Tags and what stands in them one after the other; the last has the language.
_DECLARED = ((b"html", re.compile(rb"(?i)\s(?:xml:)?lang" + _CODE)),
             (b"meta", re.compile(rb"(?i)http-equiv\s*+=\s*+[\"']?content-language[\"']?"), re.compile(rb"(?i)content" + _CODE)),
             (b"meta", re.compile(rb"(?i)property\s*+=\s*+[\"']?og:locale[\"']?"), re.compile(rb"(?i)content" + _CODE)))

EVIDENCE = T.StructType([T.StructField("loglik", T.ArrayType(T.DoubleType())), T.StructField("n_words", T.LongType()), T.StructField("declared", T.StringType())])


def visible_text(markup: bytes) -> bytes:
    """The text outside tags, comments, scripts, styles and entities.  Each byte is passed a bounded number of times: what
    closes nothing from one place on is not looked for again."""
    out, at, ends = [], 0, {b"-->", *_RAW_END}
    while (open_at := markup.find(b"<", at)) >= 0:
        close = markup.find(b">", open_at)
        if close < 0:
            break
        end = close + 1
        if markup.startswith(b"<!--", open_at):
            if b"-->" in ends:
                found = markup.find(b"-->", open_at + 4)
                end = found + 3 if found >= 0 else end
                if found < 0:
                    ends.discard(b"-->")
        elif (m := _RAW.match(markup, open_at + 1)) and (name := m[1].lower()) in ends:
            found = _RAW_END[name].search(markup, m.end())
            end = found.end() if found else end
            if not found:
                ends.discard(name)
        out += [markup[at:open_at], b" "]
        at = end
    out.append(markup[at:])
    return b"".join(_ENTITY.sub(b" ", x) for x in out)


def _tags(markup: bytes, name: bytes):
    """What stands in each tag of this name, up to its end or the end of the text."""
    at = 0
    while m := _OPENED[name].search(markup, at):
        at = markup.find(b">", m.end())
        at = len(markup) if at < 0 else at
        yield markup[m.end():at]


def declared_language(markup: bytes) -> str | None:
    """Primary subtag declared by <html lang>, a content-language header or og:locale, in this order."""
    for name, *patterns in _DECLARED:
        for inside in _tags(markup, name):
            at, m = 0, None
            for pattern in patterns:
                m = pattern.search(inside, at)
                if not m:
                    break
                at = m.end()
            if m:
                return m[1].decode().lower()
    return None


def word_buckets(word: bytes) -> tuple[int, ...]:
    """Buckets of the word, its beginnings and its ends."""
    mask = (1 << BUCKET_BITS) - 1
    return tuple(crc32(x) & mask for x in (b"w" + word, b"2" + word[:2], b"3" + word[:4], b"<" + word[-2:], b">" + word[-4:]))


@dataclass
class TextModel:
    languages: list[str]
    logprob: np.ndarray  # bucket x language


class WordTable:
    """Log likelihoods of the words seen lately, one row a word."""

    def __init__(self, model: TextModel, limit: int = 200_000):
        self.model, self.limit, self.index = model, max(1, min(limit, WORD_TABLE_BYTES // (4 * len(model.languages)))), {}
        limit = self.limit
        self.rows = np.zeros((limit, len(model.languages)), dtype=np.float32)

    def loglik(self, words: list[bytes]) -> np.ndarray:
        count, out = Counter(words), np.zeros(len(self.model.languages))
        distinct = list(count)
        for at in range(0, len(distinct), self.limit):
            part = distinct[at:at + self.limit]
            new = [w for w in part if w not in self.index]
            if len(self.index) + len(new) > self.limit:
                self.index.clear()
                new = part
            if new:
                first = len(self.index)
                self.rows[first:first + len(new)] = self.model.logprob[np.array([word_buckets(w) for w in new])].sum(axis=1)
                self.index.update(zip(new, range(first, first + len(new))))
            place = np.fromiter(map(self.index.__getitem__, part), dtype=np.int64, count=len(part))
            out += np.fromiter(map(count.__getitem__, part), dtype=np.float64, count=len(part)) @ self.rows[place]
        return out


def _count(place: dict[str, int]):
    """Worker: bucket counts by the label's place, summed over a task for up to HELD_LABELS labels at a time."""

    def flush(held):
        for label, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["label", "bucket", "n"])
        held.clear()

    def count(batches):
        held = defaultdict(lambda: np.zeros(1 << BUCKET_BITS, dtype=np.int64))
        for batch in batches:
            words = defaultdict(Counter)
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words[place[label]].update(alnum_words(text or b""))
            for label, found in words.items():
                if found:
                    if label not in held and len(held) >= HELD_LABELS:
                        yield from flush(held)
                    buckets = np.array([word_buckets(w) for w in found])
                    held[label] += np.bincount(buckets.ravel(), np.repeat(list(found.values()), buckets.shape[1]), 1 << BUCKET_BITS).astype(np.int64)
        yield from flush(held)

    return count


def train_text_model(docs: DataFrame, *, text: str = "text", label: str = "lang", doc_id: str = "doc_id", held_out: tuple[int, int] | None = HELD_OUT) -> TextModel:
    """Naive Bayes over hashed words, word beginnings and word ends, counted over all labelled rows outside the
    held-out remainder.  Every label is learnt (64 KB of the model each); null and empty ones are no labels.
    No labelled rows give one language 'und'."""
    rows = docs.select(F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{text}`").cast("binary").alias("text"), F.col(f"`{doc_id}`").alias("id")).filter("label is not null and trim(label) <> ''")
    if held_out:
        rows = rows.filter(F.col("id").isNull() | (crc_bucket("id", held_out[0]) != held_out[1]))
    languages = sorted(r.label for r in rows.select("label").distinct().collect()) or ["und"]
    place = {x: k for k, x in enumerate(languages)}
    counts = rows.select("label", "text").mapInArrow(_count(place), "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    # at most 2^BUCKET_BITS rows a language
    table = np.full((1 << BUCKET_BITS, len(languages)), ALPHA)
    made = counts.toPandas()
    table[made["bucket"].to_numpy(dtype=int), made["label"].to_numpy(dtype=int)] += made["n"].to_numpy(dtype=float)
    return TextModel(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def text_evidence(model: TextModel):
    """Worker over (text, markup): the markup's visible text is taken where there is markup.  A text counts as TEXT_WORDS words at most."""

    def make():
        table = WordTable(model)

        def work(rows):
            out = []
            for text, markup in rows:
                words = alnum_words(visible_text(markup) if markup is not None else text or b"")
                raw = table.loglik(words)
                # five buckets a word, and at most TEXT_WORDS words: neither are independent
                scale = min(len(words), TEXT_WORDS) / max(1, len(words)) / 5
                out.append(((raw * scale).tolist(), len(words), declared_language(markup) if markup is not None else None))
            return out

        return work

    return make


def address_levels(url: Column, host: Column) -> dict[str, Column]:
    """Suffix, registered domain and host: of the address where there is one, else of the given host name."""
    of_url = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    name = F.coalesce(F.nullif(of_url, F.lit("")), F.lower(host), F.lit(""))
    parts = F.split(name, r"\.")
    size = F.size(parts)
    suffix = F.when(size > 1, F.element_at(parts, -1)).otherwise("")
    deep = (size > 2) & (F.length(suffix) == 2) & F.element_at(parts, F.when(size > 2, F.lit(-2)).otherwise(F.lit(-1))).isin(*SECOND_LEVEL)
    domain = F.array_join(F.slice(parts, F.greatest(size - F.when(deep, 2).otherwise(1), F.lit(1)), 3), ".")
    return {"suffix": suffix, "domain": F.when(size > 1, domain).otherwise(name), "host": name}


def _let(x: Column, body) -> Column:
    """``body`` of a variable bound to ``x``: inside a lambda function an expression would be computed anew for each element."""
    return F.element_at(F.transform(F.array(x), body), 1)


def softmax(x: Column) -> Column:
    shares = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda v: v / s))
    return _let(x, lambda y: _let(F.array_max(y), lambda top: _let(F.transform(y, lambda v: F.exp(v - top)), shares)))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(vector: Column, n: int) -> list[Column]:
    return [F.sum(vector[k]).alias(f"p{k}") for k in range(n)]


def language_fusion(rows: DataFrame, model: TextModel, *, text: str = "text", markup: str | None = None, url: str | None = None, host: str | None = None,
                    targets: tuple[str, ...] | None = None, min_posterior: float = MIN_POSTERIOR, out: str = "language") -> DataFrame:
    """``rows`` with a struct column ``out``: language, posterior, text_language, text_posterior, declared, host,
    n_words, kept (a posterior of at least ``min_posterior`` for a language of ``targets``, all known ones by default, and
    evidence for it: a word, or a declared language).

    ``markup`` names a column of HTML (its visible text replaces ``text`` where it is not null), ``url`` one of
    addresses, ``host`` one that stands for the host where there is no address.  Null evidence is left out of the
    sum; rows without any get the prior of all rows and are not kept.  Ties go to the first language by name.
    Repeated rows count as often as they occur; an empty table gives an empty one; an input column named ``out`` is replaced.
    """
    n = len(model.languages)
    column = lambda c, kind="string": F.col(f"`{c}`").cast(kind) if c and c in rows.columns else F.lit(None).cast(kind)
    seen = per_text(text_evidence(model), EVIDENCE)(F.struct(column(text).alias("text"), column(markup).alias("markup")))
    kept = [c for c in rows.columns if c.lower() != out.lower()]
    levels = address_levels(column(url), column(host))
    wide = rows.select(*[F.col(f"`{c}`") for c in kept], seen.alias("__e"), *[levels[k].alias(f"__{k}") for k in LEVELS])
    wide = wide.withColumn("__own", softmax(F.col("__e.loglik")))
    # text posteriors by host (and declared language): map-side sums, one row a host and task at most
    counted = wide.filter(F.col("__e.n_words") > 0).groupBy("__suffix", "__domain", "__host", F.col("__e.declared").alias("__declared")).agg(*_sums(F.col("__own"), n)).persist()
    total = lambda *by: counted.groupBy(*by).agg(*[F.sum(f"p{k}").alias(f"p{k}") for k in range(n)])
    vector = lambda name: F.array(*[F.col(f"p{k}") for k in range(n)]).alias(name)
    everything = [float(x or 0) for x in total().first()] if n else []
    by_level = {k: total(*[f"__{x}" for x in LEVELS[:i + 1]]).select(*[f"__{x}" for x in LEVELS[:i + 1]], vector(f"__n_{k}")) for i, k in enumerate(LEVELS)}
    hosts = by_level["host"].join(by_level["domain"], ["__suffix", "__domain"]).join(by_level["suffix"], "__suffix")
    declared = {r["__declared"]: [float(r[f"p{k}"]) for k in range(n)] for r in total("__declared").filter(F.col("__declared").isNotNull()).collect()}
    hosts, _ = size_checked_broadcast(hosts)
    wide = wide.join(hosts, [f"__{k}" for k in LEVELS], "left")
    counted.unpersist()

    zero = F.array(*[F.lit(0.0)] * n)
    own = F.when(F.col("__e.n_words") > 0, F.col("__own")).otherwise(zero)
    prior = F.array(*[F.lit(1.0 / n)] * n)
    for name in ("all", *LEVELS):
        counts = F.array(*[F.lit(x) for x in everything]) if name == "all" else F.coalesce(F.col(f"__n_{name}"), zero)
        # a row's own posterior is no evidence for its prior; differences of sums can fall below zero by rounding
        others = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
        wide = wide.withColumn(f"__at_{name}", _smoothed(others, prior))
        prior = F.col(f"__at_{name}")
    wide = wide.withColumn("__prior", prior)
    wide = wide.withColumn("__post", softmax(reduce(_add, [F.transform("__prior", lambda x: F.log(x)), F.when(F.col("__e.n_words") > 0, F.col("__e.loglik")).otherwise(zero),
                                                              markup_evidence(F.col("__e.declared"), declared, model.languages)])))
    names = F.array(*[F.lit(x) for x in model.languages])
    best, text_best = F.array_max("__post"), F.array_max("__own")
    language = F.element_at(names, F.array_position("__post", best).cast("int"))
    known = F.array(*[F.lit(x) for x in (targets if targets is not None else model.languages)]) if targets is None or targets else F.array().cast("array<string>")
    made = F.struct(language.alias("language"), best.alias("posterior"), F.element_at(names, F.array_position("__own", text_best).cast("int")).alias("text_language"), text_best.alias("text_posterior"),
                    F.col("__e.declared").alias("declared"), F.col("__host").alias("host"), F.col("__e.n_words").alias("n_words"),
                    ((best >= min_posterior) & F.array_contains(known, language) & ((F.col("__e.n_words") > 0) | F.col("__e.declared").isNotNull())).alias("kept"))
    return wide.select(*[F.col(f"`{c}`") for c in kept], made.alias(out))


def _smoothed(counts: Column, above: Column) -> Column:
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    return _let(counts, lambda c: _let(size(c), lambda s: F.zip_with(c, above, lambda x, p: (x + LEVEL_PRIOR * p) / (s + LEVEL_PRIOR))))


def markup_evidence(declared: Column, counts: dict[str, list[float]], languages: list[str]) -> Column:
    """Log likelihood of the declared language given each true one: how often rows of that text language declare it,
    with MARKUP_PRIOR rows beforehand of which MARKUP_TRUST declare the truth."""
    per_language = [sum(c[k] for c in counts.values()) for k in range(len(languages))]
    rest = (1 - MARKUP_TRUST) / max(1, len(languages) - 1)
    lists = {m: [float(np.log((c[k] + MARKUP_PRIOR * (MARKUP_TRUST if m == lang else rest)) / (per_language[k] + MARKUP_PRIOR))) for k, lang in enumerate(languages)] for m, c in counts.items()}
    unseen = F.array(*[F.lit(0.0)] * len(languages))
    if not lists:
        return unseen
    table = F.from_json(F.lit(json.dumps(lists)), "map<string,array<double>>")  # one literal, whatever its size
    return F.coalesce(F.when(declared.isNotNull(), F.try_element_at(table, declared)), unseen)
