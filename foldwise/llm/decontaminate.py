"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, each text scanned once.

Words of the items get a code point each, so that a window of words is a short string and a text becomes one
character a word (all words that no item has share one character, which no pattern holds).  The automaton then
runs over words, not bytes; hits come back as word positions and, for texts with hits, as offsets in the original.
"""
import re
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import alnum_words, per_text
from foldwise.session import materialize

#: Words of one automaton's windows.  Items beyond it are taken in further blocks, each scanned in turn.
BLOCK_WORDS = 4_000_000
WINDOW = 13
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_CASED_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_words", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


def item_windows(text: bytes | None, width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All ``width``-word windows; a shorter item is one window, an empty one has none."""
    words = alnum_words(text or b"")
    if not words:
        return []
    return [tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]


def item_blocks(items: list[tuple[str, bytes]], width: int, block_words: int = BLOCK_WORDS) -> list[dict]:
    """Windows with the ids of their items, in blocks of at most ``block_words`` words."""
    blocks: list[dict] = [{}]
    held = 0
    for key, text in items:
        for window in item_windows(text, width):
            at = next((b for b in blocks if window in b), None)
            if at is None:
                if held + len(window) > block_words:
                    blocks.append({})
                    held = 0
                at = blocks[-1]
                held += len(window)
            at.setdefault(window, set()).add(key)
    return [b for b in blocks if b]


class WindowScanner:
    """The automaton of one block."""

    def __init__(self, windows: dict):
        import ahocorasick

        vocabulary = sorted({w for window in windows for w in window})
        # code 0 is for other words; surrogates are left out
        codes = (c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
        self.code = {w: chr(c) for w, c in zip(vocabulary, codes, strict=False)}
        if len(self.code) < len(vocabulary):
            raise ValueError("more distinct words than code points in one block: lower block_words")
        self.machine = ahocorasick.Automaton()
        for window, keys in windows.items():
            self.machine.add_word("".join(self.code[w] for w in window), (len(window), tuple(sorted(keys))))
        self.machine.make_automaton()

    def scan(self, words: list[bytes]):
        """(first word, last word + 1, item ids) of each occurrence."""
        code = self.code
        line = "".join([code.get(w, "\0") for w in words])
        if line.count("\0") == len(line):
            return []
        return [(end + 1 - n, end + 1, keys) for end, (n, keys) in self.machine.iter(line)]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def original_spans(text: bytes, words: list[list[int]]) -> list[list[int]]:
    """Character offsets [start, end) in the original text of runs of words."""
    at = np.array([m.span() for m in _CASED_WORD.finditer(text.decode())], dtype=np.int64)
    return [[int(at[a][0]), int(at[b - 1][1])] for a, b in words]


def scan_texts(blocks: list[dict]):
    """Worker factory over (text, items so far, runs so far): the automata are built once a task from the shipped windows."""

    def make():
        machines = [WindowScanner(b) for b in blocks]

        def work(rows):
            out = []
            for text, items, runs in rows:
                words = alnum_words(text or b"")
                found = list(chain.from_iterable(m.scan(words) for m in machines)) if words else []
                runs = merged([(a, b) for a, b, _ in found] + [tuple(r) for r in runs or ()])
                keys = sorted({k for _, _, ks in found for k in ks}.union(items or ()))
                out.append((len(words), sum(b - a for a, b in runs), keys, runs, original_spans(text, runs) if runs else []))
            return out

        return work

    return make


def _pieces(width: int, piece_words: int):
    """Items' words, in pieces of at most ``piece_words`` that share ``width`` - 1 words, so that every window is in one."""
    schema = pa.schema([("k", pa.string()), ("part", pa.int64()), ("t", pa.binary())])

    def run(batches):
        for rows in batches:
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1)):
                words = alnum_words(text.as_py())
                step = max(1, piece_words - width + 1)
                for part, at in enumerate(range(0, max(1, len(words) - width + 1), step)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([part]), pa.array([b" ".join(words[at:at + piece_words])], pa.binary())], schema=schema)

    return run


def item_slices(items: DataFrame, item_id: str, item_text: str, max_bytes: int, width: int = WINDOW) -> Iterator[list[tuple[str, bytes]]]:
    """The items, an item's pieces among several slices if it is long, in as few hash slices (a power of two) as keep each
    within ``max_bytes``; one slice at a time is on the driver.  Null ids and texts are no items."""
    kept = items.select(F.col(item_id).cast("string").alias("k"), F.col(item_text).cast("binary").alias("t")).filter("k is not null and t is not null")
    # a word takes two bytes at least, so a piece of so many words is within a sixteenth of a slice unless its words are very long
    kept = materialize(kept.mapInArrow(_pieces(width, max(2 * width, max_bytes // 128)), "k string, part long, t binary"))
    slices, pieces = 1, kept.count()
    while True:
        own = F.pmod(F.xxhash64("k", "part"), F.lit(slices))
        largest = kept.groupBy(own.alias("s")).agg(F.sum(F.octet_length("t") + F.length("k") + 64).alias("n")).agg(F.max("n")).first()[0] or 0
        # more slices than pieces cannot make them smaller
        if largest <= max_bytes or slices > 4 * pieces:
            break
        slices *= 2
    for i in range(slices):
        yield [(r.k, bytes(r.t)) for r in kept.filter(own == i).collect()]


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  width: int = WINDOW, share: int = 20, max_item_bytes: int = 32 << 20, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit (words inside any occurrence of an item's window),
    items (ids with occurring windows, sorted as strings), hit_words (runs of word positions), spans (the same
    as character offsets in the original text), contaminated (n_hit > 0 and share * n_hit >= n_words).

    The items are shipped to the tasks while they fit ``max_item_bytes``; a larger benchmark, or a larger item, is scanned in
    several passes over hash slices of its windows, each within that bound, and each pass adds to the row's hits so far.
    Every pass but the last is checkpointed, so that neither the plan nor a task holds two slices.
    Null and empty texts have no words and are not contaminated; items without words never occur; repeated items
    count once; repeated rows are judged alike; an input column named ``out`` is replaced.
    """
    # the input columns travel in one struct, so that no name of theirs meets a name used here
    columns = [c for c in docs.columns if c.lower() != out.lower()]
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("__none")).alias("__row"), F.col(f"`{text}`").cast("string").alias("__text"))
    wide, scanned = wide.withColumn("__hits", F.lit(None).cast(HITS)), False
    for part in item_slices(items, item_id, item_text, max_item_bytes, width):
        wide = materialize(wide) if scanned else wide
        hits = F.struct("__text", F.col("__hits.items").alias("items"), F.col("__hits.hit_words").alias("runs"))
        wide, scanned = wide.withColumn("__hits", per_text(scan_texts(item_blocks(part, width)), HITS)(hits)), True
    hits = F.col("__hits")
    dirty = (hits["n_hit"] > 0) & (hits["n_hit"] * share >= hits["n_words"])
    made = F.struct(*[hits[n].alias(n) for n in HITS.names], dirty.alias("contaminated"))
    return wide.select(*[F.col("__row")[c].alias(c) for c in columns], made.alias(out))


def items_digest(items) -> F.Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
