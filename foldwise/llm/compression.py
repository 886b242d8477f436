"""Quality rules by compression bands: zstandard ratios of whole texts and of fixed chunks, with limits by length."""
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.llm.common import per_text, space_words

CHUNK_BYTES = 4096
LEVEL = 3
#: (bytes from, lowest ratio, highest ratio) of whole texts: compressed bytes over bytes. Short texts compress
#: little, long ones more, so that both limits fall with the length.
WHOLE_BANDS = ((0, 0.0, 20.0), (200, 0.25, 0.97), (500, 0.22, 0.88), (1000, 0.20, 0.82), (2000, 0.17, 0.76), (8000, 0.14, 0.72), (32000, 0.12, 0.70))
#: The same for the median of full chunks.
CHUNK_BAND = (0.15, 0.74)
#: Pieces cover a text to its end: of CHUNK_BYTES from LONG_BYTES on, else of SHORT_BYTES; a last one under LEAST_BYTES
#: joins the one before.  A text is rejected when pieces outside their limits hold more than OFF_SHARE of its bytes.
LONG_BYTES, SHORT_BYTES, LEAST_BYTES, OFF_SHARE = 16384, 1024, 200, 0.1
#: Limits of pieces by their bytes, between sf0.1's prose (at most 0.77 from 200 bytes on, 0.60 at 1,024) and base64 (0.97, 0.80).
PIECE_BANDS = ((0, 0.0, 20.0), (200, 0.35, 0.85), (350, 0.30, 0.81), (500, 0.25, 0.77), (700, 0.22, 0.73), (1000, 0.20, 0.71), (2000, 0.17, 0.72))

RATIOS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()), T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()), T.StructField("n_repeat_words", T.LongType()), T.StructField("whole_ratio", T.DoubleType()),
    T.StructField("chunk_ratio", T.DoubleType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("low_bytes", T.LongType()), T.StructField("high_bytes", T.LongType()),
])
_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_NOT_POINTS = _SPACE + bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=n)
    v, keys = len(index), ids[:n - width + 1]
    bound = v
    for k in range(1, width):
        if bound * v >= 1 << 62:
            keys = np.unique(keys, return_inverse=True)[1]
            bound = int(keys.max()) + 1
        keys = keys * v + ids[k:n - width + 1 + k]
        bound *= v
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + width, -1)
    return int((np.cumsum(steps[:n]) > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = space_words(text, lower=False)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (len(words), len(text.translate(None, _NOT_POINTS)), len(text) - len(text.translate(None, _SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def pieces(text: bytes, chunk_bytes: int = CHUNK_BYTES) -> list[bytes]:
    step = chunk_bytes if len(text) >= LONG_BYTES else min(chunk_bytes, SHORT_BYTES)
    cuts = [*range(0, len(text), step), len(text)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < LEAST_BYTES:
        del cuts[-2]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def make_worker(chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL, piece_bands=PIECE_BANDS, chunk_band=CHUNK_BAND):
    def limits(size: int) -> tuple[float, float]:
        """Of a piece: full chunks have their own, others those of their length."""
        return chunk_band if size == chunk_bytes else next(((a, b) for start, a, b in reversed(piece_bands) if size >= start), (0.0, float("inf")))

    def make():
        import zstandard

        press = zstandard.ZstdCompressor(level=level, write_content_size=False).compress

        def work(texts):
            out = []
            for text in texts:
                text = text or b""
                size = len(text)
                whole = len(press(text)) / size if size else None
                chunks = [len(press(text[a:a + chunk_bytes])) / chunk_bytes for a in range(0, size - chunk_bytes + 1, chunk_bytes)]
                low = high = 0
                for piece in pieces(text, chunk_bytes):
                    ratio, (least, most) = len(press(piece)) / len(piece), limits(len(piece))
                    low += len(piece) if ratio < least else 0
                    high += len(piece) if ratio > most else 0
                out.append((*base_counts(text), whole, float(np.median(chunks)) if chunks else None, len(chunks), size, low, high))
            return out

        return work

    return make


def verdict(ratios, whole_bands=WHOLE_BANDS, chunk_band=CHUNK_BAND):
    """'repetitive', 'incompressible' or 'ok' from a struct column of RATIOS; texts without bytes are 'ok'."""
    size, whole, chunk = ratios["n_bytes"], ratios["whole_ratio"], ratios["chunk_ratio"]
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for start, least, most in whole_bands:
        low, high = F.when(size >= start, F.lit(float(least))).otherwise(low), F.when(size >= start, F.lit(float(most))).otherwise(high)
    off = ratios["low_bytes"] + ratios["high_bytes"] > size * OFF_SHARE
    return (F.when((whole < low) | (chunk < chunk_band[0]), "repetitive")
            .when((whole > high) | (chunk > chunk_band[1]), "incompressible")
            .when(off, F.when(ratios["low_bytes"] > ratios["high_bytes"], "repetitive").otherwise("incompressible")).otherwise("ok"))


def compression_rules(docs: DataFrame, *, text: str = "text", chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL, whole_bands=WHOLE_BANDS,
                      chunk_band=CHUNK_BAND, out: str = "quality_rules") -> DataFrame:
    """``docs`` with a struct column ``out``: the base counts, whole_ratio, chunk_ratio (median over full chunks,
    null without one), n_chunks, n_bytes, low_bytes and high_bytes (in pieces under and over their limits), base_failed, band ('repetitive', 'incompressible' or 'ok'), kept.

    Null and empty texts have zero counts, null ratios and fail the base rule; repeated rows are judged alike;
    an input column named ``out`` is replaced.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != out.lower()]
    wide = docs.select(*columns, per_text(make_worker(chunk_bytes, level, chunk_band=chunk_band), RATIOS)(F.col(f"`{text}`")).alias("__ratios"))
    r = F.col("__ratios")
    failed = (r["n_words"] < 50) | (r["n_repeat_words"] * 100 > r["n_words"] * 50)
    band = verdict(r, whole_bands, chunk_band)
    made = F.struct(*[r[n].alias(n) for n in RATIOS.names], failed.alias("base_failed"), band.alias("band"), (~failed & (band == "ok")).alias("kept"))
    return wide.withColumn(out, made).drop("__ratios")
