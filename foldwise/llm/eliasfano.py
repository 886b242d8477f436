"""Elias-Fano sequences and an n-gram trie over them, queried in whole arrays.

A sorted sequence keeps the low bits of each value as they are and the high bits in unary; about two bits and the
low bits a value.  The trie has two levels: contexts, and the words that follow them.  Pointers into the second
level are a monotone sequence.  Followers are sorted within their context and made monotone by adding the context's base, so that
a search inside a context is a successor search near ``base + word``.  Probabilities are 8-bit codes.
"""
import tempfile

import numpy as np

CODES = 256


def _positions(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Bit positions of the ``rank``-th one (from 0) in each 64-bit word."""
    words, rank = words.copy(), rank.astype(np.int64)
    at = np.zeros(len(words), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(words & np.uint64((1 << width) - 1)).astype(np.int64)
        beyond = rank >= low
        rank -= low * beyond
        at += width * beyond
        words >>= (width * beyond).astype(np.uint64)
    return at


class EliasFano:
    """A non-decreasing sequence of whole numbers; ``parts`` are the arrays that hold it."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones, self.zeros = n, low_bits, low, high, ones, zeros
        # low bits are read as eight bytes from any byte on
        self._words = np.ndarray(max(0, len(low) - 7), dtype="<u8", buffer=low, strides=(1,))

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.low, self.high, self.ones, self.zeros

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        n = len(values)
        values = values.astype(np.uint64)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 7) // 8 + 8, dtype=np.uint8)
        if bits:
            for at in range(0, n, 1 << 20):  # 2^20 values hold whole bytes
                part = values[at:at + (1 << 20)] & np.uint64((1 << bits) - 1)
                unpacked = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=bits, bitorder="little")
                packed = np.packbits(unpacked.ravel(), bitorder="little")
                low[at * bits // 8:at * bits // 8 + len(packed)] = packed
        where = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = int(where[-1]) + 2 if n else 1
        flags = np.zeros(-(-(size + 1) // 64) * 64, dtype=np.uint8)
        flags[where] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)]).astype(np.uint32)
        return cls(n, bits, low, high, ones, (64 * np.arange(len(high) + 1) - ones).astype(np.uint32))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), dtype=np.uint64)
        bit = at.astype(np.int64) * self.low_bits
        return (self._words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at places ``at``."""
        word = np.searchsorted(self.ones, at, side="right") - 1
        bit = 64 * word + _positions(self.high[word], at - self.ones[word])
        return ((bit - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)

    def _bucket_start(self, bucket: np.ndarray) -> np.ndarray:
        """The place of the first value whose high part is ``bucket`` or more: the ones before the zero that opens it."""
        out = np.zeros(len(bucket), dtype=np.int64)
        later = np.flatnonzero(bucket > 0)
        rank = bucket[later] - 1
        word = np.searchsorted(self.zeros, rank, side="right") - 1
        out[later] = 64 * word + _positions(~self.high[word], rank - self.zeros[word]) - rank
        return out

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted value's first occurrence, -1 where it doesn't occur: its successor among the values of
        the same high part is searched by the low bits."""
        wanted = wanted.astype(np.uint64)
        place = np.full(len(wanted), -1, dtype=np.int64)
        bucket = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        todo = np.flatnonzero(bucket < 64 * len(self.high) - self.n - 1)
        bucket = bucket[todo]
        at, end = self._bucket_start(bucket), self._bucket_start(bucket + 1)
        low = wanted[todo] & np.uint64((1 << self.low_bits) - 1)
        some = end > at
        todo, at, end, low = todo[some], at[some], end[some], low[some]
        last, active = end.copy(), np.arange(len(at))
        while len(active):
            middle = (at[active] + end[active]) >> 1
            below = self._low(middle) < low[active]
            at[active[below]] = middle[below] + 1
            end[active[~below]] = middle[~below]
            active = active[at[active] < end[active]]
        inside = np.flatnonzero(at < last)
        same = inside[self._low(at[inside]) == low[inside]]
        place[todo[same]] = at[same]
        return place


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their book: bins of even width, each with its mean, so that no value is off by a bin or more."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    low, width = values.min(), max(float(np.ptp(values)) / CODES, 1e-12)
    codes = np.minimum((values - low) / width, CODES - 1).astype(np.uint8)
    size = np.bincount(codes, minlength=CODES)
    return codes, np.bincount(codes, values, CODES) / np.maximum(size, 1)


class NgramTrie:
    """Contexts, pointers, followers and codes; the arrays lie in one memory-mapped file that goes with the object."""

    def __init__(self, contexts: np.ndarray, sizes: np.ndarray, followers: np.ndarray, follower_logp: np.ndarray, context_logb: np.ndarray):
        """``contexts`` strictly rise; ``sizes`` followers each, strictly rising within a context."""
        pointers = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        owner = np.repeat(np.arange(len(contexts)), sizes)
        last = np.zeros(len(contexts), dtype=np.int64)
        full = sizes > 0
        last[full] = followers[pointers[1:][full] - 1] + 1
        base = np.concatenate([[0], np.cumsum(last)])
        self._codes, self.book = quantise(follower_logp)
        self._context_codes, self.context_book = quantise(context_logb)
        self.contexts = EliasFano.encode(contexts)
        self.pointers = EliasFano.encode(pointers)
        self.followers = EliasFano.encode(followers + base[owner])
        self._map()

    def _map(self) -> None:
        """Writes the levels one after the other and maps them; the file has no name left and ends with the mapping."""
        levels = [("contexts", p) for p in self.contexts.parts] + [("pointers", p) for p in self.pointers.parts] + [("followers", p) for p in self.followers.parts] + [("codes", self._codes), ("codes", self._context_codes)]
        with tempfile.TemporaryFile() as file:
            places = []
            for _, part in levels:
                file.write(b"\0" * (-file.tell() % 8))
                places.append(file.tell())
                file.write(np.ascontiguousarray(part).data)
            file.write(b"\0" * 8)
            file.flush()
            whole = np.memmap(file, dtype=np.uint8, mode="r").view(np.ndarray)
        mapped = [whole[at:at + p.nbytes].view(p.dtype) for (_, p), at in zip(levels, places)]
        for k, name in enumerate(("contexts", "pointers", "followers")):
            old = getattr(self, name)
            setattr(self, name, EliasFano(old.n, old.low_bits, *mapped[4 * k:4 * k + 4]))
        self._codes, self._context_codes = mapped[12], mapped[13]
        self.nbytes = len(whole)

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair: the log probability of a stored follower (NaN if there is none) and the context's log
        backoff weight (0 for an unknown context)."""
        logp, logb = np.full(len(word), np.nan), np.zeros(len(word))
        if not self.contexts.n or not len(word):
            return logp, logb
        asked, back = np.unique(context, return_inverse=True)
        row = self.contexts.find(asked)
        known = row >= 0
        begin, end, base = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        begin[known] = self.pointers.get(row[known]).astype(np.int64)
        end[known] = self.pointers.get(row[known] + 1).astype(np.int64)
        after = known & (begin > 0)
        base[after] = self.followers.get(begin[after] - 1).astype(np.int64) + 1
        at = np.flatnonzero((end > begin)[back])
        place = self.followers.find(base[back][at] + word[at])
        # a word beyond the context's last follower may meet the next context's
        mine = (place >= begin[back][at]) & (place < end[back][at])
        logp[at[mine]] = self.book[self._codes[place[mine]]]
        logb_by = np.zeros(len(asked))
        logb_by[known] = self.context_book[self._context_codes[row[known]]]
        return logp, logb_by[back]
