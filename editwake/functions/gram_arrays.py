"""Grams of Arrow arrays of texts: cut, given their places, and hashed.

Used inside tasks by the columns of ``grams``. Numpy takes some characters of a
batch at a time, so beside the result little is held however long a text is.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2**17  # characters, or grams, that are worked on at once
_BASE64 = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_M = np.uint32(0x5BD1E995)  # fixed value: the multiplier of MurmurHash2


class Cut:
    """The grams of low..high characters of each text, by start then length.

    With ``stop`` a text gives the grams up to the first that overruns its end.
    """

    def __init__(self, texts: pa.Array, low: int, high: int, stop: bool = False):
        texts = texts.cast(pa.string())
        self.nulls = texts.is_null()
        _, places, data = texts.buffers()
        rows = np.frombuffer(places, np.int32, len(texts) + 1, texts.offset * 4) if len(texts) else np.zeros(1, np.int32)
        data = np.frombuffer(data or b"", np.uint8)
        self.bytes = data[rows[0] : rows[-1]]
        begins = np.flatnonzero((self.bytes & 0xC0) != 0x80)
        self.first = np.searchsorted(begins, rows - rows[0])  # the first character of each text
        self.begins = np.append(begins, len(self.bytes)).astype(np.int32)
        self.low, self.high, self.stop = low, high, stop
        self.per_char = np.zeros(len(begins), np.int64)

    def pieces(self, texts: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """First byte of grams, the byte behind, number of the first character (``texts``: of the text), size."""
        sizes = np.arange(self.low, self.high + 1)
        for lo in range(0, len(self.per_char), PIECE):
            chars = np.arange(lo, min(lo + PIECE, len(self.per_char)))
            text = np.searchsorted(self.first, chars, "right")
            left, at = self.first[text] - chars, chars - self.first[text - 1]
            there = left[:, None] >= sizes
            if self.stop:
                there &= ((left >= self.high - 1) | (at == 0))[:, None]
            self.per_char[chars] = there.sum(1)
            char, size = np.nonzero(there)
            size += self.low
            yield self.begins[lo + char], self.begins[lo + char + size], (text - 1 if texts else at)[char], size

    def lists(self, grams: pa.Array) -> pa.Array:
        """What was made of each gram, in one list per text; null for null."""
        ends = np.append(0, np.cumsum(self.per_char))[self.first]
        return _lists(ends, grams, self.nulls)


def _lists(ends: np.ndarray, values: pa.Array, nulls: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=nulls)


def _joined(arrays: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(arrays) if arrays else pa.array([], kind)


PLACED = pa.struct([("gram", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def placed(texts: pa.Array, low: int, high: int) -> pa.Array:
    """The grams of each text with their starts and ends in characters."""
    cut, made = Cut(texts, low, high), []
    for begin, end, at, size in cut.pieces():
        ends = np.append(np.int32(0), np.cumsum(end - begin, dtype=np.int32))
        source = np.repeat(begin - ends[:-1], end - begin) + np.arange(ends[-1], dtype=np.int32)
        places = [pa.array(x, pa.int32()) for x in (at, at + size)]
        made.append(pa.StructArray.from_arrays([_strings(ends, cut.bytes[source]), *places], fields=list(PLACED)))
    return cut.lists(_joined(made, PLACED))


def told(lists: pa.Array) -> pa.Array:
    """Each list of grams with their places as one text: gram@start-end, joined by bars."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy()))
    made, lo = [], 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
        part = lists.slice(lo, hi - lo)
        gram, start, end = part.flatten().flatten()
        each = pc.binary_join_element_wise(
            gram, "@", start.cast(pa.string()), "-", end.cast(pa.string()), ""
        )
        made.append(pc.binary_join(_lists(ends[lo : hi + 1] - ends[lo], each, part.is_null()), "|"))
        lo = hi
    return _joined(made, pa.string())


def _mixed(words: np.ndarray) -> np.ndarray:
    k = words * _M
    return (k ^ (k >> np.uint32(24))) * _M


def _murmur2(words: np.ndarray, mixed: np.ndarray, begin: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """MurmurHash2 of parts of bytes; ``words`` has four bytes, the lowest first, from each on."""
    h = np.uint32(seed & 0xFFFFFFFF) ^ size.astype(np.uint32)
    for block in range(int(size.max(initial=0)) // 4):
        there = np.flatnonzero(size >= 4 * block + 4)
        h[there] = (h[there] * _M) ^ mixed[begin[there] + 4 * block]
    over = size % 4
    there = np.flatnonzero(over)
    over = over[there]
    rest = words[(begin + size)[there] - over] & ((np.uint32(1) << (8 * over).astype(np.uint32)) - np.uint32(1))
    h[there] = (h[there] ^ rest) * _M
    h = (h ^ (h >> np.uint32(13))) * _M
    return h ^ (h >> np.uint32(15))


def _int6(h: np.ndarray) -> np.ndarray:
    """The little-endian bytes in Base64, six characters each."""
    b = h.astype("<u4").view(np.uint8).reshape(-1, 4)
    digits = np.empty((len(h), 6), np.uint8)
    digits[:, 0] = b[:, 0] >> 2
    digits[:, 1] = (b[:, 0] & 3) << 4 | b[:, 1] >> 4
    digits[:, 2] = (b[:, 1] & 15) << 2 | b[:, 2] >> 6
    digits[:, 3] = b[:, 2] & 63
    digits[:, 4] = b[:, 3] >> 2
    digits[:, 5] = (b[:, 3] & 3) << 4
    return _BASE64[digits].reshape(-1)


def _tokens(h: np.ndarray) -> pa.Array:
    return _strings(np.arange(0, 6 * len(h) + 1, 6, dtype=np.int32), _int6(h))


def _once(keys: np.ndarray) -> np.ndarray:
    keys.sort()
    return keys[np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))] if len(keys) else keys


def hashed(texts: pa.Array, low: int, high: int, seed: int, once: bool = False) -> pa.Array:
    """The index tokens of the hashable grams of each text, which is trimmed already.

    In gram order; or, with ``once``, each token of a text once, in no order.
    """
    cut, made = Cut(texts, low, high, stop=True), []
    padded = np.append(cut.bytes, np.zeros(4, np.uint8)).astype(np.uint32)
    words = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
    mixed = _mixed(words)
    for begin, end, text, _ in cut.pieces(texts=once):
        h = _murmur2(words, mixed, begin, end - begin, seed)
        made.append(_once(text.astype(np.uint64) << np.uint64(32) | h) if once else _tokens(h))
    if not once:
        return cut.lists(_joined(made, pa.string()))
    keys = _once(np.concatenate([*made, np.zeros(0, np.uint64)]))
    ends = np.searchsorted(keys, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    parts = [_tokens(keys[lo : lo + PIECE].astype(np.uint32)) for lo in range(0, len(keys), PIECE)]
    return _lists(ends, _joined(parts, pa.string()), cut.nulls)
