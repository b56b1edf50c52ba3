"""Whole-batch text work in numpy: words, rolling hashes, window minima.

A batch of texts is one byte buffer with offsets, so no function here loops over characters or words in
Python. Rolling hashes are polynomials modulo 2^64 over randomly mapped units; a range's hash depends on its
content alone. Different contents can be built that share one, so they choose places and buckets, where a
collision costs time only; what decides is compared itself, by a keyed digest, or by a hash whose key is drawn for the run.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers of the two independent polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Random value of each byte.
BYTE = mix(np.arange(1, 257, dtype=U) * U(BASES[0]))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = BASES[which]
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            have = tuple(np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U) for b in (base, inverse))
        _powers[which] = have
    return have[0][:n], have[1][:n]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix hashes of a sequence of unit hashes, for ranged()."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * powers(len(values), which)[0], dtype=U, out=out[1:])
    return out


def ranged(pre: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of the units [start, end), wherever they stand."""
    back = powers(len(pre), which)[1]
    return mix((pre[end] - pre[start]) * back[start] + (end - start).astype(U))


def pieces(units: np.ndarray, gram: int) -> np.ndarray:
    """ranged() of all runs of `gram` units."""
    pre = prefix(units)
    n = len(units) - gram + 1
    out = pre[gram:] - pre[:n]
    out *= powers(len(pre))[1][:n]
    out += U(gram)
    return mix(out)


def text_chunks(column, limit: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about `limit` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes kept."""
    return _LOWER[buf]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words between ASCII white space, and of words of digits, small letters and what is not ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_places(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start bytes, end bytes, first word of each text and their count at the end)."""
    inside = kind[buf]
    edge = np.empty(len(buf) + 1, bool)
    edge[0] = False
    edge[1:] = inside
    cut = offsets[:-1]
    before = edge[:-1].copy()
    before[cut[cut < len(buf)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(buf), bool)
    after[:-1] = inside[1:]
    if len(buf):
        after[-1] = False
        stop = offsets[1:] - 1
        after[stop[stop >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words of more bytes than this go to a digest; shorter ones are told apart by the bytes themselves.
SHORT_WORD = 7
#: Long words whose digests a process keeps.
KEPT_WORDS = 1 << 16
KEY = b"skerry"

_long: dict[bytes, int] = {}


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; no two words of up to SHORT_WORD bytes share one, nor a short and a long one.

    A short word's bytes and size are one number, a longer word is a keyed digest with the upper bit set; a
    bijection spreads both.
    """
    size = ends - starts
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    block = np.ascontiguousarray(eight[starts]).view(U).ravel()
    over = np.clip(8 - size, 1, 7).astype(U) * U(8)
    out = ((block << over) >> over) | (size.astype(U) << U(56))  # little-endian: what is beyond the word's end goes
    long = np.flatnonzero(size > SHORT_WORD)
    if len(long):
        data = buf.tobytes()
        out[long] = np.fromiter((_long_word(data[s:e]) for s, e in zip(starts[long].tolist(), ends[long].tolist())), U, len(long))
    return mix(out)


def _long_word(word: bytes) -> int:
    got = _long.get(word)
    if got is None:
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little") | 1 << 63
        if len(word) <= 64:
            if len(_long) >= KEPT_WORDS:
                _long.clear()
            _long[word] = got
    return got


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words' bytes, each followed by one space, and where each begins and ends there."""
    size = ends - starts
    end = np.cumsum(size + 1)
    begin = end - size - 1
    at = np.repeat(starts - begin, size + 1) + np.arange(end[-1] if len(end) else 0)
    out = np.concatenate([buf, np.zeros(1, np.uint8)])[at]
    out[end - 1] = 0x20
    return out.tobytes(), begin, end - 1


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 64-bit digest of each byte range."""
    view, hash_ = memoryview(data), hashlib.blake2b
    return np.frombuffer(b"".join([hash_(view[s:e], digest_size=8, key=KEY).digest() for s, e in zip(starts.tolist(), ends.tolist())]), np.int64)


def shingle_key(words: int) -> list[int]:
    """A key of shingles(), drawn anew: what collides under it can't be built beforehand."""
    return [secrets.randbits(64) | 1 for _ in range(2 * words + 1)]


def shingles(buf: np.ndarray, offsets: np.ndarray, key: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of a chunk of texts, A-Z lower-cased, and where each text's begin.

    A text of fewer words is one shingle; repeats stay. The hash is multilinear in the halves of the word
    hashes: two sequences share one with a chance of 2^-63, or 2^-33 at worst, over the keys.
    """
    words = (len(key) - 1) // 2
    buf = lower_ascii(buf)
    starts, ends, first = word_places(buf, offsets, NOT_SPACE)
    units = word_hashes(buf, starts, ends)
    size = np.diff(first)
    count = np.where(size, np.maximum(1, size - words + 1), 0)
    at = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    n = np.minimum(words, np.repeat(size, count))
    low, high = (np.concatenate([x, np.zeros(words, U)]) for x in (units & U(0xFFFFFFFF), units >> U(32)))
    out = n.astype(U) * U(key[-1])
    for i in range(words):
        some = (low[begin + i] * U(key[2 * i])) + (high[begin + i] * U(key[2 * i + 1]))
        out += np.where(i < n, some, U(0))
    return mix(out), at


def slices(batch: pa.RecordBatch, column: int, rows: int = 512, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Runs of at most `rows` rows and about `size` bytes of a column of texts; a longer text is a run of its own."""
    texts = batch.column(column)
    if not batch.num_rows:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        end = min(max(at + 1, end), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i + w]) for each full window, by block prefixes and suffixes."""
    n = len(x)
    if n < w:
        return np.empty(0, x.dtype)
    a = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    a[:n] = x
    a = a.reshape(-1, w)
    pre = np.minimum.accumulate(a, axis=1).ravel()
    suf = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suf[: n - w + 1], pre[w - 1 : n])


_PLACE = U((1 << 28) - 1)


def anchors(units: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Winnowed anchors of all windows of `window` units inside one text.

    Each window is assigned the leftmost of its `gram`-unit pieces with the least hash, which its content
    alone decides; windows of the same content thus have the same anchor at the same place. Returns arrays
    (text, anchor hash, first window start in the text, number of windows, the same start in `units`);
    consecutive windows with one anchor are one row.
    """
    none = np.empty(0, np.int64)
    n = len(units)
    if n < window:
        return none, none.astype(U), none, none, none
    grams = pieces(units, gram)
    packed = (grams & ~_PLACE) | np.arange(n - gram + 1, dtype=U)
    least = window_min(packed, window - gram + 1)
    fits = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= window)
    np.add.at(fits, offsets[long], 1)
    np.add.at(fits, offsets[long + 1] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(fits[: len(least)]))
    if not len(starts):
        return none, none.astype(U), none, none, none
    place = (least[starts] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    first = starts[new]
    count = np.diff(np.append(new, len(starts)))
    text = np.searchsorted(offsets, first, side="right") - 1
    return text, grams[place[new]], first - offsets[text], count, first
