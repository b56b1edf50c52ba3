"""Exact encoding and decoding for merge-type (BPE) SentencePiece models, by backtracking.

The model file is read here, field by field; the library itself is not used. A text becomes symbols by its
characters and pairs of adjacent symbols whose joined string is a piece merge, best score first, leftmost
on a tie. The result is the only sequence of pieces in which each adjacent pair, merged again on its own,
comes out as the same pair. So the encoder takes the longest piece that matches next (Aho-Corasick), checks
it against the piece before it by re-merging the two, tries the next shorter piece when they don't agree,
and steps back when none is left. A bit for each position records that no valid sequence leads on from it,
and no position is tried twice.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Characters, of runs and their ids, in each of the two generations of a worker's word cache.
CACHE_CHARS = 2 << 20
#: A longer run isn't kept.
CACHE_RUN = 64
#: Runs that don't decode to themselves.
CACHE_ODD = 20_000


class WordCache:
    """Ids of runs, joined by commas, in two generations: what isn't asked for while the new one fills is forgotten.

    Only runs that decode to themselves are kept here; `odd` has what the few others decode to.
    """

    def __init__(self) -> None:
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, tuple[str, str]] = {}
        self.size = 0

    def put(self, run: str, ids: str) -> None:
        if len(run) > CACHE_RUN:
            return
        if self.size >= CACHE_CHARS:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[run] = ids
        self.size += len(run) + len(ids)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, i = data[i : i + n], i + n
        elif kind == 5:
            (value,), i = struct.unpack_from("<f", data, i), i + 4
        elif kind == 1:
            (value,), i = struct.unpack_from("<d", data, i), i + 8
        else:
            raise ValueError("not a sentencepiece model")
        yield key >> 3, value


class PieceModel:
    """Pieces, scores and the encoder of one model file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            data = f.read()
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(data):
            if number == 1:
                one = dict(_fields(value))
                self.pieces.append(one.get(1, b"").decode("utf-8"))
                self.scores.append(one.get(2, 0.0))
                self.kinds.append(one.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("the model's type is not BPE")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0) or USER in self.kinds or UNUSED in self.kinds:
            raise ValueError("only models without a character map, white-space removal, suffix spaces, user-defined or unused pieces")
        self.prefix = bool(normalizer.get(3, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.by_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE} if trainer.get(35, 0) else {}
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self._fit: dict[int, bool] = {}
        #: Pieces that the merges can make: the others never occur in an encoding.
        self.automaton = ahocorasick.Automaton()
        made = [(p, i) for p, i in self.ids.items() if self.merge(p) == [p]]
        for p, i in made:
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        known = dict(made)
        self.length = [len(p) for p in self.pieces]
        #: The next shorter piece that each piece begins with, or -1.
        self.shorter = [next((known[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in known), -1) for p in self.pieces]
        #: No piece goes on with a space mark after another character, so words can be encoded one by one.
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _ in made)
        odd = re.escape("".join(sorted({c for p, _ in made for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()})))
        letter = re.compile(rf"[^\W\d_{odd}]")
        #: Spaces with the letters or the other characters after them.
        self.runs = re.compile(rf" *(?:[^\W\d_{odd}]+|(?:[^\w ]|[\d_{odd}])+)| +")
        letters = [[bool(letter.match(c)) for c in p.lstrip(SPACE)] for p, _ in made]
        #: Nor does one hold both letters and other characters.
        self.by_run = self.by_word and self.prefix and all(all(x) or not any(x) for x in letters)
        self.special = {i for i, k in enumerate(self.kinds) if k != NORMAL}
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]

    def merge(self, text: str) -> list[str]:
        """The merges themselves, on a short string: best score first, then leftmost."""
        parts = list(text)
        ids, scores = self.ids, self.scores
        while True:
            best, where = None, -1
            for i in range(len(parts) - 1):
                j = ids.get(parts[i] + parts[i + 1])
                if j is not None and (best is None or scores[j] > best):
                    best, where = scores[j], i
            if where < 0:
                return parts
            parts[where : where + 2] = [parts[where] + parts[where + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces side by side survive the merges."""
        a, b = self.pieces[left], self.pieces[right]
        return self.merge(a + b) == [a, b]

    def encode_run(self, text: str) -> list[int]:
        """Ids of a string in which space marks stand for spaces."""
        n = len(text)
        longest = [-1] * n
        for end, (length, i) in self.automaton.iter(text):
            longest[end - length + 1] = i  # ends grow, so the last match from a start is its longest
        if -1 not in longest:
            return self._backtrack(longest, 0, n)
        out: list[int] = []
        start = 0
        for pos in range(n + 1):  # a character that is no piece parts what stands on its two sides
            if pos == n or longest[pos] < 0:
                if pos > start:
                    out += self._backtrack(longest, start, pos)
                if pos < n:
                    raw = text[pos].encode("utf-8", "surrogatepass")
                    out += [self.by_byte[b] for b in raw] if self.by_byte else [self.unknown]
                start = pos + 1
        return out

    def _backtrack(self, longest: list[int], start: int, end: int) -> list[int]:
        """Ids from start to end, where each character is a piece and no piece reaches over the end."""
        known, shorter, length = self._fit, self.shorter, self.length
        path: list[int] = []
        failed = 0  # bit p: no valid sequence leads on from position start + p
        pos, last, token = start, -1, longest[start]
        while True:
            if token < 0:  # none is left here: mark it and try the piece before, one size shorter
                failed |= 1 << (pos - start)
                token = path.pop()
                pos -= length[token]
                last = path[-1] if path else -1
                token = shorter[token]
                continue
            nxt = pos + length[token]
            if not failed or not failed >> (nxt - start) & 1:
                if last < 0:
                    fits = True
                else:
                    key = last << 20 | token
                    fits = known.get(key)
                    if fits is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        fits = known[key] = self.fits(last, token)
                if fits:
                    path.append(token)
                    if nxt == end:
                        return path
                    pos, last, token = nxt, token, longest[nxt]
                    continue
            token = shorter[token]

    def symbols(self, text: str) -> str:
        """The normalised text: spaces as marks, one in front of a text that isn't empty."""
        if not text:
            return ""
        return (SPACE if self.prefix else "") + text.replace(" ", SPACE)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text (null: as an empty one)."""
        marked = self.symbols(text or "")
        if not marked:
            return []
        if not self.by_word:
            return self.encode_run(marked)
        out: list[int] = []
        parts = marked.split(SPACE)
        if parts[0]:
            out += self.encode_run(parts[0])
        marks = SPACE
        for word in parts[1:-1]:
            if word:
                word = marks + word
                out += self.encode_run(word)
                marks = SPACE
            else:
                marks += SPACE
        if len(parts) > 1:
            out += self.encode_run(marks + parts[-1])
        return out

    def digest(self, text: str | None, cache: WordCache) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text), with what is known of words kept in the cache.

        Neither merges nor the bytes of one character reach over the ends of a run that the pattern finds.
        """
        if not text or not self.by_run or SPACE in text:
            ids = self.encode(text)
            return len(ids), ",".join(map(str, ids)), self.decode(ids)
        runs = self.runs.findall(" " + text)
        got = list(map(cache.new.get, runs))
        odd = False
        if None in got:
            at = -1
            for _ in range(got.count(None)):
                at = got.index(None, at + 1)
                run = runs[at]
                known = cache.new.get(run) or cache.old.get(run)
                if known is None and run in cache.odd:
                    known, runs[at] = cache.odd[run]
                    odd = True
                elif known is None:
                    ids = self.encode_run(run.replace(" ", SPACE))
                    known, back = ",".join(map(str, ids)), self._joined(ids)
                    if back == run:
                        cache.put(run, known)
                    else:
                        odd = True
                        runs[at] = back
                        if len(cache.odd) >= CACHE_ODD:
                            cache.odd.clear()
                        if len(run) <= CACHE_RUN:
                            cache.odd[run] = known, back
                elif run not in cache.new:
                    cache.put(run, known)
                got[at] = known
        digits = ",".join(got)
        return digits.count(",") + 1, digits, "".join(runs)[1:] if odd else text

    def _joined(self, ids: list[int]) -> str:
        """What ids stand for, in the middle of a text."""
        if self.special.isdisjoint(ids):
            plain = self.plain
            return "".join([plain[i] for i in ids])
        return self.decode([-2, *ids])

    def decode(self, ids: list[int]) -> str:
        """Text of ids: byte pieces joined to characters (bad bytes: U+FFFD), no space in front."""
        if self.special.isdisjoint(ids):
            plain = self.plain
            text = "".join([plain[i] for i in ids])
            return text[1:] if self.prefix and text[:1] == " " else text
        out: list[str] = []
        raw = bytearray()
        first = True
        if ids[0] == -2:
            ids, first = ids[1:], False
        for i in [*ids, -1]:
            if i >= 0 and self.kinds[i] == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(_characters(bytes(raw)))
                raw.clear()
                first = False
            if i < 0 or self.kinds[i] == CONTROL:
                continue
            text = " ⁇ " if self.kinds[i] == UNKNOWN else self.plain[i]
            if first and self.prefix and text[:1] == " " and self.kinds[i] == NORMAL:
                text = text[1:]
            first = False
            out.append(text)
        return "".join(out)


def _characters(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that begins no valid character."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode("utf-8"))
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_models: dict[str, PieceModel] = {}
_caches: dict[str, WordCache] = {}


def model(path: str) -> tuple[PieceModel, WordCache]:
    """The model at a path and its word cache, once for each worker."""
    if path not in _models:
        _models[path], _caches[path] = PieceModel(path), WordCache()
    return _models[path], _caches[path]


def encode_texts(docs: DataFrame, path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Encode and decode each whole text.

    Returns doc_id, n_tokens, ids_sha256 and decoded_sha256, with the ids themselves and the decoded text if
    asked for. A null text is an empty one (no ids); repeated rows give repeated rows; a null doc_id is kept;
    an empty table gives no rows; other columns are not read, whatever their names. `path` is that of a
    model file which every executor has.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "") + (", decoded string" if keep_text else "")

    def run(batches):
        m, cache = model(path)
        for batch in batches:
            for part in vec.slices(batch, 1, 256, 1 << 20):
                cols: list[list] = [[], [], [], [], []]
                for text in part.column(1).to_pylist():
                    n, ids, back = m.digest(text, cache)
                    cols[0].append(n)
                    cols[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    cols[2].append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                    if keep_ids:
                        cols[3].append([int(i) for i in ids.split(",")] if ids else [])
                    if keep_text:
                        cols[4].append(back)
                arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays.append(pa.array(cols[3], pa.list_(pa.int32())))
                    names.append("ids")
                if keep_text:
                    arrays.append(pa.array(cols[4], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
