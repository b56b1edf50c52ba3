"""Fill-in-the-middle: each text is cut at two seeded token boundaries and its parts are put in another order.

Boundaries are found once for each distinct text. Texts that stand once are indexed where they lie; those whose
64-bit hash stands more than once are grouped by the text itself, one row each is indexed, and the index is
joined back on hash and text, so that copies are proven by their content. A boundary list is an Elias-Fano code:
about 2 + log2(code points / tokens) bits a token, and any boundary is read without decoding the others.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import repeats, vec
from .rest import packed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_HEAD = struct.Struct("<BII")


def elias_fano(values: np.ndarray) -> bytes:
    """Code of a non-decreasing list of whole numbers: head, lower bits of each, upper parts in unary."""
    n, most = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (most // n).bit_length() - 1) if n else 0
    values = values.astype(np.int64)
    lower = np.packbits((values[:, None] >> np.arange(low)) & 1 != 0, bitorder="little") if low else np.empty(0, np.uint8)
    upper = np.zeros((most >> low) + n, bool)
    upper[(values >> low) + np.arange(n)] = True
    return _HEAD.pack(low, n, len(lower)) + lower.tobytes() + np.packbits(upper, bitorder="little").tobytes()


def count(code: bytes) -> int:
    """How many numbers a code holds."""
    return _HEAD.unpack_from(code)[1]


def select(code: bytes, i: int) -> int:
    """The i-th number, from 0."""
    low, n, size = _HEAD.unpack_from(code)
    if not 0 <= i < n:
        raise IndexError(i)
    upper = np.frombuffer(code, np.uint8, offset=_HEAD.size + size)
    sums = np.cumsum(np.bitwise_count(upper), dtype=np.int64)
    byte = int(np.searchsorted(sums, i + 1))
    rank = i - (int(sums[byte - 1]) if byte else 0)
    bit = int(np.flatnonzero(np.unpackbits(upper[byte : byte + 1], bitorder="little"))[rank])
    value = (8 * byte + bit - i) << low
    if low:
        lower = int.from_bytes(code[_HEAD.size + (i * low) // 8 : _HEAD.size + ((i + 1) * low + 7) // 8], "little")
        value |= (lower >> ((i * low) % 8)) & ((1 << low) - 1)
    return value


def boundary_codes(column) -> list[bytes]:
    """Code of each text's token ends, in code points.

    A token is white space and the word after it; white space at the end is one more.
    """
    out = []
    for _, buf, offsets in vec.text_chunks(column):
        _, ends, first = vec.word_places(buf, offsets, vec.NOT_SPACE)
        points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        for i in range(len(offsets) - 1):
            at = ends[first[i] : first[i + 1]]
            if offsets[i + 1] > (at[-1] if len(at) else offsets[i]):
                at = np.append(at, offsets[i + 1])
            out.append(elias_fano(points[at] - points[offsets[i]]))
    return out


def cut_of(doc_id: int | None, seed: int, text: str, code: bytes, rate: int, spm: int) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a document, in code points."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", 0, 0
    n = count(code)
    a, b = (select(code, k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    return ("spm" if h4 % 100 < spm else "psm"), a, b


def arrange(text: str, form: str, a: int, b: int) -> str:
    """The text with its parts [0, a), [a, b) and [b, end) in the order of the form."""
    if form == "plain":
        return text
    first, second = (PREFIX + text[:a], SUFFIX + text[b:]) if form == "psm" else (SUFFIX + text[b:], PREFIX + text[:a])
    return first + second + MIDDLE + text[a:b]


def restore(output: str, form: str) -> str:
    """The text that arrange() was given; in a text that is cut no mark stands, so each mark is found where it was put."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    one, rest = output[len(PREFIX) :].split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def with_boundaries(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), rest and `code` (null where the text stands once; it is coded where it lies)."""
    base = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), packed(docs))
    twice = base.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    bits = repeats.key_bits(twice)
    shared = repeats.picked(base, bits, True, of=0)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(boundary_codes(part.column(1)), pa.binary())], ["key", "text", "code"])

    distinct = shared.select("key", "text").distinct()  # copies in one task are one row before they are dealt
    index = distinct.mapInArrow(run, "key long, text string, code binary")
    joined = shared.join(index, ["key", "text"]).select("doc_id", "text", "rest", "code")
    alone = repeats.picked(base, bits, False, of=0).select("doc_id", "text", "rest", F.lit(None).cast("binary").alias("code"))
    return joined.unionByName(alone)


def transform(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80, keep_text: bool = False) -> DataFrame:
    """Each document as plain text, or as prefix, suffix and middle (psm, spm) cut at seeded token boundaries.

    `rate` percent of documents are cut, and `spm` percent of those have the suffix first. Returns doc_id, n
    (tokens), form, prefix_chars and middle_chars (code points; null if plain), the digests of the output and of the text
    rebuilt from it, and, if asked for, the output and the other columns as `rest`. A null text is empty, with no token and
    plain; an empty text, too; a text that holds a mark stays plain; a null doc_id draws as an empty one; rows that repeat get
    the same cut; an empty table gives no rows; very long texts are coded and cut whole.
    """
    rows = with_boundaries(docs)

    def run(batches):
        for batch in batches:
            for part in vec.slices(batch, 1):
                codes = part.column(3).to_pylist()
                alone = [i for i, c in enumerate(codes) if c is None]
                for i, c in zip(alone, boundary_codes(part.column(1).take(pa.array(alone, pa.int64())))):
                    codes[i] = c
                cols: list[list] = [[], [], [], [], [], [], []]
                for doc_id, text, code in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), codes):
                    form, a, b = cut_of(doc_id, seed, text, code, rate, spm)
                    output, cut = arrange(text, form, a, b), form != "plain"
                    digests = (hashlib.sha256(x.encode()).hexdigest() for x in (output, restore(output, form)))
                    for col, x in zip(cols, (count(code), form, a if cut else None, b - a if cut else None, *digests, output if keep_text else None)):
                        col.append(x)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                arrays = [part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds)), part.column(2)]
                some = 9 if keep_text else 7
                yield pa.RecordBatch.from_arrays(arrays[:some], _NAMES[:some])

    schema = StructType().add("doc_id", "long").add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output_sha256", "string").add("restored_sha256", "string")
    if keep_text:
        schema = schema.add("output", "string").add(rows.schema["rest"])
    return rows.mapInArrow(run, schema)


_NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output", "rest"]

#: The digests of transform() in SQL.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, sha256('42:' || coalesce(CAST(doc_id AS varchar), '')) AS h FROM documents),
u AS (SELECT doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
        CAST('0x' || substr(h, 1, 8) AS bigint) AS h1, CAST('0x' || substr(h, 9, 8) AS bigint) AS h2,
        CAST('0x' || substr(h, 17, 8) AS bigint) AS h3, CAST('0x' || substr(h, 25, 8) AS bigint) AS h4 FROM t),
k AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
        CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, x, n, form, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(x) AS restored_sha256 FROM p
"""
