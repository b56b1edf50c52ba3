"""Scalar text functions, all as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal suffixes of organisation names.
LEGAL_SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "lp", "gmbh", "ag", "sa", "nv")


def squeeze(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def strip_space(x: Column) -> Column:
    """Without white space at both ends, newlines included."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def normalize_name(x: Column) -> Column:
    """Lower case, other signs than letters, digits and _ as spaces, spaces squeezed."""
    return squeeze(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "))


def strip_legal_suffix(x: Column) -> Column:
    """Without legal suffixes at the end of a normalised name; a name of suffixes alone stays."""
    bare = F.regexp_replace(x, rf"^(.*?)(?:(?:^| )(?:{'|'.join(LEGAL_SUFFIXES)}))+$", "$1")
    return F.when(bare == "", x).otherwise(bare)


def entity_id(entity_type: Column, name: Column) -> Column:
    """Id from type and normalised name."""
    return F.sha2(F.concat(F.lower(entity_type), F.lit(":"), normalize_name(name)), 256)


def confidence(x: Column) -> Column:
    """A confidence given as number or word, in [0, 1]; null and what can't be read are 1."""
    word = F.lower(F.trim(x))
    named = F.when(word == "high", 0.9).when(word == "medium", 0.6).when(word == "low", 0.3)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(named, x.try_cast("double"), F.lit(1.0))))


def duration_seconds(x: Column) -> Column:
    """Seconds of a duration such as 1h45m7.2s or 577ms; null or unreadable: 0."""

    def part(unit: str, factor: float) -> Column:
        return F.coalesce(F.regexp_extract(x, rf"([0-9.]+){unit}", 1).try_cast("double"), F.lit(0.0)) * F.lit(factor)

    return F.coalesce(part("h(?![a-z])", 3600) + part("m(?!s)", 60) + part("s", 1) + part("ms", 0.001), F.lit(0.0))


def paragraphs(x: Column) -> Column:
    """Stripped, non-empty parts between blank lines."""
    return F.filter(F.transform(F.split(x, r"\n\s*\n"), strip_space), lambda p: p != "")


def fixed_windows(x: Column, size: int = 800, overlap: int = 100) -> Column:
    """Windows of `size` characters that start every size - overlap, up to the one that reaches the end; stripped."""
    stride = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length(x) - size) / F.lit(float(stride)))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: strip_space(F.substring(x, i * stride + 1, F.lit(size))))
    return F.filter(cut, lambda w: w != "")


def pack_paragraphs(x: Column, size: int = 800, overlap: int = 100) -> Column:
    """Chunks of whole paragraphs, packed greedily.

    The length counted is that of the paragraphs without what joins them. A full chunk's last paragraphs of at
    most `overlap` characters in all open the next one, so chunks may pass the limit a little. A paragraph
    over the limit closes the chunk and is cut into fixed windows, with no overlap into what follows.
    """
    text = "array<string>"
    start = F.struct(F.array().cast(text).alias("out"), F.array().cast(text).alias("cur"))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["cur"]) > 0, F.concat(acc["out"], F.array(F.array_join(acc["cur"], "\n\n")))).otherwise(acc["out"])

    def tail(parts: Column) -> Column:
        seed = F.struct(F.array().cast(text).alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def take(a: Column, p: Column) -> Column:
            fits = a["open"] & (a["n"] + F.length(p) <= overlap)
            return F.struct(F.when(fits, F.concat(F.array(p), a["kept"])).otherwise(a["kept"]).alias("kept"), F.when(fits, a["n"] + F.length(p)).otherwise(a["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(F.reverse(parts), seed, take)["kept"]

    def step(acc: Column, p: Column) -> Column:
        large = F.length(p) > size
        full = (F.size(acc["cur"]) > 0) & (total(acc["cur"]) + F.length(p) > size)
        out = F.when(large, F.concat(closed(acc), fixed_windows(p, size, overlap))).when(full, closed(acc)).otherwise(acc["out"])
        cur = F.when(large, F.array().cast(text)).when(full, F.concat(tail(acc["cur"]), F.array(p))).otherwise(F.concat(acc["cur"], F.array(p)))
        return F.struct(out.alias("out"), cur.alias("cur"))

    return F.aggregate(paragraphs(x), start, step, closed)


def markers(x: Column) -> Column:
    """Numbers of citation markers [n], in order."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))


def sentences(x: Column) -> Column:
    """Sentences with their stops and with markers that trail them."""
    return F.transform(F.regexp_extract_all(x, F.lit(r"[^.!?]+[.!?]+(?:\s*\[\d+\])*"), F.lit(0)), strip_space)


def uncited(x: Column, refusal: str = "INSUFFICIENT_EVIDENCE", least: int = 25) -> Column:
    """Sentences of `least` characters or more without a marker that are no refusal."""
    return F.filter(sentences(x), lambda s: (F.length(s) >= least) & ~s.rlike(r"\[\d+\]") & ~s.contains(refusal))


def json_object(x: Column) -> Column:
    """The first balanced {...} of a reply, code fences or not; braces in strings don't count; null if none."""
    seed = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(False).alias("done"))

    def step(a: Column, c: Column) -> Column:
        live = ~a["done"] & ((a["depth"] > 0) | (c == "{"))
        up = live & ~a["quoted"] & (c == "{")
        down = live & ~a["quoted"] & (c == "}")
        depth = a["depth"] + F.when(up, 1).when(down, -1).otherwise(0)
        return F.struct(
            F.when(live, F.concat(a["out"], c)).otherwise(a["out"]).alias("out"),
            depth.alias("depth"),
            F.when(live & (c == '"') & ~a["escaped"], ~a["quoted"]).otherwise(a["quoted"]).alias("quoted"),
            (live & a["quoted"] & (c == "\\") & ~a["escaped"]).alias("escaped"),
            (a["done"] | (down & (depth == 0))).alias("done"),
        )

    return F.aggregate(F.split(x, ""), seed, step, lambda a: F.when(a["done"], a["out"]))


def segments(text: Column) -> Column:
    """An answer as runs of text and markers [n] in turn, nothing left out; a bracket that opens no marker is a run of its own."""
    return F.regexp_extract_all(text, F.lit(r"\[\d+\]|[^\[]+|\["), F.lit(0))


def classifier_confidence(raw: Column) -> Column:
    """A classifier's confidence as a number from 0 to 1; 0.5 where there is none or it is no number."""
    x = raw.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))
