"""Numbers, clock times and windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(c: Column) -> Column:
    """A number from text, by a pattern first: suffixes such as ``1d`` are none."""
    return F.when(c.rlike(NUMBER), F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """M-05."""
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def seconds(c: Column) -> Column:
    """M-02: seconds of ``h:m:s``, ``m:s`` or a number of seconds; null if it is none."""
    p = F.split(F.trim(c), ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("int")
    return F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(p) == 2, part(0) * 60 + part(1)).otherwise(F.floor(number(c)).cast("int"))


def clock(s: Column) -> Column:
    """M-02: ``hh:mm:ss``, ``00:00:00`` for null and negative."""
    t = F.when(s >= 0, s).otherwise(0)
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", two(t / 3600), two(t % 3600 / 60), two(t % 60))


def tempo(c: Column) -> Column:
    """M-03: beats per minute between 30 and 300, rounded half to even; null otherwise."""
    n = number(c)
    return F.when(n.between(30, 300), F.bround(n).cast("int"))


def ratio(c: Column) -> Column:
    """M-04: a share from ``0.7``, ``70%`` or a word; null otherwise."""
    t = F.lower(F.trim(c))
    percent = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*%$", 1).try_cast("double") / 100
    word = F.when(t.contains("high"), 0.75).when(t.contains("low"), 0.35).when(t.contains("medium") | t.contains("moderate"), 0.55)
    n = number(t)
    return F.coalesce(percent, F.when(n.between(0, 1), n), F.when(n.between(1, 100), n / 100), word)


def energy_band(share: Column) -> Column:
    """M-04: high from 0.67, medium from 0.40, else low."""
    return F.when(share >= 0.67, "high").when(share >= 0.40, "medium").when(share.isNotNull(), "low")


def isrc(c: Column) -> Column:
    """M-04: the code in a text, upper case without hyphens; empty if none."""
    return F.regexp_extract(F.replace(F.upper(c), F.lit("-"), F.lit("")), r"\b([A-Z]{2}[A-Z0-9]{3}\d{7})\b", 1)


def musical_key(c: Column) -> Column:
    """M-04: note and mode in a text, e.g. ``C# minor``; empty if none."""
    p = r"(?i)\b([A-G](?:#|b|♯|♭)?)\s*(major|minor|maj|min|m)\b"
    note = F.regexp_extract(c, p, 1)
    mode = F.lower(F.regexp_extract(c, p, 2))
    return F.when(note == "", "").otherwise(F.concat(F.upper(F.substring(note, 1, 1)), F.substr(note, F.lit(2)), F.lit(" "), F.when(mode.startswith("maj"), "major").otherwise("minor")))


def windows(duration: Column, n: int, length: int) -> Column:
    """M-06: up to ``n`` distinct (start, length) windows spread over a duration; one from 0 where it is unknown or short."""
    span = F.greatest(F.lit(0), duration - length)
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(span * (i + 1) / (n + 1)).cast("int")))
    starts = F.when(F.coalesce(duration, F.lit(0)) > length, spread).otherwise(F.array(F.lit(0)))
    each = F.when(F.coalesce(duration, F.lit(0)) > 0, F.least(F.lit(length), duration)).otherwise(F.lit(length)).cast("int")
    return F.transform(starts, lambda s: F.struct(s.alias("start"), each.alias("length")))


def segments(duration: Column) -> Column:
    """M-07: 45 s where unknown, all up to 90 s, else 15 s centred at 0.15, 0.5 and 0.85 of it."""
    one = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("length"))
    three = F.array(*[one(F.round(duration * x - 7.5 + 0.0001), F.lit(15)) for x in (0.15, 0.5, 0.85)])
    return F.when(F.coalesce(duration, F.lit(0)) <= 0, F.array(one(F.lit(0), F.lit(45)))).when(duration <= 90, F.array(one(F.lit(0), duration))).otherwise(three)


def blended(base: float, share: float, of: Column, most: float = 1.0) -> Column:
    """M-09: a confidence ``base + share * of``, at most ``most``."""
    return F.least(F.lit(most), F.lit(base) + share * of)


def cosine(a: Column, b: Column) -> Column:
    """M-08: cosine of two number arrays of one length; null if either has length 0 or norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def softmax(scores: Column, scale: float = 100.0) -> Column:
    """M-08: scaled softmax of an array, stable by its maximum."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp((x - top) * scale))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda x: x / total)
