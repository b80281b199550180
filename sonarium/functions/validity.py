"""Recognisers and issue lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonarium.functions.numbers import number
from sonarium.functions.text import key_value, squeeze

# Placeholders that mean a missing value, how others begin, and values of other fields that are no name of an artist or a language.
PLACEHOLDERS = (
    "", "-", "n/a", "na", "none", "null", "unknown", "unknown language", "unknown year", "unknown bpm", "unknown key", "needs_review", "needs review",
    "not listed in free sources", "not listed",
)
MISSING_STARTS = ("unknown", "not listed", "needs_review", "needs review")
OTHER_FIELDS = (
    "all season", "all weather", "ambient", "blues", "classic rock", "dance", "dance pop", "dance-pop", "electro", "electronic", "electronica", "electropop", "energetic",
    "hard techno", "high", "house", "mainstream", "medium", "medium high", "pop", "popular music", "retail energy", "rock", "rock and roll", "rock roll", "upbeat",
)


def missing(c: Column) -> Column:
    """P-09, R-17: null, blank, a placeholder, or what begins like one."""
    t = F.lower(squeeze(c))
    begins = [F.startswith(t, F.lit(x)) for x in MISSING_STARTS]
    return t.isin(*PLACEHOLDERS) | begins[0] | begins[1] | begins[2] | begins[3]


def is_key(c: Column) -> Column:
    """F-15: a musical key: a note and its mode."""
    return F.lower(squeeze(c)).rlike(r"^[a-g][#b]?\s+(major|minor)$")


def is_url(c: Column) -> Column:
    """F-15: an address."""
    return F.lower(squeeze(c)).rlike(r"^https?://")


def is_date(c: Column) -> Column:
    """F-15: a year, a month or day of it with hyphens, or a date with slashes."""
    return squeeze(c).rlike(r"^(\d{4}(-\d{1,2}(-\d{1,2})?)?|\d{1,2}/\d{1,2}/\d{2,4})$")


def is_number(c: Column) -> Column:
    """F-15: a number; ``nan`` and ``inf`` are some."""
    t = squeeze(c)
    return number(t).isNotNull() | t.rlike(r"(?i)^[+-]?(nan|inf(inity)?)$")


def is_json(c: Column) -> Column:
    """F-15: an object or a list."""
    return F.trim(c).rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull()


def usable_tag(c: Column) -> Column:
    """P-08: no placeholder, date, number, address or musical key."""
    t = F.lower(squeeze(c))
    return ~(t.isin(*PLACEHOLDERS) | t.rlike("^needs[_ ]review") | is_date(c) | is_number(c) | is_url(c) | is_key(c))


def usable_title(c: Column) -> Column:
    """P-09: not missing, no date, number or address; genres (P-09, C-15) are held to the same."""
    return ~(missing(c) | is_date(c) | is_number(c) | is_url(c))


usable_genre = usable_title


def usable_artist(c: Column, own: tuple[str, ...] = ()) -> Column:
    """P-09: not missing, and no value of another field; ``own`` are names of the house that never are an artist, as keys."""
    return ~(missing(c) | key_value(c).isin(*OTHER_FIELDS, *own))


def usable_language(c: Column) -> Column:
    """P-09: not missing, no date, number, address or value of another field."""
    return usable_title(c) & ~key_value(c).isin(*OTHER_FIELDS)


def issues(**rules: Column) -> Column:
    """P-14, P-15, P-22: the names of the rules that hold, in order; empty if none does. A rule that is null does not hold."""
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def points(**rules: tuple[Column, int]) -> Column:
    """T-08: the points of the rules that hold, summed."""
    total = F.lit(0)
    for rule, value in rules.values():
        total = total + F.when(F.coalesce(rule, F.lit(False)), value).otherwise(0)
    return total


def fallback(c: Column, other: Column) -> Column:
    """R-17: the value unless it is missing."""
    return F.when(missing(c), other).otherwise(c)


def first_of(*columns: Column) -> Column:
    """R-01, R-06: the first value that is not blank; empty if none is."""
    return F.coalesce(*[F.nullif(squeeze(c), F.lit("")) for c in columns], F.lit(""))


def distinct_tags(tags: Column, title: Column, artist: Column, genre: Column) -> Column:
    """C-10: tags that are usable, are not the title, artist or genre, one for each key, in order."""
    from sonarium.functions.text import distinct_values

    own = F.array(key_value(title), key_value(artist), key_value(genre))
    return distinct_values(F.filter(tags, lambda t: usable_tag(t) & ~F.array_contains(own, key_value(t))), key_value)


def bucketed(tags: Column, vocabulary: dict[str, str], bucket: str, most: int) -> Column:
    """J-08, C-07, T-11: the tags that ``vocabulary`` (tag -> bucket) puts in a bucket, first ``most`` of them in order."""
    words = [t for t, b in vocabulary.items() if b == bucket]
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(t)), lambda t: t.isin(*words))), 1, most)
