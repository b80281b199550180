"""Repair of tags: valid values, one vocabulary, the best source row of each file, tags rebuilt from it and verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.text import UPPER_WORDS, distinct_values, key_repair, split_values, squeeze
from sonarium.functions.validity import is_date, is_key, is_number, issues
from sonarium.session import held

# Placeholders, texts that are no tags, the genres that others mean, tags that are genres, and the others that are allowed.
PLACEHOLDERS = ("", "-", "n/a", "na", "none", "null", "unknown", "unknown language", "unknown year", "unknown bpm", "needs_review", "needs review", "not listed", "not listed in free sources")
NO_TAGS = ("field confidence json", "field sources json", "mixed instrumentation", "embedded or not listed in free sources")
MEANT = {
    "adult contemporary": "Pop", "classic rock": "Rock", "contemporary r and b": "R&B", "dance pop": "Dance-pop", "dance-pop": "Dance-pop", "electro": "Electronic", "electronica": "Electronic",
    "electropop": "Electronic", "german dance": "Dance", "hip hop": "Hip-Hop", "hip-hop": "Hip-Hop", "house/edm": "EDM", "k pop": "K-Pop", "k-pop": "K-Pop",
    "pop folk world and country stage and screen": "Pop", "pop rap": "Pop Rap", "pop rock": "Pop Rock", "popular music": "Pop", "r and b": "R&B", "rock and roll": "Rock", "synth pop": "Synth-pop",
    "synth-pop": "Synth-pop", "top 40": "Pop", "urban": "Hip-Hop", "all weather": "All Weather", "all season": "All Season", "youth/adult": "Youth/adult",
}
GENRES = (
    "adult contemporary", "blues", "contemporary r and b", "country", "dance", "dance pop", "dance-pop", "disco", "edm", "electro", "electronic", "electronica", "electropop", "folk", "funk", "hard techno",
    "hip hop", "hip-hop", "house", "k pop", "k-pop", "pop", "pop rap", "pop rock", "progressive house", "r and b", "r&b", "rock", "rock and roll", "soul", "synth pop", "synth-pop", "techno",
)
ALLOWED = ("all season", "all weather", "balanced", "calm", "energetic", "mainstream", "rainy", "retail energy", "upbeat", "youth/adult")
MOODS = ("balanced", "calm", "energetic", "mainstream", "upbeat")
MOOD_OF = [(("dance", "edm", "electronic", "house", "techno", "hard techno", "k pop"), "Upbeat"), (("rock", "hip hop", "hip-hop"), "Energetic"), (("pop", "r and b", "r&b", "soul"), "Mainstream")]
SUFFIXES = r"(?i)\.(mp3|mp4|m4a|aac|flac|wav|wma|ogg)$"
FIELDS = ("subgenre", "mood", "moods", "weather", "season", "age_group")


def _odd(c: Column) -> Column:
    """An address, JSON or a note of copyright."""
    t = squeeze(c)
    return F.lower(t).rlike(r"^(https?://|\{|\[\{)") | t.rlike(r"(?i)\(?c\)?\s*\d{4}")


def valid_tag(c: Column) -> Column:
    """P-21: a value that can be a tag: no placeholder, date, number, musical key, address, JSON, copyright or code."""
    k = key_repair(c)
    return ~((k == "") | k.isin(*PLACEHOLDERS, *NO_TAGS) | is_date(c) | is_number(c) | is_key(c) | _odd(c) | k.rlike(r"^[a-z]{1,2}\d+[a-z0-9, -]*$"))


def valid_identity(c: Column, numeric: Column | None = None) -> Column:
    """P-21: a value that can name a title or an artist; a number only where ``numeric`` allows it."""
    number = is_number(c) & ~numeric if numeric is not None else is_number(c)
    return ~((squeeze(c) == "") | key_repair(c).isin(*PLACEHOLDERS) | is_date(c) | number | _odd(c))


def mapped_tag(c: Column) -> Column:
    """C-20: a tag as the vocabulary writes it (MEANT), else with capitals."""
    known = F.try_element_at(F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in MEANT.items()) + ")"), key_repair(c))
    upper = [w for w in UPPER_WORDS if w not in ("ai", "rnb")]
    word = lambda w: F.when(F.lower(w).isin(*upper), F.upper(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.coalesce(known, F.array_join(F.transform(F.split(squeeze(c), " "), word), " "))


def mapped_genre(c: Column) -> Column:
    """C-20: the first part of a genre that says something, mapped."""
    parts = F.when(F.contains(c, F.lit(",")), split_values(c)).otherwise(F.array(squeeze(c)))
    return F.coalesce(F.get(F.filter(F.transform(parts, mapped_tag), lambda x: x != ""), F.lit(0)), F.lit(""))


def default_mood(genre: Column) -> Column:
    """C-08: the mood that stands for a genre."""
    k = key_repair(genre)
    out = F.lit("Balanced")
    for genres, mood in reversed(MOOD_OF):
        out = F.when(k.isin(*genres), mood).otherwise(out)
    return out


def named_pair(filename: Column) -> Column:
    """``(artist, title)`` of a file name, without its suffix and a note on its quality at the end."""
    stem = F.regexp_replace(F.substring_index(F.replace(squeeze(filename), F.lit("\\"), F.lit("/")), "/", -1), SUFFIXES, "")
    stem = F.regexp_replace(stem, r"(?i)\s*\((?:1080|720|clean|single)\)\s*$", "")
    p = r"^(.*?)\s+[-–—]\s+(.*)$"
    return F.when(stem.rlike(p), F.struct(squeeze(F.regexp_extract(stem, p, 1)).alias("artist"), squeeze(F.regexp_extract(stem, p, 2)).alias("title"))).otherwise(F.struct(F.lit("").alias("artist"), stem.alias("title")))


def source_points(df: DataFrame, out: str) -> DataFrame:
    """J-11, first half: ``df`` with what each source row is worth: its identity, its genre, its tags, and an artist that the file name has too."""
    d = held(df, _p=named_pair(F.coalesce("filename", F.lit(""))), _t=F.coalesce("title", F.lit("")), _a=F.coalesce("artist", F.lit("")), _g=F.coalesce("genre", F.lit("")))
    title = valid_identity(F.col("_t"), key_repair(F.col("_t")) == key_repair(F.col("_p.title")))
    artist = valid_identity(F.col("_a")) & (key_repair(F.col("_a")) != key_repair(mapped_genre(F.col("_g"))))
    tags = sum((F.when(valid_tag(F.coalesce(c, F.lit(""))), 5).otherwise(0) for c in FIELDS), F.lit(0))
    named = (F.col("_p.artist") != "") & (key_repair(F.col("_a")) == key_repair(F.col("_p.artist")))
    worth = F.when(title, 30).otherwise(-50) + F.when(artist, 30).otherwise(-50) + F.when(valid_tag(F.col("_g")), 10).otherwise(-10) + tags + F.when(named, 10).otherwise(0)
    return d.withColumn(out, worth).drop("_p", "_t", "_a", "_g")


def best_sources(sources: DataFrame, order: str) -> DataFrame:
    """J-11: for each file name the source row that is worth most, the first by ``order`` on ties: a choice in a partial aggregate."""
    d = source_points(sources, "_points").withColumn("_name", squeeze(F.col("filename")))
    best = d.groupBy("_name").agg(F.max_by(F.struct(*sources.columns), F.struct("_points", -F.col(order))).alias("b"))
    return best.select(F.col("_name").alias("name"), *[F.col(f"b.{c}").alias(c) for c in sources.columns if c != "name"])


def rebuilt(df: DataFrame, out: str = "tag") -> DataFrame:
    """C-12: ``df`` with its tags rebuilt from the source row in the struct column ``source`` (null: nothing).

    Subgenres, the genre if none of them is one, moods, the genre's mood if none is known, weather, season and audience with
    their defaults; only words of the vocabulary, none that the core fields have, each once.
    """
    said = lambda f: split_values(F.coalesce(F.col(f"source.{f}"), F.lit("")))
    core = F.filter(F.transform(F.array(*[F.coalesce(c, F.lit("")) for c in ("title", "artist", "album", "genre", "label")]), key_repair), lambda x: x != "")
    d = held(df, _core=core)
    taken = lambda values: F.filter(F.transform(F.filter(values, valid_tag), mapped_tag), lambda t: key_repair(t).isin(*GENRES, *ALLOWED) & ~F.array_contains("_core", key_repair(t)))
    one = lambda c: F.array(c)
    d = held(d, _sub=taken(said("subgenre")), _mood=taken(F.concat(said("mood"), said("moods"))), _genre=taken(one(F.coalesce("genre", F.lit("")))))
    none = F.array().cast("array<string>")
    is_genre = F.exists("_sub", lambda t: key_repair(t).isin(*GENRES))
    d = held(d, _first=F.concat("_sub", F.when(is_genre, none).otherwise(F.col("_genre")), "_mood"))
    moody = F.exists("_first", lambda t: key_repair(t).isin(*MOODS))
    d = held(d, _rest=F.concat(
        F.when(moody, none).otherwise(taken(one(default_mood(F.coalesce("genre", F.lit("")))))), taken(F.concat(said("weather"), one(F.lit("All Weather")))),
        taken(F.concat(said("season"), one(F.lit("All Season")))), taken(F.concat(said("age_group"), one(F.lit("Youth/adult")))),
    ))
    return held(d, **{out: F.array_join(distinct_values(F.concat("_first", "_rest"), key_repair), ",")}).drop("_core", "_sub", "_mood", "_genre", "_first", "_rest")


def tag_issues(tag: Column, core: list[Column]) -> Column:
    """P-22: what is wrong with rebuilt tags: none, repeated ones, invalid ones, ones that a core field has."""
    values = split_values(tag)
    keys = F.transform(values, key_repair)
    blocked = F.filter(F.transform(F.array(*[F.coalesce(c, F.lit("")) for c in core]), key_repair), lambda x: x != "")
    return F.concat(
        issues(**{"blank tag": F.size(values) == 0, "duplicate tag": F.size(F.array_distinct(keys)) < F.size(keys)}),
        F.flatten(F.transform(values, lambda v: F.filter(F.array(F.when(~valid_tag(v), F.concat(F.lit("bad tag value: "), v)), F.when(F.array_contains(blocked, key_repair(v)), F.concat(F.lit("tag duplicates core field: "), v))), lambda x: x.isNotNull()))),
    )
