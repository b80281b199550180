"""Completion of reports: ordered rules, kept as data, that derive blank fields from others, and a last value for what is still blank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.session import held

# The fields whose text the rules search, and the rules in their order. A rule fills its field where that is
# blank with the value of its first test that holds: words of which one stands in the searched text (``genre`` means LOOK_IN
# together) or in the mood, an energy, or a tempo at or above (``from``) or at or below (``to``) a number; else with its last value.
LOOK_IN = ("genre", "subgenre", "mood", "moods", "themes", "occasion")
WORD_RULES = {
    "energy": ([("genre", "dance edm house techno trance reggaeton", "high"), ("genre", "ambient classical acoustic ballad calm chill", "low"), ("from", 125, "high"), ("to", 85, "low")], "medium"),
    "mood": ([("genre", "chill ambient calm relax", "calm"), ("genre", "dance edm house party upbeat", "upbeat"), ("genre", "pop", "mainstream")], "balanced"),
    "valence": ([("mood", "happy upbeat party sunny festive positive", "0.78"), ("mood", "sad melancholic dark dramatic", "0.32"), ("energy", "high", "0.68"), ("energy", "low", "0.46")], "0.58"),
    "danceability": ([("genre", "dance house edm techno trance reggaeton", "0.82"), ("energy", "high", "0.70"), ("energy", "low", "0.35")], "0.55"),
    "occasion": ([("energy", "high", "busy store"), ("energy", "low", "calm store")], "retail background"),
    "weather": ([("genre", "latin summer sunny reggaeton", "sunny"), ("genre", "ambient calm melancholic chill", "rainy")], "all weather"),
    "season": ([("genre", "christmas holiday", "christmas"), ("genre", "summer latin", "summer")], "all season"),
    "age_group": ([("genre", "dance|edm|hip hop|pop|reggaeton", "youth/adult")], "general"),
    "instruments": ([("genre", "electronic dance edm house techno", "electronic beat, synthesizer"), ("genre", "acoustic", "acoustic guitar, vocal")], "mixed instrumentation"),
}
# What a measure means that is given in words, the first word that stands in it deciding; others stay.
MEASURES = {
    "valence": [("positive happy bright upbeat", "0.78"), ("negative sad dark melancholic", "0.32"), ("neutral balanced", "0.58")],
    "danceability": [("high danceable club", "0.82"), ("low|non dance|ambient", "0.35"), ("medium moderate", "0.55")],
}
SHARE = r"^(0(\.\d+)?|1(\.0+)?)$"
UNLISTED, EMBEDDED = "not listed in free sources", "embedded or not listed in free sources"
# What a field that is still blank becomes: the first of the named fields that is not, else a text.
LAST = {
    "title": ((), "unknown title"), "artist": ((), "unknown artist"), "album": ((), "single"), "album_artist": (("artist",), "unknown artist"), "year": ((), "unknown year"), "date": (("year",), "unknown date"),
    "genre": ((), "pop"), "subgenre": (("genre",), "popular music"), "mood": ((), "balanced"), "moods": (("mood",), "balanced"), "energy": ((), "medium"), "valence": ((), "0.58"), "danceability": ((), "0.55"),
    "key": ((), "unknown key"), "language": ((), "unknown language"), "instruments": ((), "mixed instrumentation"), "vocals": ((), "vocal"), "themes": ((), "retail background music"),
    "occasion": ((), "retail background"), "weather": ((), "all weather"), "season": ((), "all season"), "age_group": ((), "general"), "track_number": ((), "1"), "disc_number": ((), "1"),
    "composer": (("artist",), "unknown composer"), "publisher": (("label", "album_artist", "artist"), UNLISTED), "copyright": ((), UNLISTED), "bpm": ((), "unknown bpm"), "isrc": ((), UNLISTED),
    "label": (("publisher", "album_artist", "artist"), UNLISTED), "catalog_number": (("isrc",), UNLISTED), "has_cover_art": ((), "no"), "cover_art_url": ((), EMBEDDED), "quality_score": ((), "0.0"),
    "validation_status": ((), "completed_with_inference"), "missing_tags": ((), "none"), "sources": ((), "{}"),
}


def words(listed: str) -> list[str]:
    """The words of a rule: between bars if it has some, else between blanks."""
    return listed.split("|") if "|" in listed else listed.split()


def _any(text: Column, listed: str) -> Column:
    found = F.lit(False)
    for w in words(listed):
        found = found | F.contains(text, F.lit(w))
    return found


def _ruled(field: str) -> Column:
    """The value of a field's rule, from ``_text``, the mood, the energy and the tempo."""
    tests, last = WORD_RULES[field]
    tempo = F.when(F.col("bpm").rlike(r"^\d{1,9}$"), F.col("bpm").try_cast("int"))
    out = None
    for kind, given, value in tests:
        holds = {
            "genre": lambda: _any(F.col("_text"), given), "mood": lambda: _any(F.lower("mood"), given), "energy": lambda: F.lower("energy") == given,
            "from": lambda: F.coalesce(tempo >= given, F.lit(False)), "to": lambda: F.coalesce(tempo <= given, F.lit(False)),
        }[kind]()
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out.otherwise(last)


def _meant(field: str) -> Column:
    """A measure given in words as its number; a number, or words that say nothing, as they are."""
    out = F.when(F.trim(field).rlike(SHARE), F.col(field))
    for listed, value in MEASURES[field]:
        out = out.when((F.col(field) != "") & _any(F.lower(field), listed), value)
    return out.otherwise(F.col(field))


def derived(df: DataFrame, comment: str = "") -> DataFrame:
    """C-01: ``df`` with the blank fields of a report derived from its others, rule by rule, each seeing what earlier ones filled.

    ``df`` holds the tag fields; those that are absent count as blank and are added, null counts as blank, other columns stay.
    What was not derived is empty. ``comment`` is the text of a blank comment.
    """
    fields = [
        "title", "artist", "album", "album_artist", "year", "date", "genre", "subgenre", "mood", "moods", "energy", "valence", "danceability", "language", "instruments", "vocals", "themes", "occasion",
        "weather", "season", "age_group", "track_number", "disc_number", "composer", "publisher", "copyright", "bpm", "isrc", "label", "catalog_number", "cover_art_url", "comment", "analysis_summary",
    ]
    given = [F.coalesce(F.col(f), F.lit("")).alias(f) if f in df.columns else F.lit("").alias(f) for f in fields]
    d = df.select(*[c for c in df.columns if c not in fields], *given)
    fill = lambda f, v: F.when(F.col(f) == "", v).otherwise(F.col(f))
    bare = lambda f: F.trim(f)
    identity = F.concat_ws(" ", *[F.nullif(bare(f), F.lit("")) for f in ("title", "artist", "album", "album_artist")])
    d = held(d, _text=F.lower(F.concat_ws(" ", *LOOK_IN)), _who=identity)
    d = d.withColumns({"album_artist": fill("album_artist", F.col("artist")), "album": F.when(bare("album") == "", F.when(bare("title") != "", bare("title")).otherwise(F.col("album"))).otherwise(F.col("album"))})
    d = d.withColumn("date", fill("date", F.col("year"))).withColumn("year", fill("year", F.substring("date", 1, 4)))
    d = d.withColumn("moods", fill("moods", F.col("mood"))).withColumn("mood", fill("mood", F.trim(F.substring_index("moods", ",", 1))))
    d = d.withColumns({"subgenre": fill("subgenre", F.col("genre")), "track_number": fill("track_number", F.lit("1")), "disc_number": fill("disc_number", F.lit("1"))})
    d = held(d, energy=fill("energy", _ruled("energy")), mood=fill("mood", _ruled("mood")))
    d = d.withColumn("moods", fill("moods", F.col("mood")))
    d = d.withColumns({f: _meant(f) for f in MEASURES})
    d = d.withColumns({f: fill(f, _ruled(f)) for f in ("valence", "danceability", "occasion", "weather", "season", "age_group", "instruments")})
    theme = F.trim(F.concat_ws(" ", F.coalesce(F.nullif("mood", F.lit("")), F.lit("balanced")), F.coalesce(F.nullif("genre", F.lit("")), F.lit("music"))))
    english = F.when(F.col("_who").rlike(r"^[\x00-\x7F]+$"), "English").otherwise("unknown")
    d = d.withColumns({"themes": fill("themes", theme), "vocals": fill("vocals", F.lit("vocal")), "language": fill("language", english)})
    d = d.withColumn("label", fill("label", F.col("publisher"))).withColumn("publisher", fill("publisher", F.col("label")))
    d = held(d, label=fill("label", F.col("album_artist")))
    d = held(d, publisher=fill("publisher", F.col("label")), composer=fill("composer", bare("artist")))
    owner = F.coalesce(*[F.nullif(F.col(f), F.lit("")) for f in ("label", "publisher", "album_artist")], F.nullif(bare("artist"), F.lit("")))
    right = F.coalesce(F.concat_ws(" ", F.lit("(c)"), F.nullif("year", F.lit("")), owner), F.lit(""))
    d = d.withColumns({"copyright": fill("copyright", F.when(owner.isNull(), "").otherwise(right)), "catalog_number": fill("catalog_number", F.col("isrc")), "comment": fill("comment", F.lit(comment))})
    named = F.concat_ws(", ", *[F.when(v != "", F.concat(F.lit(f + "="), v)) for f, v in (("title", bare("title")), ("artist", bare("artist")), ("genre", F.col("genre")), ("mood", F.col("mood")))])
    d = d.withColumn("analysis_summary", fill("analysis_summary", F.concat(F.lit("Final enrichment: "), named)))
    unlisted = F.when(F.col("_who") != "", UNLISTED).otherwise("")
    return d.withColumns({"isrc": fill("isrc", unlisted), "catalog_number": fill("catalog_number", unlisted), "cover_art_url": fill("cover_art_url", F.lit(EMBEDDED))}).drop("_text", "_who")


def without_blanks(df: DataFrame, otherwise: str = UNLISTED) -> DataFrame:
    """C-02: ``df`` with every blank text column filled by LAST, from what the row held before, or by ``otherwise``."""
    texts = [c for c, kind in df.dtypes if kind == "string"]

    def last(c: str) -> Column:
        others, text = LAST.get(c, ((), otherwise))
        return F.coalesce(*[F.nullif(F.col(o), F.lit("")) for o in others if o in df.columns], F.lit(text))

    return df.withColumns({c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", last(c)).otherwise(F.col(c)) for c in texts})
