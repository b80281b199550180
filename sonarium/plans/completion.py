"""Queries on completion and repair, with SQL from the same rules where it can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.operators import completion, repair
from sonarium.session import table

REPORT = "smoke_final_completed"


def _report(spark, sf_dir):
    """The report with placeholders as blanks: what a completion meets."""
    d = table(spark, sf_dir, REPORT)
    return d.select("row_id", *[F.when(F.lower(F.trim(c)).isin("needs_review", "unknown", "n/a", "-"), "").otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in d.columns if c not in ("row_id", "processed_at")])


SHOWN = ["energy", "mood", "moods", "valence", "danceability", "occasion", "themes", "weather", "season", "age_group", "instruments", "label", "publisher", "composer", "copyright", "catalog_number", "isrc"]


def derived_fields(spark, sf_dir):
    """C-01 on every report row."""
    return completion.derived(_report(spark, sf_dir)).select("row_id", *SHOWN)


def no_blank_fields(spark, sf_dir):
    """C-02 on every report row."""
    return completion.without_blanks(_report(spark, sf_dir)).select("row_id", *[f for f in completion.LAST if f not in ("sources", "quality_score")])


def valid_tags(spark, sf_dir):
    """P-21, C-20 and C-08 on every genre."""
    d = table(spark, sf_dir, REPORT)
    g = F.coalesce("genre", F.lit(""))
    return d.select("row_id", repair.valid_tag(g).alias("valid"), repair.mapped_tag(g).alias("tag"), repair.default_mood(g).alias("mood"))


def repaired_tags(spark, sf_dir):
    """J-11, C-12 and P-22: the tags of every report row rebuilt from the best row of its file in the earlier stage, with what is wrong with them."""
    best = repair.best_sources(table(spark, sf_dir, "smoke_final_no_blanks").select("row_id", "filename", "title", "artist", "genre", *repair.FIELDS), "row_id")
    source = best.select("name", F.struct(*repair.FIELDS).alias("source"))
    d = table(spark, sf_dir, REPORT).select("row_id", "filename", "title", "artist", "album", "genre", "label")
    d = repair.rebuilt(d.withColumn("name", F.trim(F.regexp_replace("filename", r"(?U)\s+", " "))).join(source, "name", "left"))
    return d.select("row_id", "tag", F.array_join(repair.tag_issues(F.col("tag"), [F.col(c) for c in ("title", "artist", "album", "label")]), "; ").alias("issues"))


def best_sources(spark, sf_dir):
    """J-11: the best source row of each file name."""
    d = table(spark, sf_dir, "smoke_final_no_blanks").select("row_id", "filename", "title", "artist", "genre", *repair.FIELDS)
    return repair.best_sources(d, "row_id").select("name", "row_id")


QUERIES = {f.__name__: f for f in (derived_fields, no_blank_fields, valid_tags, repaired_tags, best_sources)}


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_BLANKED = ", ".join(f"CASE WHEN lower(trim({c})) IN ('needs_review', 'unknown', 'n/a', '-') THEN '' ELSE coalesce({c}, '') END AS {c}" for c in completion.LAST)


def _any(text: str, listed: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in completion.words(listed)) + ")"


def _ruled(field: str) -> str:
    tests, last = completion.WORD_RULES[field]
    bpm = "CASE WHEN regexp_full_match(bpm, '[0-9]{1,9}') THEN CAST(bpm AS INTEGER) END"
    made = {"genre": lambda g: _any("txt", g), "mood": lambda g: _any("lower(mood)", g), "energy": lambda g: f"lower(energy) = {_q(g)}", "from": lambda g: f"({bpm}) >= {g}", "to": lambda g: f"({bpm}) <= {g}"}
    return "CASE " + " ".join(f"WHEN {made[kind](given)} THEN {_q(value)}" for kind, given, value in tests) + f" ELSE {_q(last)} END"


def _filled(field: str, value: str) -> str:
    return f"CASE WHEN {field} = '' THEN {value} ELSE {field} END AS {field}"


def _derived_sql() -> str:
    def meant(f):
        return f"CASE WHEN regexp_matches(trim({f}), '{completion.SHARE}') THEN {f} " + " ".join(f"WHEN {f} <> '' AND {_any(f'lower({f})', listed)} THEN '{v}'" for listed, v in completion.MEASURES[f]) + f" ELSE {f} END AS {f}"

    who = "concat_ws(' ', nullif(trim(title), ''), nullif(trim(artist), ''), nullif(trim(album), ''), nullif(trim(album_artist), ''))"
    owner = "coalesce(nullif(label, ''), nullif(publisher, ''), nullif(album_artist, ''), nullif(trim(artist), ''))"
    steps = [
        f"SELECT *, lower(concat_ws(' ', {', '.join(completion.LOOK_IN)})) AS txt, {who} AS who FROM s0",
        f"SELECT * REPLACE ({_filled('album_artist', 'artist')}, {_filled('date', 'year')}, {_filled('moods', 'mood')}, {_filled('subgenre', 'genre')}) FROM s1",
        f"SELECT * REPLACE ({_filled('year', 'substr(date, 1, 4)')}, {_filled('mood', chr(39).join(['trim(split_part(moods, ', ',', ', 1))']))}) FROM s2",
        f"SELECT * REPLACE ({', '.join(_filled(f, _ruled(f)) for f in ('energy', 'mood'))}) FROM s3",
        f"SELECT * REPLACE ({_filled('moods', 'mood')}, {meant('valence')}, {meant('danceability')}) FROM s4",
        f"SELECT * REPLACE ({', '.join(_filled(f, _ruled(f)) for f in ('valence', 'danceability', 'occasion', 'weather', 'season', 'age_group', 'instruments'))}, "
        + _filled("themes", "trim(coalesce(nullif(mood, ''), 'balanced') || ' ' || coalesce(nullif(genre, ''), 'music'))") + f", {_filled('label', 'publisher')}) FROM s5",
        f"SELECT * REPLACE ({_filled('publisher', 'label')}) FROM s6",
        f"SELECT * REPLACE ({_filled('label', 'album_artist')}, {_filled('composer', 'trim(artist)')}) FROM s7",
        f"SELECT * REPLACE ({_filled('publisher', 'label')}) FROM s8",
        f"SELECT * REPLACE ({_filled('copyright', f"CASE WHEN {owner} IS NULL THEN '' ELSE concat_ws(' ', '(c)', nullif(year, ''), {owner}) END")}, {_filled('catalog_number', 'isrc')}) FROM s9",
        f"SELECT * REPLACE ({_filled('isrc', f"CASE WHEN who <> '' THEN '{completion.UNLISTED}' ELSE '' END")}, {_filled('catalog_number', f"CASE WHEN who <> '' THEN '{completion.UNLISTED}' ELSE '' END")}) FROM s10",
    ]
    ctes = [f"s0 AS (SELECT row_id, {_BLANKED} FROM {REPORT})"] + [f"s{i} AS ({q})" for i, q in enumerate(steps, 1)]
    return "WITH " + ",\n".join(ctes) + f"\nSELECT row_id, {', '.join(SHOWN)} FROM s{len(steps)}"


def _last_sql() -> str:
    def last(c):
        others, text = completion.LAST[c]
        return f"CASE WHEN trim({c}) = '' THEN coalesce({''.join(f'nullif({o}, {chr(39) * 2}), ' for o in others)}{_q(text)}) ELSE {c} END AS {c}"

    return f"WITH s AS (SELECT row_id, {_BLANKED} FROM {REPORT}) SELECT row_id, {', '.join(last(c) for c in completion.LAST if c not in ('sources', 'quality_score'))} FROM s"


_KEY = "trim(regexp_replace(replace(replace(lower(replace(g, 'İ', 'i' || chr(775))), 'ß', 'ss'), '&', 'and'), '[^a-z0-9/]+', ' ', 'g'))"
_TITLE = "array_to_string(list_transform(string_split(g, ' '), lambda w: CASE WHEN lower(w) IN ('dj', 'edm', 'r&b', 'uk', 'us', 'usa') THEN upper(w) ELSE upper(substr(w, 1, 1)) || substr(w, 2) END), ' ')"
_MEANT = "MAP {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in repair.MEANT.items()) + "}"
SQL = {
    "derived_fields": _derived_sql(),
    "no_blank_fields": _last_sql(),
    "valid_tags": rf"""WITH v AS (SELECT row_id, trim(regexp_replace(coalesce(genre, ''), '[\s\x{{a0}}\x{{85}}]+', ' ', 'g')) AS g FROM {REPORT}), k AS (SELECT *, {_KEY} AS k FROM v)
        SELECT row_id, NOT (k IN {str(repair.PLACEHOLDERS + repair.NO_TAGS)} OR regexp_matches(g, '^(\d{{4}}(-\d{{1,2}}(-\d{{1,2}})?)?|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})$') OR regexp_matches(lower(g), '^[+-]?((\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)$')
          OR regexp_matches(lower(g), '^[a-g][#b]?\s+(major|minor)$') OR regexp_matches(lower(g), '^(https?://|\{{|\[\{{)') OR regexp_matches(g, '(?i)\(?c\)?\s*\d{{4}}') OR regexp_matches(k, '^[a-z]{{1,2}}\d+[a-z0-9, -]*$')) AS valid,
        coalesce({_MEANT}[k], {_TITLE}) AS tag, CASE {' '.join(f"WHEN k IN {str(g)} THEN '{m}'" for g, m in repair.MOOD_OF)} ELSE 'Balanced' END AS mood FROM k""",
}
