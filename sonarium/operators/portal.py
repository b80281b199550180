"""Portal rows: what a report row, its file and its providers say, resolved to one title, artist, genre, language and set of measured values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.numbers import clock, number, seconds, tempo
from sonarium.functions.text import clean_title, clean_value, flag, has_lyrics, key_title, key_value, lyrics_marked, path_parts, split_dashes, split_values, squeeze, title_case
from sonarium.functions.validity import distinct_tags, first_of, missing, usable_artist, usable_genre, usable_language, usable_title
from sonarium.operators.catalog import lookup
from sonarium.session import held, small, stored

# The columns that tags come from, in order; the columns in which providers name an artist, best first, and those
# that hold JSON of them; the fields that name an artist there; and how far each provider is trusted.
TAG_SOURCES = ("subgenre", "mood", "moods", "weather", "season", "age_group")
ARTIST_COLUMNS = (
    "verified_artist", "provider_artist", "ai_artist", "musicbrainz_artist", "spotify_artist", "itunes_artist", "deezer_artist", "lastfm_artist", "discogs_artist",
    "acoustid_artist", "web_artist", "artist_name", "artists", "track_artist", "primary_artist",
)
JSON_COLUMNS = ("merged_json", "providers_json", "provider_results_json", "provider_results", "metadata_json", "analysis_json")
ARTIST_FIELDS = ("artist", "artists", "artist_name", "track_artist", "primary_artist")
TRUST = {
    "spotify": 1.00, "itunes": 0.95, "deezer": 0.90, "lastfm": 0.85, "musicbrainz": 0.80, "acoustid": 0.78, "discogs": 0.75, "web_discovery": 0.70, "sonoteller": 0.65,
    "local_ai": 0.60, "local_cleanup": 0.20,
}
# Folders that name no genre, the names of months, and names of languages by code.
NO_GENRE = ("input media", "media", "mp3", "mp4", "normalized")
MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december"
LANGUAGES = {
    "da": "Danish", "de": "German", "en": "English", "es": "Spanish", "fi": "Finnish", "fr": "French", "is": "Icelandic", "it": "Italian", "nl": "Dutch", "no": "Norwegian",
    "pl": "Polish", "pt": "Portuguese", "sv": "Swedish", "tr": "Turkish",
}
# Words that tell three languages apart.
MARKERS = {
    "Danish": "arbejdsplads behøver dæmoner dig græder hvad jer kærlighed køre kvinde ligesom mænd mig nogen noget sådan smukkest stadig tænker uden",
    "Norwegian": "arbeidsplass deg dere fortsatt gråter hva kjærlighet kjøre kvinne liksom meg menn noe noen sånn tenker uten våre",
    "Swedish": "aldrig att dig eftersom från inte jag kvinna men mig någon något och ska tänker utan",
}
#: Longest name that is taken for an artist's.
LONGEST = 140


def _flattened(value) -> str:
    """R-16: a text of a nested value: of a list its parts, of an object the first of its names."""
    if isinstance(value, dict):
        return next(filter(None, (_flattened(value[k]) for k in ("name", "artist", "artist_name", "title") if k in value)), "")
    if isinstance(value, list):
        return ", ".join(filter(None, map(_flattened, value)))
    return " ".join(str(value).split()) if isinstance(value, (str, int, float)) else ""


def _share(value) -> float:
    try:
        return float(value)
    except (TypeError, ValueError):
        return 0.0


def artists_in(payload: str | None) -> list[tuple[float, str]]:
    """H-06: ``(score, name)`` of the artists a provider payload names, in order of appearance; none for what is no JSON.

    Lists are read element by element, and what an object keeps as ``merged`` like the object, half a point higher. A name
    among an object's ``fields`` scores 5 with the trust in its provider and its confidence, one beside them 3. An object
    without a provider of its own has that of the object around it; unknown ones are trusted by half.
    """
    try:
        waiting = [(json.loads(payload or ""), 0.0, "")]
    except ValueError:
        return []
    found = []
    while waiting:
        node, bonus, outer = waiting.pop()
        if isinstance(node, list):
            waiting += [(x, bonus, outer) for x in reversed(node)]
        if not isinstance(node, dict):
            continue
        provider = str(node.get("provider") or outer).strip().lower()
        sure, trust = _share(node.get("confidence")), TRUST.get(provider, 0.5)
        fields, confidence = node.get("fields"), node.get("field_confidence")
        if isinstance(fields, dict):
            own = _share(confidence.get("artist", sure)) if isinstance(confidence, dict) else sure
            found += [(5 + trust + own, _flattened(fields[f])) for f in ARTIST_FIELDS if f in fields]
        found += [(bonus + 3 + trust + sure, _flattened(node[f])) for f in ARTIST_FIELDS if f in node]
        if isinstance(node.get("merged"), dict):
            waiting.append((node["merged"], bonus + 0.5, provider))
    return [(score, name) for score, name in found if name]


NAMED = "array<struct<score:double,name:string>>"


def _artists_in(payloads: pd.Series) -> pd.Series:
    return payloads.map(lambda p: [] if p is None else [{"score": s, "name": n} for s, n in artists_in(p)])


def _given(df: DataFrame, *names: str) -> Column:
    """R-01: the first of the named columns that the table has and that is not blank, cleaned."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return clean_value(first_of(*found)) if found else F.lit("")


def best_provider_artist(columns: Column, payloads: Column, title: Column, named_title: Column) -> Column:
    """C-14, first step: the artist that providers name with the highest score, the first on ties; empty if none is usable.

    ``columns`` is an array of names, ``payloads`` one of what artists_in gives. A column of a provider scores 4 less a hundredth for each one before it; names in payloads score as artists_in says. A
    name that holds the title, as ``artist - title``, is cut; the title itself, placeholders and very long texts are none.
    """
    listed = F.concat(F.filter(F.transform(columns, lambda c, i: F.struct((F.lit(4.0) - i / 100).alias("score"), c.alias("name"))), lambda x: x["name"] != ""), payloads)
    titles = F.array(key_title(title), key_title(named_title))

    def one(x: Column, i: Column) -> Column:
        name = F.regexp_replace(squeeze(x["name"]), r"^[ \-_|'\"]+|[ \-_|'\"]+$", "")
        pair = split_dashes(name)
        cut = F.when((pair["artist"] != "") & F.array_contains(titles, key_title(pair["title"])), pair["artist"]).otherwise(name)
        return F.struct(x["score"].alias("score"), (-i).alias("order"), cut.alias("name"))

    usable = lambda x: usable_artist(x["name"]) & (key_value(x["name"]) != "") & ~F.array_contains(titles, key_value(x["name"])) & (F.length(x["name"]) <= LONGEST)
    best = F.array_max(F.filter(F.transform(listed, one), usable))
    return F.coalesce(best["name"], F.lit(""))


def with_names(df: DataFrame, own_names: tuple[str, ...] = ()) -> DataFrame:
    """C-13 and C-14: ``df`` with ``_title`` and ``_artist``.

    ``df`` holds, cleaned, ``filename``, ``file_path``, ``title`` and ``artist``, what providers name (``_columns`` and
    ``_payloads``) and what the file itself does (``_own_title``, ``_own_artist``). A title is taken without the artist in
    front and without notes; the file name's if the two agree, if that is a lyrics version or if there is no usable one; else the
    file's own. An artist gives way, if it is unusable or the file name's title agrees, to the best provider's, the file's own, the
    file name's, in that order.
    """
    named = F.coalesce(F.nullif("filename", F.lit("")), F.substring_index(F.replace("file_path", F.lit("\\"), F.lit("/")), "/", -1))
    d = held(df, _file=named)
    d = held(d, _pair=split_dashes(F.regexp_replace(F.substring_index(F.replace("_file", F.lit("\\"), F.lit("/")), "/", -1), r"(?<=.)\.[^.]*$", "")))
    d = held(d, _fa=F.col("_pair.artist"), _ft=F.when(F.col("_pair.artist") != "", lyrics_marked(F.col("_pair.title"))).otherwise(""), _given=lyrics_marked(F.col("title")))
    d = held(d, _front=split_dashes(F.col("_given")), _ak=key_value(F.col("artist")), _fak=key_value(F.col("_fa")))
    prefixed = (F.col("_front.artist") != "") & (((F.col("artist") == "") & (F.col("_fa") == "")) | key_value(F.col("_front.artist")).isin(F.col("_ak"), F.col("_fak")))
    d = held(d, _bare=clean_title(F.when(prefixed, lyrics_marked(F.col("_front.title"))).otherwise(F.col("_given"))))
    d = held(d, _ok=usable_title(F.col("_bare")), _lyrics=has_lyrics(F.col("_file")))
    agree = F.replace(key_value(F.col("_ft")), F.lit(" lyrics"), F.lit("")) == key_value(F.col("_bare"))
    from_name = (F.col("_ft") != "") & (~F.col("_ok") | F.col("_lyrics") | has_lyrics(F.col("_ft")) | agree)
    marked = F.when(F.col("_lyrics") & ~F.contains(F.lower("_bare"), F.lit("(lyrics)")), F.concat("_bare", F.lit(" (Lyrics)"))).otherwise(F.col("_bare"))
    title = F.when(from_name, clean_title(F.col("_ft"))).when(F.col("_ok"), marked).when(usable_title(F.col("_own_title")), clean_title(lyrics_marked(F.col("_own_title")))).otherwise(F.lit(""))
    d = held(d, _title=title, _named=best_provider_artist(F.col("_columns"), F.col("_payloads"), F.col("_given"), F.col("_ft")))
    doubtful = ~usable_artist(F.col("artist"), own_names) | ~usable_title(F.col("_given")) | ((F.col("_ft") != "") & (F.col("_given") != "") & (key_title(F.col("_ft")) == key_title(F.col("_given"))))
    d = held(d, _doubtful=doubtful)
    own, name = F.col("_own_artist"), F.col("_fa")
    found = F.coalesce(F.nullif("_named", F.lit("")), F.when(usable_artist(own, own_names), own), F.nullif(name, F.lit("")), F.when(usable_artist(F.col("artist"), own_names), F.col("artist")), F.lit(""))
    d = held(d, _artist=F.when(F.col("_doubtful"), found).otherwise(F.col("artist")))
    fallback = lambda c, other: F.when(missing(F.col(c)), F.col(other)).otherwise(F.col(c))
    d = held(d, _title=fallback("_title", "_ft"), _artist=fallback("_artist", "_fa"))
    return d.drop("_pair", "_given", "_front", "_ak", "_fak", "_bare", "_ok", "_lyrics", "_named", "_doubtful", "_fa", "_ft")


def with_genres(df: DataFrame, key: str, catalog: DataFrame, root: str | None = None) -> DataFrame:
    """C-15 and C-11, in part: ``df`` with ``_genre``, the genre as the catalogue writes it, and ``_sub``, the subgenres likewise.

    The genre is the first of the row's, unless that is unusable or names the title or artist; then the first folder of the
    path, below ``root`` where that column is given, that is one. What the catalogue does not know is put in title case. All
    values of a row are looked up by one join over distinct strings.
    """
    d = stored(held(df, _parts=split_values(F.col("genre")), _subs=split_values(F.col("subgenre"))), "portal")
    path = F.replace("file_path", F.lit("\\"), F.lit("/"))
    if root:
        path = F.when(F.col(root).isNotNull(), F.substr(path, F.length(root) + 1)).otherwise(path)
    folders = F.filter(F.transform(F.split(path, "/"), squeeze), lambda x: x != "")
    folders = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    entry = lambda kind, values: F.transform(values, lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), v.alias("value")))
    first = F.array(F.coalesce(F.get("_parts", F.lit(0)), F.col("genre")))
    each = d.select(key, F.explode(F.concat(entry("genre", first), entry("sub", F.col("_subs")), entry("path", folders))).alias("e")).select(key, "e.*").where("value <> ''")
    named = each.join(lookup(each, catalog).withColumnRenamed("name", "_known"), "value", "left")
    named = named.withColumn("name", F.coalesce(F.get(split_values(F.col("_known")), F.lit(0)), title_case(F.col("value"), lower_rest=False)))
    k = key_value(F.regexp_replace("value", r"\(new\)", ""))
    skipped = k.isin("", *NO_GENRE) | k.rlike(rf"^\d{{2,4}}s?$|^(?:{MONTH})\s+\d{{4}}$")
    named = named.where((F.col("kind") != "path") | (~skipped & usable_genre(F.col("name"))))
    own = lambda kind: F.transform(F.array_sort(F.filter("_e", lambda e: e["kind"] == kind)), lambda e: e["name"])
    per = named.groupBy(key).agg(F.collect_list(F.struct("kind", "pos", "name")).alias("_e"))
    d = held(d.join(per, key, "left"), _sub=F.coalesce(own("sub"), F.array().cast("array<string>")), _one=F.coalesce(F.get(own("genre"), F.lit(0)), F.lit("")), _path=F.coalesce(F.get(own("path"), F.lit(0)), F.lit("")))
    d = held(d, _tk=key_title(F.col("_title")), _rk=key_value(F.col("_artist")))
    free = lambda c: ~key_value(F.col(c)).isin(F.col("_tk"), F.col("_rk"))
    genre = F.when(usable_genre(F.col("_one")) & free("_one"), F.col("_one")).when((F.col("_path") != "") & free("_path"), F.col("_path")).otherwise("")
    return held(d, _genre=genre).drop("_parts", "_subs", "_e", "_one", "_path", "_tk", "_rk")


def voice_flags(vocals: Column, instrumental: Column) -> Column:
    """C-18: ``(vocal, instrumental)`` as stated: one of the two is 1, or both are empty."""
    i = flag(F.coalesce(F.nullif(instrumental, F.lit("")), vocals), "instrumental|no vocal|non vocal", "0")
    v = flag(vocals, "vocal|voice|sing", "0")
    return F.struct(F.when(i == "1", "0").when(v == "1", "1").otherwise("").alias("vocal"), F.when(i == "1", "1").when(v == "1", "0").otherwise("").alias("instrumental"))


def portal_rows(
    df: DataFrame, catalog: DataFrame, facts: DataFrame | None = None, languages: DataFrame | None = None, key: str = "row_id", root: str | None = None,
    album: str = "Single", label: str = "Unspecified", own_names: tuple[str, ...] = (), verify_voice: bool = False,
) -> DataFrame:
    """R-02, C-09 to C-18: report rows as the 14 portal columns, with ``seq`` (the unique ``key``) for their order.

    ``catalog(key, name, ord)`` is a genre dimension. ``facts(path, ...)`` has one row a file with any of
    ``duration_seconds, bpm, vocal, instrumental, title, artist``: what was measured or stands in the file itself; with
    ``verify_voice`` only measured voices count for files that are there. ``languages(key, language)`` is evidence of other
    texts for rows without a usable language. Columns that are absent count as blank.
    """
    from sonarium.operators.records import distinct_core

    none = F.lit(None).cast("string")
    known = [] if facts is None else [c for c in ("duration_seconds", "bpm", "vocal", "instrumental", "title", "artist") if c in facts.columns]
    d = df.select(
        F.col(key), *[_given(df, c).alias(c) for c in ("title", "artist", "album", "album_artist", "genre", "filename", "year", "language", "instrumental", *TAG_SOURCES)],
        _given(df, "file_path", "path").alias("file_path"), _given(df, "vocal", "vocals").alias("vocals"), _given(df, "tempo", "bpm").alias("tempo"),
        _given(df, "time", "duration_seconds", "duration_s", "duration", "length").alias("time"),
        F.array(*[_given(df, c) for c in ARTIST_COLUMNS]).alias("_columns"),
        F.concat(*[F.pandas_udf(_artists_in, NAMED)(F.nullif(F.col(c), F.lit(""))) for c in JSON_COLUMNS if c in df.columns], F.array().cast(NAMED)).alias("_payloads"),
        (df[root] if root else none).alias("_root"),
    )
    if known:
        d = d.join(facts.select(F.col("path").alias("file_path"), *[F.col(c).alias(f"_own_{c}") for c in known], F.lit(True).alias("_there")), "file_path", "left")
    d = d.withColumns({f"_own_{c}": none for c in ("duration_seconds", "bpm", "vocal", "instrumental", "title", "artist") if c not in known} | ({} if known else {"_there": F.lit(False)}))
    d = with_genres(with_names(d, own_names), key, catalog, "_root" if root else None)
    if languages is not None:
        d = d.join(languages.select(F.col(key), F.col("language").alias("_language")), key, "left")
    else:
        d = d.withColumn("_language", none)
    stated = voice_flags(F.col("vocals"), F.col("instrumental"))
    measured = F.when(F.col("_own_vocal").isin("0", "1"), F.struct(F.col("_own_vocal").alias("vocal"), F.col("_own_instrumental").alias("instrumental")))
    empty = F.struct(F.lit("").alias("vocal"), F.lit("").alias("instrumental"))
    voice = F.coalesce(measured, F.when(F.coalesce("_there", F.lit(False)), empty), stated) if verify_voice else F.when(stated["vocal"] != "", stated).otherwise(F.coalesce(measured, empty))
    length = F.regexp_replace("time", '^="|"$', "")
    own_time = F.when(length.contains(":"), seconds(length)).otherwise(F.bround(number(length)).cast("int"))
    d = held(d, _voice=voice, _seconds=F.coalesce(F.when(own_time > 0, own_time), F.col("_own_duration_seconds").cast("int"), F.lit(0)))
    blank = lambda c: F.when(missing(F.col(c)), "").otherwise(F.col(c))
    rest = F.flatten(F.array(F.col("_sub"), *[F.transform(split_values(F.col(c)), lambda t: title_case(t, lower_rest=False)) for c in TAG_SOURCES if c != "subgenre"]))
    language = F.when(usable_language(F.col("language")), F.col("language")).otherwise(F.coalesce("_language", F.lit("")))
    d = d.select(
        F.col(key).alias("seq"), F.col("_title").alias("title"), F.lit(album).alias("album"), F.col("_artist").alias("artist"), clock(F.col("_seconds")).alias("time"), blank("_genre").alias("genre"),
        F.coalesce(tempo(F.col("tempo")).cast("string"), tempo(F.col("_own_bpm").cast("string")).cast("string"), F.lit("")).alias("tempo"), F.coalesce(F.nullif(blank("filename"), F.lit("")), "_file").alias("filename"),
        blank("year").alias("year"), language.alias("language"), F.lit("0").alias("isDL"), F.lit(label).alias("label"), F.col("_voice.vocal").alias("vocal"), F.col("_voice.instrumental").alias("instrumental"),
        rest.alias("_tags"), F.array("album", "album_artist").alias("_others"), F.col("_title").alias("_t"), F.col("_artist").alias("_a"), F.col("_genre").alias("_g"),
    )
    # the tags are held to what was resolved, and again to what the core fields became
    others = F.filter(F.transform("_others", lambda x: F.when(~missing(x), key_value(x))), lambda x: F.coalesce(x, F.lit("")) != "")
    d = held(d, _tags=F.filter(F.col("_tags"), lambda t: ~key_value(t).isin("", "general") & ~F.array_contains(others, key_value(t))))
    d = held(d, _tags=distinct_tags(F.col("_tags"), F.col("_t"), F.col("_a"), F.col("_g")))
    d = distinct_core(d.drop("_others", "_t", "_a", "_g"))
    d = held(d, _tags=distinct_tags(F.col("_tags"), F.col("title"), F.col("artist"), F.col("genre")))
    return held(d, tag=F.array_join("_tags", ",")).drop("_tags")


def text_languages(texts: DataFrame, entity: str, text: str, code: str, least: int = 3) -> DataFrame:
    """C-16: ``(entity, language)`` by the texts about it: the language that most of their codes name, the first code on ties; corrected where
    at least ``least`` marker words of one of three neighbouring languages stand in them, more than of the others.

    Counts and sums in partial aggregates: an entity with a third of all texts costs a row a task. Entities without any
    evidence, and null ones, are left out.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-zà-ÿ]+)"), F.lit(1)))
    names = F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in LANGUAGES.items()) + ")")
    d = held(texts.where(F.col(entity).isNotNull()), _w=words, _named=F.try_element_at(names, F.lower(F.trim(code))))
    marks = [F.size(F.array_intersect("_w", F.array(*[F.lit(w) for w in ws.split()]))).alias(f"_{n}") for n, ws in MARKERS.items()]
    per = d.select(entity, "_named", *marks).groupBy(entity, "_named").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"_{n}").alias(f"_{n}") for n in MARKERS])
    most = F.max(F.when(F.col("_named").isNotNull(), F.struct("n", "_named")))["_named"]
    d = per.groupBy(entity).agg(most.alias("_most"), *[F.sum(f"_{n}").alias(f"_{n}") for n in MARKERS])
    alone = [F.when((F.col(f"_{n}") >= least) & (F.col(f"_{n}") > F.greatest(*[F.col(f"_{m}") for m in MARKERS if m != n])), n) for n in MARKERS]
    return d.select(entity, F.coalesce(*alone, "_most").alias("language")).where(F.col("language").isNotNull())


def lyrics_ranked(rows: DataFrame, hits: DataFrame, key: str, least_title: float = 0.72, least_artist: float = 0.50) -> DataFrame:
    """C-17: ``(key, lyrics)``: of each row's lyric hits the most plausible one that has lyrics, the first on ties.

    ``rows(key, title, artist)`` and ``hits(key, seq, title, artist, lyrics)``; 0.65 of the title's similarity and 0.35 of
    the artist's count; a row without an artist is held to the title alone.
    """
    from sonarium.operators.matching import plausible, with_similarity

    d = rows.join(hits.select(key, "seq", F.col("title").alias("_ht"), F.col("artist").alias("_ha"), "lyrics").where(F.trim("lyrics") != ""), key)
    d = d.withColumn("artist", F.when(missing(F.col("artist")), "").otherwise(F.col("artist")))
    d = with_similarity(with_similarity(d, "title", "_ht", "title_score"), "artist", "_ha", "artist_score")
    d = d.withColumn("artist_score", F.when(F.col("artist") == "", F.lit(0.65)).otherwise(F.col("artist_score"))).where(plausible(F.col("title_score"), F.col("artist_score"), least_title, least_artist))
    score = 0.65 * F.col("title_score") + 0.35 * F.col("artist_score")
    return d.groupBy(key).agg(F.max(F.struct(score.alias("s"), (-F.col("seq")).alias("o"), "lyrics"))["lyrics"].alias("lyrics"))
