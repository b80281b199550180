"""Queries on column functions and payloads, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.functions import numbers, text, validity
from sonarium.operators import votes, web
from sonarium.session import table
from sonarium.sources import providers, remote


def _report(spark, sf_dir):
    return table(spark, sf_dir, "smoke_final_completed")


def flags(spark, sf_dir):
    d = _report(spark, sf_dir)
    return d.select("row_id", text.flag(F.col("has_cover_art"), "cover", "0").alias("cover"), text.flag(F.col("vocals"), "vocal|choir", "0").alias("vocal"), text.flag(F.col("vocals"), "instrumental", "0").alias("instrumental"))


def dash_pairs(spark, sf_dir):
    d = _report(spark, sf_dir).select("row_id", text.split_dashes(F.col("filename")).alias("p")).where("p.artist <> ''")
    return d.select("row_id", "p.artist", "p.title")


def safe_names(spark, sf_dir):
    return _report(spark, sf_dir).select("row_id", text.safe_name(F.concat_ws("/", "artist", "genre")).alias("name"))


def vote_keys(spark, sf_dir):
    d = _report(spark, sf_dir)
    return d.select("row_id", *[text.key_vote(F.lit(f), F.coalesce(f, F.lit(""))).alias(f) for f in ("date", "year", "track_number", "bpm")])


def musical_keys(spark, sf_dir):
    return _report(spark, sf_dir).select("row_id", numbers.musical_key(F.coalesce("key", F.lit(""))).alias("k"), numbers.isrc(F.coalesce("isrc", F.lit(""))).alias("code"))


def usable_tags(spark, sf_dir):
    """P-08 and P-09 on whole columns: genres as tags and as genres, titles, artists and languages."""
    d = _report(spark, sf_dir)
    ok = {"tag": validity.usable_tag(F.col("genre")), "genre": validity.usable_genre(F.col("genre")), "title": validity.usable_title(F.col("title")), "artist": validity.usable_artist(F.col("artist")), "language": validity.usable_language(F.col("language"))}
    return d.select("row_id", *[c.alias(f"{n}_ok") for n, c in ok.items()])


def recognised(spark, sf_dir):
    """F-15 on the musical keys, dates, years, tempos, addresses and sources of all rows."""
    d = _report(spark, sf_dir)
    return d.select("row_id", validity.is_key(F.coalesce("key", F.lit(""))).alias("key_ok"), validity.is_date(F.coalesce("date", F.lit(""))).alias("date_ok"), validity.is_number(F.coalesce("bpm", F.lit(""))).alias("number_ok"), validity.is_url(F.coalesce("cover_art_url", F.lit(""))).alias("url_ok"), validity.missing(F.col("composer")).alias("gone"))


def clean_titles(spark, sf_dir):
    """F-03 and F-09 on every title."""
    d = _report(spark, sf_dir)
    return d.select("row_id", text.clean_title(F.coalesce("title", F.lit(""))).alias("title"), text.has_lyrics(F.col("title")).alias("lyrics"))


def value_keys(spark, sf_dir):
    """N3, N4, N5, N7 and N11 of the packed moods and the titles."""
    d = _report(spark, sf_dir)
    t = F.coalesce("title", F.lit(""))
    return d.select("row_id", text.key_recording(t).alias("recording"), text.key_value(F.col("moods")).alias("value"), text.key_title(t).alias("song"), text.key_repair(F.col("moods")).alias("repair"))


def label_specs(spark, sf_dir):
    spec = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("mood: "), F.col("mood"))).otherwise(F.col("mood"))
    d = _report(spark, sf_dir).select("row_id", text.label_spec(spec).alias("s"))
    return d.select("row_id", "s.field", text.fill_templates(F.lit("a {label} song"), F.col("s.label")).alias("prompt"))


def search_queries(spark, sf_dir):
    d = _report(spark, sf_dir)
    a, t = text.squeeze(F.col("artist")), text.squeeze(F.col("title"))
    return d.select("row_id", text.search_query(a, t).alias("quoted"), text.search_query(a, t, False).alias("plain"))


def content_keys(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    return d.groupBy(text.content_key("user_id", "event_type").alias("key")).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("keys"))


def payload_fields(spark, sf_dir):
    """R-05 and G-02: payloads of five providers made from every report row, and the fields read from them again."""
    d = _report(spark, sf_dir)
    s = lambda **fields: F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])
    named = lambda c: F.array(F.struct(F.col(c).alias("name")))
    made = {
        "deezer": s(title="title", artist=s(name="artist"), album=s(title="album"), isrc="isrc", bpm="bpm"),
        "itunes": s(trackName="title", artistName="artist", collectionName="album", primaryGenreName="genre", trackNumber="track_number", artworkUrl100="cover_art_url"),
        "spotify": s(name="title", artists=named("artist"), album=s(name="album", artists=named("album_artist")), external_ids=s(isrc="isrc"), track_number="track_number"),
        "discogs_release": s(title="album", labels=F.array(s(name="label", catno="catalog_number"))),
        "wikidata": s(description="title"),
    }
    parts = [d.select("row_id", F.lit(p).alias("provider"), F.explode(remote.projected(p, F.to_json(j))).alias("field", "value")) for p, j in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contributors(spark, sf_dir):
    d = _report(spark, sf_dir).where("composer IS NOT NULL AND artist IS NOT NULL")
    rel = F.array(F.struct(F.lit("Composer").alias("type"), F.concat("composer", F.lit(" (2)")).alias("name")), F.struct(F.lit("writer, composer").alias("type"), F.col("composer").alias("name")), F.struct(F.lit("performer").alias("type"), F.col("artist").alias("name")))
    return d.select("row_id", F.array_join(web.contributors(rel, ["composer", "writer"]), "; ").alias("names"))


def release_positions(spark, sf_dir):
    """R-07 on every title: the track of a release on two discs whose title has the same key."""
    d = _report(spark, sf_dir)
    track = lambda n, t: F.struct(n.alias("number"), t.alias("title"))
    tracks = F.array(track(F.lit("1"), F.lit("other one")), track(F.col("track_number"), F.concat("title", F.lit(" (Official Video)"))))
    release = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("position"), F.slice(tracks, 1, 1).alias("tracks")), F.struct(F.lit(2).alias("position"), tracks.alias("tracks"))).alias("media")))
    return d.select("row_id", web.release_position(release, F.col("title")).alias("p")).select("row_id", "p.track", "p.disc")


def front_covers(spark, sf_dir):
    d = _report(spark, sf_dir)
    images = F.array(F.struct(F.lit(False).alias("front"), F.lit("first").alias("url")), F.struct((F.col("row_id") % 2 == 0).alias("front"), F.lit("second").alias("url")))
    return d.select("row_id", web.front_cover(images).alias("url"))


def redirects(spark, sf_dir):
    d = _report(spark, sf_dir)
    url = F.concat(F.lit("https://s.example/l/?uddg="), F.url_encode("cover_art_url"), F.lit("&x=1"))
    e = d.select("album", F.col("row_id").alias("seq"), web.redirect_target(url).alias("url")).where("album IS NOT NULL")
    return web.distinct_urls(e, "album", 3)


def _written(spark, sf_dir, name):
    return table(spark, sf_dir, name).select(F.col("row_id").alias("path"), F.lit("artist").alias("field"), F.col("artist").alias("value"))


def written_differs(spark, sf_dir):
    """P-07 on every artist name of both tables."""
    return votes.written_differs(_written(spark, sf_dir, "smoke_final_completed"), _written(spark, sf_dir, "smoke_final_no_blanks")).select("path")


def identity_changed(spark, sf_dir):
    a = _report(spark, sf_dir).select(F.col("row_id").alias("path"), F.create_map(F.lit("artist"), F.coalesce("artist", F.lit(""))).alias("tags"))
    b = _report(spark, sf_dir).select(F.col("row_id").alias("path"), F.create_map(F.lit("artist"), F.coalesce("album_artist", F.lit(""))).alias("fields"))
    return providers.identity_changed(a, b)


QUERIES = {f.__name__: f for f in (
    flags, dash_pairs, safe_names, vote_keys, musical_keys, usable_tags, label_specs, search_queries, content_keys, payload_fields, contributors, release_positions, front_covers, redirects,
    written_differs, identity_changed, recognised, clean_titles, value_keys,
)}

_SQUEEZE = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{a0}}\x{{85}}]+', ' ', 'g'))"
_LOW = r"lower(trim(regexp_replace(coalesce(replace({0}, 'İ', 'i' || chr(775)), ''), '[\s\x{{a0}}\x{{85}}]+', ' ', 'g')))"
_DOTTED = "replace({0}, 'İ', 'i' || chr(775))"
_PLAINED = "lower(" + _DOTTED.format(_SQUEEZE) + ")"
_WORDS = "trim(regexp_replace(replace(lower(" + _DOTTED + "), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_MATCHED = r"trim(regexp_replace(replace(regexp_replace(regexp_replace(lower(" + _DOTTED + r"), '\[[^\]]+\]|\([^)]+\)', ' ', 'g'), '\b(official|video|audio|lyrics?|visualizer|remaster(ed)?|radio edit)\b', ' ', 'g'), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_KEYED = r"trim(regexp_replace(regexp_replace(replace({0}, '&', 'and'), '\bpopular music\b', 'pop', 'g'), '[^a-z0-9/]+', ' ', 'g'))"
_PLACEHOLDERS, _OTHER_FIELDS = str(validity.PLACEHOLDERS), str(validity.OTHER_FIELDS)
_GONE = f"({{0}} IN {_PLACEHOLDERS} OR regexp_matches({{0}}, '^(unknown|not listed|needs_review|needs review)'))"
_DATED = r"regexp_matches({0}, '^(\d{{4}}(-\d{{1,2}}(-\d{{1,2}})?)?|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})$')"
_NUMBER = r"regexp_matches({0}, '^[+-]?((\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)$')"
_OTHER = f"({_DATED} OR {_NUMBER} OR regexp_matches({{0}}, '^https?://'))"
SQL = {
    "value_keys": f"""WITH v AS (SELECT row_id, {_PLAINED.format('title')} AS t, {_PLAINED.format('moods')} AS m, lower({_DOTTED.format("coalesce(title, '')")}) AS raw FROM smoke_final_completed)
        SELECT row_id, trim(regexp_replace(regexp_replace(raw, '[\\[(][^\\])]*\\b(official|video|audio|lyrics?|visualizer|remaster(ed)?|radio edit|hd|hq)\\b[^\\])]*[\\])]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS recording, {_KEYED.format('m')} AS value,
        trim(regexp_replace(regexp_replace({_KEYED.format('t')}, '\\blyrics?\\b', ' ', 'g'), ' +', ' ', 'g')) AS song, trim(regexp_replace(replace(replace(m, 'ß', 'ss'), '&', 'and'), '[^a-z0-9/]+', ' ', 'g')) AS repair FROM v""",
    "flags": """WITH v AS (SELECT row_id, lower(trim(coalesce(has_cover_art, ''))) AS c, lower(trim(coalesce(vocals, ''))) AS v FROM smoke_final_completed)
        SELECT row_id, CASE WHEN c = 'yes' THEN '1' WHEN c = 'no' THEN '0' ELSE '0' END AS cover, CASE WHEN regexp_matches(v, 'vocal|choir') THEN '1' ELSE '0' END AS vocal, CASE WHEN regexp_matches(v, 'instrumental') THEN '1' ELSE '0' END AS instrumental FROM v""",
    "dash_pairs": r"""WITH p AS (SELECT row_id, regexp_extract(filename, '^(?s:(.*?[^\s]))\s+[-–—]\s+([^\s].*)$', ['a', 't']) AS p FROM smoke_final_completed) SELECT row_id, p.a AS artist, p.t AS title FROM p WHERE p.a <> ''""",
    "vote_keys": r"""SELECT row_id, coalesce(nullif(regexp_extract(coalesce(date, ''), '\b(\d{4}-\d{2}-\d{2})(?:\b|T)', 1), ''), trim(coalesce(date, ''))) AS date, coalesce(nullif(regexp_extract(coalesce(year, ''), '\b(19\d{2}|20\d{2})\b', 1), ''), trim(coalesce(year, ''))) AS year,
        coalesce(CAST(TRY_CAST(nullif(regexp_extract(coalesce(track_number, ''), '(\d+)', 1), '') AS BIGINT) AS VARCHAR), trim(coalesce(track_number, ''))) AS track_number, coalesce(nullif(regexp_extract(coalesce(bpm, ''), '(\d+)', 1), ''), trim(coalesce(bpm, ''))) AS bpm FROM smoke_final_completed""",
    "musical_keys": r"""SELECT row_id, CASE WHEN regexp_matches(coalesce(key, ''), '^[A-G][#b]? (major|minor)$') THEN key ELSE '' END AS k, regexp_extract(replace(upper(coalesce(isrc, '')), '-', ''), '\b([A-Z]{2}[A-Z0-9]{3}\d{7})\b', 1) AS code FROM smoke_final_completed""",
    "usable_tags": f"""WITH v AS (SELECT row_id, {', '.join(f"{_PLAINED.format(c)} AS {c}" for c in ('genre', 'title', 'artist', 'language'))} FROM smoke_final_completed)
        SELECT row_id, NOT (genre IN {_PLACEHOLDERS} OR regexp_matches(genre, '^needs[_ ]review') OR {_OTHER.format('genre')} OR regexp_matches(genre, '^[a-g][#b]? (major|minor)$')) AS tag_ok, NOT ({_GONE.format('genre')} OR {_OTHER.format('genre')}) AS genre_ok,
        NOT ({_GONE.format('title')} OR {_OTHER.format('title')}) AS title_ok, NOT ({_GONE.format('artist')} OR {_KEYED.format('artist')} IN {_OTHER_FIELDS}) AS artist_ok, NOT ({_GONE.format('language')} OR {_OTHER.format('language')} OR {_KEYED.format('language')} IN {_OTHER_FIELDS}) AS language_ok FROM v""",
    "recognised": f"""WITH v AS (SELECT row_id, {', '.join(f"{_PLAINED.format(c)} AS {c}" for c in ('key', 'date', 'bpm', 'cover_art_url', 'composer'))} FROM smoke_final_completed)
        SELECT row_id, regexp_matches(key, '^[a-g][#b]? (major|minor)$') AS key_ok, {_DATED.format('date')} AS date_ok, {_NUMBER.format('bpm')} AS number_ok, regexp_matches(cover_art_url, '^https?://') AS url_ok, {_GONE.format('composer')} AS gone FROM v""",
    "label_specs": "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'mood' ELSE 'theme' END AS field, 'a ' || trim(mood) || ' song' AS prompt FROM smoke_final_completed",
    "content_keys": "SELECT n, count(*) AS keys FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) GROUP BY n",
    "payload_fields": "WITH p AS (" + " UNION ALL ".join(
        f"SELECT row_id, '{p}' AS provider, '{f}' AS field, {_SQUEEZE.format(c)} AS value FROM smoke_final_completed" for p, fields in {
            "deezer": {"title": "title", "artist": "artist", "album": "album", "isrc": "isrc", "bpm": "bpm"},
            "itunes": {"title": "title", "artist": "artist", "album": "album", "album_artist": "artist", "genre": "genre", "track_number": "track_number", "cover_art_url": "cover_art_url"},
            "spotify": {"title": "title", "artist": "artist", "album": "album", "album_artist": "album_artist", "isrc": "isrc", "track_number": "track_number"},
            "discogs_release": {"album": "album", "label": "label", "catalog_number": "catalog_number"}, "wikidata": {"analysis_summary": "title"},
        }.items() for f, c in fields.items()) + ") SELECT row_id, provider, field, value FROM p WHERE value <> ''",
    "contributors": "SELECT row_id, trim(composer) AS names FROM smoke_final_completed WHERE composer IS NOT NULL AND artist IS NOT NULL",
    "release_positions": f"""WITH k AS (SELECT row_id, track_number, {_MATCHED.format('title')} AS k, {_MATCHED.format("(title || ' (Official Video)')")} AS o FROM smoke_final_completed)
        SELECT row_id, CASE WHEN k = 'other one' THEN '1' WHEN k = o THEN track_number END AS track, CASE WHEN k = 'other one' THEN 1 WHEN k = o THEN 2 END AS disc FROM k""",
    "front_covers": "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN 'second' ELSE 'first' END AS url FROM smoke_final_completed",
    "redirects": """WITH u AS (SELECT album, cover_art_url AS url, min(row_id) AS seq FROM smoke_final_completed WHERE album IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY album ORDER BY seq) AS pos FROM u)
        SELECT album, CAST(pos AS INTEGER) AS pos, url FROM r WHERE pos <= 3""",
    "written_differs": f"""SELECT coalesce(a.row_id, b.row_id) AS path FROM smoke_final_completed a FULL JOIN smoke_final_no_blanks b ON a.row_id = b.row_id WHERE {_WORDS.format("coalesce(a.artist, '')")} <> {_WORDS.format("coalesce(b.artist, '')")}""",
    "identity_changed": f"SELECT row_id AS path FROM smoke_final_completed WHERE {_LOW.format('album_artist')} <> '' AND {_LOW.format('artist')} <> {_LOW.format('album_artist')}",
    "search_queries": f"""WITH s AS (SELECT row_id, {_SQUEEZE.format('artist')} AS a, {_SQUEEZE.format('title')} AS t FROM smoke_final_completed)
        SELECT row_id, concat_ws(' ', '"' || nullif(a, '') || '"', '"' || nullif(t, '') || '"') AS quoted, concat_ws(' ', nullif(a, ''), nullif(t, '')) AS plain FROM s""",
    "safe_names": rf"""WITH s AS (SELECT row_id, regexp_replace(regexp_replace({_SQUEEZE.format("concat_ws('/', artist, genre)")}, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS s FROM smoke_final_completed)
        SELECT row_id, CASE WHEN s = '' THEN '_unmatched' ELSE s END AS name FROM s""",
}
