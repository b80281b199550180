"""Queries on readers and writers (as round trips), measures, voices, releases and names, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.functions import numbers, text
from sonarium.operators import catalog, intake, labels, matching, portal, records, state, votes
from sonarium.schema import FINAL_COLUMNS
from sonarium.session import fresh_path, table
from sonarium.sources import files

SHOWN = ["filename", "title", "artist", "album", "moods", "instruments", "sources"]


def _report(spark, sf_dir):
    return table(spark, sf_dir, "smoke_final_completed")


def csv_round_trip(spark, sf_dir):
    """K-06, K-12, S-07, S-08: the report written as CSV, quotes, delimiters and line ends in it, and read again."""
    to = fresh_path(spark, "report")
    files.write_report(_report(spark, sf_dir).select(F.col("row_id").cast("string"), *SHOWN), to)
    return files.read_csv(spark, to).select(F.col("row_id").cast("bigint").alias("row_id"), *SHOWN)


def json_round_trip(spark, sf_dir):
    """K-04, K-07, S-11: nested records and a manifest written as JSON lines and read again."""
    to, d = fresh_path(spark, "manifest"), table(spark, sf_dir, "media_inventory")
    files.write_manifest(d.select(F.col("path").alias("key"), F.lit("r").alias("root"), F.col("path").alias("current_relpath"), "size_bytes", F.col("scan_id").alias("mtime_ns")), to)
    return files.read_manifest(spark, to).select("key", "root", "size_bytes", "mtime_ns")


def log_and_compaction(spark, sf_dir):
    """K-08, K-09, K-10: scans appended to a log in two parts, compacted to its last rows."""
    log, to = fresh_path(spark, "log"), fresh_path(spark, "compacted")
    d = table(spark, sf_dir, "media_inventory").select("path", "scan_id", "size_bytes", "scanned_at")
    for part in (0, 1):
        files.append_log(d.where(F.pmod("scan_id", F.lit(2)) == part), log)
    state.compact(spark, log, to, ["path"], ["scanned_at", "scan_id"], force=True)
    return spark.read.parquet(to).select("path", "scan_id", "size_bytes")


def group_folders(spark, sf_dir):
    """K-11, T-15: rows written to one folder a group, and how many lie in each."""
    to = fresh_path(spark, "groups")
    records.write_groups(_report(spark, sf_dir).select("row_id", F.coalesce("language", F.lit("")).alias("language")), "language", to)
    return spark.read.option("header", True).option("inferSchema", False).csv(to).groupBy(F.col("group").cast("string").alias("folder")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.lower("folder"))


def label_lines(spark, sf_dir):
    """S-15: labels written as lines of one file and read in order."""
    to = fresh_path(spark, "labels")
    table(spark, sf_dir, "genre_catalog").orderBy("genre_id").select("name").coalesce(1).write.text(to)
    return files.read_labels(spark, to).select(F.col("ord").cast("bigint").alias("ord"), "label")


def catalog_payload(spark, sf_dir):
    """H-07, S-14: a catalogue's payload parsed into its dimension."""
    listed = F.array_sort(F.collect_list(F.struct("genre_id", "name")))
    d = table(spark, sf_dir, "genre_catalog").agg(F.to_json(F.struct(F.transform(listed, lambda x: F.struct(x["name"].alias("DisplayName"))).alias("data"))).alias("p"))
    return catalog.dimension(catalog.parse_payload(d, "p")).select("name", F.col("ord").cast("bigint").alias("ord"))


def _fields(spark, sf_dir, columns):
    d = _report(spark, sf_dir)
    return d, F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.coalesce(c, F.lit("")) for c in columns])), lambda _, v: v != "")


TAGS = [c for c in FINAL_COLUMNS if c not in ("filename", "file_path", "has_cover_art", "quality_score", "validation_status", "missing_tags", "sources")]


def final_report(spark, sf_dir):
    """K-03, C-03 to C-05: every row as a final report, its fields all found by one provider but those that were filled in."""
    d, fields = _fields(spark, sf_dir, TAGS)
    given = F.coalesce(F.from_json("sources", "map<string,string>"), F.create_map().cast("map<string,string>"))
    d = d.select(
        F.concat("file_path", F.lit("#"), F.col("row_id").cast("string")).alias("path"), fields.alias("fields"), F.map_filter(given, lambda k, v: v != "final_completion").alias("field_sources"),
        F.lit(0.51234).alias("quality_score"), (F.col("has_cover_art") == "yes").alias("has_cover_art"), F.when(F.col("row_id") % 5 == 0, "broken").alias("error"),
    )
    return files.final_rows(d, ["title", "isrc", "composer"]).select("file_path", *TAGS, "has_cover_art", "quality_score", "validation_status", "missing_tags")


def debug_report(spark, sf_dir):
    """K-02: every row as one of the debug report."""
    d, fields = _fields(spark, sf_dir, TAGS)
    d = d.select(
        F.concat("file_path", F.lit("#"), F.col("row_id").cast("string")).alias("path"), fields.alias("fields"), F.lit("updated").alias("status"), F.array(F.lit("title"), F.lit("isrc")).alias("written_fields"),
        F.array().cast("array<string>").alias("missing_required"), F.array(F.lit("a"), F.lit("b")).alias("providers_used"), F.lit(None).cast("string").alias("error"), (F.col("has_cover_art") == "yes").alias("has_cover_art"),
        F.create_map(F.lit("title"), F.lit(0.5)).alias("field_confidence"), F.create_map(F.lit("title"), F.lit("a")).alias("field_sources"), F.lit("free=a").alias("stage_summary"), F.array(F.lit("n")).alias("notes"),
    )
    return files.debug_rows(d).select("file_path", "status", "written_fields", "providers_used", "error", "title", "moods", "isrc", "comment", "has_cover_art", "field_confidence_json", "notes")


def writable_fields(spark, sf_dir):
    """P-06: of three fields of an earlier stage those that a write would change."""
    keys = ("title", "artist", "album")
    maps = lambda p: F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[F.coalesce(p + k, F.lit("")) for k in keys]))
    a = _report(spark, sf_dir).select("row_id", *[F.col(k).alias("a_" + k) for k in keys])
    d = a.join(table(spark, sf_dir, "smoke_final_no_blanks").select("row_id", *[F.col(k).alias("b_" + k) for k in keys]), "row_id")
    sure = F.create_map(F.lit("title"), F.lit(0.9), F.lit("artist"), F.lit(0.7), F.lit("album"), F.lit(0.2))
    return d.select("row_id", F.explode(votes.writable(maps("a_"), sure, maps("b_"), 0.5)).alias("field", "value"))


def measured_fields(spark, sf_dir):
    """R-14, R-15: measured features as fields, under what was predicted."""
    e = table(spark, sf_dir, "events")
    m = labels.dsp_fields(F.col("value"), F.when(F.col("event_id") % 4 > 0, F.lit("C#")), F.lit("minor"), F.col("event_id") % 7 / 2.0)
    d = e.select("event_id", labels.combined(F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("bpm"), F.lit("99"))).otherwise(F.create_map().cast("map<string,string>")), m).alias("m"))
    return d.select("event_id", *[F.col("m")[k].alias(k) for k in ("bpm", "key", "danceability")])


def confidences(spark, sf_dir):
    """A-14, M-05, M-09, T-02: blends of scores."""
    v, i = F.col("value") / 100, F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", labels.evidence_confidence(F.when(i % 5 > 0, v), i % 2 == 0, i % 3 > 0).alias("evidence"), F.round(numbers.clamp(v * 2 - 0.5), 6).alias("clamped"),
        F.round(numbers.blended(0.72, 0.18, v, 0.9), 6).alias("blended"), F.round(matching.recording_score(v, F.lit(0.8), i % 10 / 10.0), 6).alias("recording"), matching.plausible(v, F.lit(0.5)).alias("plausible"),
    )


def analysis_segments(spark, sf_dir):
    """M-07 on the length of every scanned file."""
    d = table(spark, sf_dir, "media_inventory").select("scan_id", F.posexplode(numbers.segments(F.col("duration_seconds"))).alias("pos", "s"))
    return d.select("scan_id", "pos", "s.start", "s.length")


def best_releases(spark, sf_dir):
    """T-03: of three releases the most similar, then an official, then a dated one, the first on ties."""
    i = F.col("event_id")
    one = lambda n: F.struct((i * (n + 3) % 4 / 4.0).alias("similarity"), ((i + n) % 2 == 0).alias("official"), ((i + n) % 3 == 0).alias("dated"), F.lit(n).alias("release"))
    return table(spark, sf_dir, "events").select("event_id", matching.best_release(F.array(one(0), one(1), one(2)))["release"].alias("release"))


def voices(spark, sf_dir):
    """P-23: which users' clearest vocal and instrumental scores are sure and far enough apart."""
    label = F.when(F.col("event_id") % 2 == 0, "Voice").otherwise("instrumental")
    d = table(spark, sf_dir, "events").where("event_id % 9 < 2 OR user_id % 3 = 0").select(F.col("user_id").alias("path"), label.alias("label"), (F.col("value") / 600).alias("score"))
    return labels.accepted_voice(d, 0.6, 0.05)


def icons(spark, sf_dir):
    """F-02 and F-25 on every title and genre, an icon put in."""
    c = F.concat(F.coalesce("title", F.lit("")), F.lit(" ☀️♫"), F.coalesce("genre", F.lit("")))
    line = text.env_line(F.concat(F.lit("  key_"), F.col("row_id").cast("string"), F.lit(' = "'), F.regexp_replace(F.coalesce("title", F.lit("")), "\"|'|\\s+$|^\\s+", ""), F.lit('"')))
    return _report(spark, sf_dir).select("row_id", text.strip_icons(c).alias("plain"), text.excel_text(F.coalesce("title", F.lit(""))).alias("excel"), line["key"].alias("key"), line["value"].alias("value"))


def public_urls(spark, sf_dir):
    """F-23 on every artist and title."""
    return _report(spark, sf_dir).select("row_id", text.public_url("https://files.example/", F.concat_ws(" - ", "artist", "title")).alias("url"))


def generic_stems(spark, sf_dir):
    """P-18 on every stem of a path, the digits of some of them alone."""
    stem = text.path_parts(F.col("path"))["stem"]
    d = table(spark, sf_dir, "media_inventory").select("path").distinct().withColumn("stem", F.when(F.length("path") % 3 == 0, F.regexp_replace(stem, "[^0-9]", "")).otherwise(stem))
    return d.select("path", intake.is_generic(F.col("stem")).alias("generic"))


def selected_files(spark, sf_dir):
    """S-03, P-16: the scanned files that an earlier stage of the report names."""
    d = table(spark, sf_dir, "media_inventory").select("path").distinct()
    return intake.selected(d, table(spark, sf_dir, "smoke_final_no_blanks").select(F.col("file_path").alias("path")))


def provider_artists(spark, sf_dir):
    """H-06: the artists that payloads made from every row name, with their scores."""
    s = F.struct(F.lit("deezer").alias("provider"), (F.col("row_id") % 10 / 10.0).alias("confidence"), F.struct(F.col("artist").alias("artist")).alias("fields"), F.col("album_artist").alias("primary_artist"))
    d = _report(spark, sf_dir).select("row_id", F.posexplode(F.pandas_udf(portal._artists_in, portal.NAMED)(F.to_json(s))).alias("pos", "a"))
    return d.select("row_id", F.round("a.score", 6).alias("score"), "a.name")


QUERIES = {f.__name__: f for f in (
    csv_round_trip, json_round_trip, log_and_compaction, group_folders, label_lines, catalog_payload, final_report, debug_report, writable_fields, measured_fields, confidences, analysis_segments, best_releases,
    voices, icons, public_urls, generic_stems, selected_files, provider_artists,
)}

_R = "smoke_final_completed"
_PLACE = "file_path || '#' || row_id"
_T = ", ".join(f"coalesce({c}, '') AS {c}" for c in TAGS)
_SQUEEZED = r"trim(regexp_replace(coalesce({0}, ''), '[\s\x{{a0}}\x{{85}}]+', ' ', 'g'))"
_WORDS = "trim(regexp_replace(replace(lower(replace(coalesce({0}, ''), 'İ', 'i' || chr(775))), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_SAFE = r"regexp_replace(regexp_replace(trim(regexp_replace(coalesce(language, ''), '[\s\x{a0}\x{85}]+', ' ', 'g')), '[<>:\"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g')"
SQL = {
    "csv_round_trip": f"SELECT row_id, {', '.join(f'''coalesce({c}, '') AS {c}''' for c in SHOWN)} FROM {_R}",
    "json_round_trip": "SELECT path AS key, 'r' AS root, size_bytes, scan_id AS mtime_ns FROM media_inventory",
    "log_and_compaction": "SELECT path, scan_id, size_bytes FROM media_inventory QUALIFY row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, scan_id DESC) = 1",
    "group_folders": f"SELECT CASE WHEN s = '' THEN '_unmatched' ELSE s END AS folder, count(*) AS n FROM (SELECT {_SAFE} AS s FROM {_R}) GROUP BY 1",
    "label_lines": "SELECT genre_id - 1 AS ord, trim(name) AS label FROM genre_catalog WHERE trim(name) <> ''",
    "catalog_payload": "SELECT name, genre_id - 1 AS ord FROM genre_catalog",
    "final_report": f"""WITH s AS (SELECT {_PLACE} AS file_path, row_id, {_T}, has_cover_art AS cover FROM {_R}), g AS (SELECT *, list_filter([CASE WHEN title = '' THEN 'title' END, CASE WHEN isrc = '' THEN 'isrc' END, CASE WHEN composer = '' THEN 'composer' END,
        CASE WHEN coalesce(cover, '') <> 'yes' AND cover_art_url = '' THEN 'cover_art' END], lambda x: x IS NOT NULL) AS gone FROM s)
        SELECT file_path, {', '.join(TAGS)}, CASE WHEN cover = 'yes' OR cover_art_url <> '' THEN 'yes' ELSE 'no' END AS has_cover_art, '0.512' AS quality_score,
        CASE WHEN row_id % 5 = 0 THEN 'failed' WHEN len(gone) > 0 THEN 'needs_review' ELSE 'validated' END AS validation_status, CASE WHEN len(gone) > 0 THEN array_to_string(gone, '; ') ELSE 'none' END AS missing_tags FROM g""",
    "debug_report": f"""SELECT {_PLACE} AS file_path, 'updated' AS status, 'title; isrc' AS written_fields, 'a; b' AS providers_used, '' AS error, coalesce(title, '') AS title, coalesce(moods, '') AS moods, coalesce(isrc, '') AS isrc, '' AS comment,
        CASE WHEN has_cover_art = 'yes' OR coalesce(cover_art_url, '') <> '' THEN 'yes' ELSE 'no' END AS has_cover_art, '{{"title":0.5}}' AS field_confidence_json, 'n' AS notes FROM {_R}""",
    "writable_fields": " UNION ALL ".join(f"SELECT a.row_id, '{k}' AS field, a.{k} AS value FROM {_R} a JOIN smoke_final_no_blanks b USING (row_id) WHERE coalesce(a.{k}, '') <> '' AND {_WORDS.format('a.' + k)} <> {_WORDS.format('b.' + k)}" for k in ("title", "artist")),
    "measured_fields": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '99' ELSE CAST(CAST(round_even(value, 0) AS INTEGER) AS VARCHAR) END AS bpm, CASE WHEN event_id % 4 > 0 THEN 'C# minor' ELSE 'minor' END AS key,
        CAST(round(least(1.0, event_id % 7 / 2.0 / 3), 3) AS VARCHAR) AS danceability FROM events""",
    "confidences": """WITH v AS (SELECT event_id AS i, value / 100 AS v FROM events), s AS (SELECT *, least(0.92, 0.55 + 0.42 * CASE WHEN i % 5 > 0 THEN v ELSE 0 END) AS s FROM v)
        SELECT i AS event_id, round(CASE WHEN i % 3 = 0 THEN 0.35 WHEN i % 2 = 0 THEN greatest(0.86, s) ELSE s END, 3) AS evidence, round(least(1, greatest(0, v * 2 - 0.5)), 6) AS clamped, round(least(0.9, 0.72 + 0.18 * v), 6) AS blended,
        round(least(0.98, greatest(0.40, 0.45 * v + 0.55 * (0.60 * 0.8 + 0.40 * (i % 10 / 10.0)))), 6) AS recording, v >= 0.55 AS plausible FROM s""",
    "analysis_segments": """WITH d AS (SELECT scan_id, duration_seconds AS d FROM media_inventory) SELECT scan_id, 0 AS pos, 0 AS start, CASE WHEN coalesce(d, 0) <= 0 THEN 45 ELSE d END AS length FROM d WHERE coalesce(d, 0) <= 90
        UNION ALL SELECT scan_id, p - 1, CAST(round(d * [0.15, 0.5, 0.85][p] - 7.5 + 0.0001) AS INTEGER), 15 FROM d, (SELECT unnest([1, 2, 3]) AS p) WHERE d > 90""",
    "best_releases": """WITH r AS (SELECT event_id, n, event_id * (n + 3) % 4 / 4.0 AS s, (event_id + n) % 2 = 0 AS o, (event_id + n) % 3 = 0 AS d FROM events, (SELECT unnest([0, 1, 2]) AS n))
        SELECT event_id, n AS release FROM r QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s DESC, o DESC, d DESC, n) = 1""",
    "voices": """WITH t AS (SELECT user_id AS path, max(value / 600) FILTER (WHERE event_id % 2 = 0) AS v, max(value / 600) FILTER (WHERE event_id % 2 = 1) AS i FROM events WHERE event_id % 9 < 2 OR user_id % 3 = 0 GROUP BY user_id),
        e AS (SELECT *, CASE WHEN v IS NULL OR i IS NULL THEN 'classes' WHEN greatest(v, i) < 0.6 THEN 'unsure' WHEN abs(v - i) < 0.05 THEN 'close' END AS error FROM t)
        SELECT path, CASE WHEN error IS NULL THEN CASE WHEN v > i THEN 'vocal' ELSE 'instrumental' END END AS voice, error FROM e""",
    "icons": rf"""WITH c AS (SELECT row_id, coalesce(title, '') AS t, coalesce(title, '') || ' ☀' || chr(65039) || '♫' || coalesce(genre, '') AS c, regexp_replace(coalesce(title, ''), '"|''|\s+$|^\s+', '', 'g') AS v FROM {_R})
        SELECT row_id, regexp_replace(c, '[\p{{So}}\p{{Sk}}\x{{FE0E}}\x{{FE0F}}\x{{200D}}]', '', 'g') AS plain, '="' || t || '"' AS excel, 'key_' || row_id AS key, v AS value FROM c""",
    "public_urls": f"SELECT row_id, 'https://files.example/' || replace(replace(url_encode(concat_ws(' - ', artist, title)), '~', '%7E'), '%2A', '*') AS url FROM {_R}",
    "generic_stems": r"""WITH p AS (SELECT DISTINCT path FROM media_inventory), s AS (SELECT path, regexp_replace(regexp_replace(replace(path, '\', '/'), '^(?s:.*)/', ''), '(.)\.[^.]+$', '\1') AS s FROM p),
        d AS (SELECT path, CASE WHEN length(path) % 3 = 0 THEN regexp_replace(s, '[^0-9]', '', 'g') ELSE s END AS s FROM s),
        t AS (SELECT path, regexp_replace(trim(regexp_replace(s, '[\s\x{a0}\x{85}]+', ' ', 'g')), '^[ .\-_]+|[ .\-_]+$', '', 'g') AS t FROM d)
        SELECT path, t = '' OR (NOT regexp_matches(t, '\s-\s') AND regexp_matches(t, '(?i)^(\d{4,}|[0-9a-f]{8,}|(track|audio|file|untitled|unknown|recording)[ _-]*\d*)$')) AS generic FROM t""",
    "selected_files": "SELECT DISTINCT path FROM media_inventory WHERE path IN (SELECT file_path FROM smoke_final_no_blanks)",
    "provider_artists": f"""SELECT row_id, round(5.9 + row_id % 10 / 10.0, 6) AS score, {_SQUEEZED.format('artist')} AS name FROM {_R} WHERE {_SQUEEZED.format('artist')} <> ''
        UNION ALL SELECT row_id, round(3.9 + row_id % 10 / 10.0, 6), {_SQUEEZED.format('album_artist')} FROM {_R} WHERE {_SQUEEZED.format('album_artist')} <> ''""",
}
