"""Queries on predictions, page evidence and intake, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.functions import text
from sonarium.operators import intake, labels, portal, state, web
from sonarium.session import table

PAGE = '<html><head><meta property="og:title" content="{t}"><script type="application/ld+json">{{"name": "{t}", "byArtist": {{"name": "{a}"}}, "genre": "{g}"}}</script></head><body><table><tr><th>Release date</th><td>{d}</td></tr></table><dl><dt>Record label</dt><dd>{l}</dd></dl></body></html>'
LABELS = {"date": ["release date", "released"], "label": ["label"], "genre": ["genre"]}
# The suffixes of media files.
MEDIA_SUFFIXES = [".mp3", ".mp4", ".m4a", ".aac", ".flac", ".wav", ".wma", ".ogg"]
MARKERS = {code: portal.MARKERS[name] for code, name in (("da", "Danish"), ("no", "Norwegian"), ("sv", "Swedish"))}
DOMAINS = ["discogs.com", "musicbrainz.org", "example.org"]


def _pages(spark, sf_dir):
    """Pages made from report rows: a stand-in for fetched ones."""
    d = table(spark, sf_dir, "smoke_final_completed")
    html = F.lit(PAGE.replace("{{", "{").replace("}}", "}"))
    for mark, c in (("{t}", "title"), ("{a}", "artist"), ("{g}", "genre"), ("{d}", "date"), ("{l}", "label")):
        html = F.replace(html, F.lit(mark), F.regexp_replace(F.coalesce(c, F.lit("")), r'["<>&\\\n\t]', " "))
    site = F.element_at(F.array(*[F.lit(x) for x in (*DOMAINS, "www.discogs.com", "other.net")]), (F.col("row_id") % 5 + 1).cast("int"))
    return d.select(F.concat(F.lit("https://"), site, F.lit("/p/"), F.col("row_id").cast("string")).alias("url"), html.alias("html"))


def page_fields(spark, sf_dir):
    return web.page_fields(_pages(spark, sf_dir), "html", LABELS)


def allowed_domains(spark, sf_dir):
    return _pages(spark, sf_dir).select("url", web.host(F.col("url")).alias("host"), web.allowed(F.col("url"), DOMAINS).alias("ok"))


def domain_consensus(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed").where("album_artist IS NOT NULL AND genre IS NOT NULL")
    e = d.select("album_artist", F.col("row_id").alias("seq"), F.lit("genre").alias("field"), F.col("genre").alias("value"), F.concat(F.lit("d"), (F.col("row_id") % 7).cast("string")).alias("domain"), (F.col("row_id") % 7 + 1).cast("decimal(18,4)").alias("weight"))
    c = web.consensus(e, "album_artist")
    return c.select("album_artist", "field", "value", F.col("score").cast("double").alias("score"), F.array_join("domains", ",").alias("domains"))


def best_artist(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed").where("artist IS NOT NULL AND album IS NOT NULL")
    return web.best_artist(d.select("album", F.col("row_id").alias("ord"), F.col("artist").alias("name"), (F.col("row_id") % 10).alias("score")), "album").select("album", "name", "score")


def tags_payload(spark, sf_dir):
    """R-05 and R-16 on the scan log: title, artist and album out of the JSON of each row, broken ones giving none."""
    j = F.col("tags_json")
    d = table(spark, sf_dir, "media_inventory").where(F.try_parse_json("tags_json").isNotNull())
    return d.select("scan_id", web.first_path(j, ["$.title", "$.name"]).alias("title"), web.first_path(j, ["$.artist", "$.creator"]).alias("artist"))


def _predictions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    head = F.when(F.col("event_id") % 4 == 0, "mood head").when(F.col("event_id") % 4 == 1, "instrument head").otherwise("")
    label = F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("Electronic---"), F.col("event_type"))).otherwise(F.concat(F.col("event_type"), F.lit("_"), (F.col("event_id") % 3).cast("string")))
    return e.select(F.col("user_id").alias("path"), F.col("event_id").alias("rank"), label.alias("label"), (F.col("value") / 100).alias("score"), head.alias("head"), F.lit("").alias("field"))


def label_fields(spark, sf_dir):
    dimension = table(spark, sf_dir, "events").select("event_type").distinct().select(F.concat("event_type", F.lit(" 1")).alias("label"), F.lit("themes").alias("category"))
    return labels.bucket_fields(labels.categories(_predictions(spark, sf_dir), dimension, 0.1))


def zero_shot_top3(spark, sf_dir):
    """A-13, M-08, T-10: every embedding against the mean vectors of all labels."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    means = labels.pooled(e.where("label IS NOT NULL"), "label", "vector")
    return labels.zero_shot(e.select(F.col("vec_id").alias("item"), "vector"), means, 3).select("item", "label", "rank")


def centroids(spark, sf_dir):
    """A-13: mean vectors per label."""
    d = labels.pooled(table(spark, sf_dir, "embeddings").where("label IS NOT NULL"), "label", "embedding")
    return d.select("label", F.size("embedding").alias("n"), F.round(F.get("embedding", F.lit(0)), 5).alias("first"))


def prompt_best(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    d = e.select(F.col("user_id").alias("item"), F.col("event_type").alias("label"), F.col("event_id").alias("pos"), F.col("props").alias("prompt"), F.col("value").alias("score"))
    return labels.prompt_best(d)


def marker_language(spark, sf_dir):
    """A-16: how many marker words of each of three languages every text has, and the language that has most, if it is alone."""
    t = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-zà-ÿ]+)"), F.lit(1)))
    d = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    d = d.select("doc_id", *[F.size(F.array_intersect("t", F.array(*[F.lit(w) for w in ws.split()]))).alias(c) for c, ws in MARKERS.items()])
    alone = lambda c: F.greatest(*[F.col(x) for x in MARKERS if x != c]) < F.col(c)
    return d.withColumn("language", F.coalesce(*[F.when(alone(c), c) for c in MARKERS], F.lit("")))


def text_languages(spark, sf_dir):
    """C-16: the language of each file by the codes and marker words of the texts about it."""
    return portal.text_languages(table(spark, sf_dir, "documents"), "file_path", "text", "lang")


def media_scan(spark, sf_dir):
    """S-01 with the suffixes of media files."""
    d = table(spark, sf_dir, "media_inventory").select(F.lit("all").alias("root"), "path").distinct()
    return intake.media_files(d, MEDIA_SUFFIXES, ("_loop",)).select("path")


def generic_names(spark, sf_dir):
    d = table(spark, sf_dir, "media_inventory").select("path").distinct()
    p = text.path_parts(F.col("path"))
    return d.select("path", intake.is_generic(p["stem"]).alias("generic"), intake.clean_name(p["name"]).alias("clean"))


def new_files(spark, sf_dir):
    """P-19, X-02: the last scan of each file against a manifest of all earlier ones."""
    d = table(spark, sf_dir, "media_inventory").select(F.lit("r").alias("root"), F.col("path").alias("relpath"), "size_bytes", F.floor(F.col("mtime") * 1000).alias("mtime_ns"), "scanned_at", "scan_id")
    last = state.last_wins(d, ["relpath"], ["scanned_at", "scan_id"])
    known = d.join(last.select("scan_id"), "scan_id", "left_anti").withColumnRenamed("relpath", "current_relpath")
    return intake.new_files(last, known).select("scan_id")


def free_names(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed").select(F.col("row_id").alias("seq"), F.lit("in").alias("folder"), F.col("filename").alias("target"))
    taken = table(spark, sf_dir, "smoke_final_no_blanks").select(F.lit("in").alias("folder"), F.col("filename").alias("target"))
    return intake.free_names(d, taken).select("seq", "target")


def find_media(spark, sf_dir):
    return intake.find_media(table(spark, sf_dir, "smoke_final_completed").select("row_id", F.when(F.col("row_id") % 3 != 0, F.col("file_path")).alias("file_path"), "filename"), table(spark, sf_dir, "media_inventory").select("path"))


QUERIES = {f.__name__: f for f in (
    page_fields, allowed_domains, domain_consensus, best_artist, tags_payload, label_fields, zero_shot_top3, centroids, prompt_best, marker_language, media_scan, generic_names, new_files, free_names, find_media,
    text_languages,
)}

_PLAIN = "trim(regexp_replace(replace(lower({0}), '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_NORM = r"trim(regexp_replace(lower(replace(regexp_replace(replace({0}, '\', '/'), '^(?s:.*)/', ''), 'İ', 'i' || chr(775))), '[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}]+', ' ', 'g'))"
SQL = {
    "domain_consensus": f"""WITH e AS (SELECT album_artist, row_id AS seq, genre AS value, 'd' || (row_id % 7) AS domain, CAST(row_id % 7 + 1 AS DECIMAL(18,4)) AS weight, {_PLAIN.replace("replace(lower({0}), '&', ' and ')", "lower(genre)")} AS k FROM smoke_final_completed WHERE album_artist IS NOT NULL AND genre IS NOT NULL),
        f AS (SELECT album_artist, k, domain, min(seq) AS seq, arg_min(value, seq) AS value, arg_min(weight, seq) AS weight FROM e WHERE k <> '' GROUP BY ALL),
        v AS (SELECT album_artist, k, sum(weight) AS score, count(*) AS n, min(seq) AS seq, arg_min(value, seq) AS value, string_agg(domain, ',' ORDER BY domain) AS domains FROM f GROUP BY ALL)
        SELECT album_artist, 'genre' AS field, value, CAST(score AS DOUBLE) AS score, domains FROM v QUALIFY row_number() OVER (PARTITION BY album_artist ORDER BY score DESC, n DESC, seq) = 1""",
    "allowed_domains": """WITH s AS (SELECT row_id, ['discogs.com','musicbrainz.org','example.org','www.discogs.com','other.net'][row_id % 5 + 1] AS site FROM smoke_final_completed)
        SELECT 'https://' || site || '/p/' || row_id AS url, regexp_replace(site, '^www\\.', '') AS host, regexp_replace(site, '^www\\.', '') <> 'other.net' AS ok FROM s""",
    "prompt_best": "SELECT user_id AS item, event_type AS label, max(value) AS score, arg_max(props, {'v': value, 'p': -event_id}) AS prompt, count(*) AS prompts FROM events GROUP BY 1, 2",
    "zero_shot_top3": """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT label, pos, avg(v[pos]) AS m FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS pos FROM e WHERE label IS NOT NULL) GROUP BY label, pos),
        c AS (SELECT label, list(m ORDER BY pos) AS m FROM d GROUP BY label), p AS (SELECT vec_id AS item, c.label, list_cosine_similarity(v, m) AS s FROM e, c)
        SELECT item, label, CAST(row_number() OVER (PARTITION BY item ORDER BY s DESC, label) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY item ORDER BY s DESC, label) <= 3""",
    "centroids": "SELECT label, len(any_value(embedding)) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 5) AS first FROM embeddings WHERE label IS NOT NULL GROUP BY label",
    "marker_language": f"""WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(replace(text, 'İ', 'i' || chr(775)), '')), '[a-zà-ÿ]+')) AS t FROM documents),
        c AS (SELECT doc_id, {', '.join(f"len(list_intersect(t, {ws.split()})) AS {c}" for c, ws in MARKERS.items())} FROM t)
        SELECT doc_id, da, no, sv, CASE WHEN da > greatest(no, sv) THEN 'da' WHEN no > greatest(da, sv) THEN 'no' WHEN sv > greatest(da, no) THEN 'sv' ELSE '' END AS language FROM c""",
    "text_languages": f"""WITH t AS (SELECT file_path, lower(trim(lang)) AS code, list_distinct(regexp_extract_all(lower(coalesce(replace(text, 'İ', 'i' || chr(775)), '')), '[a-zà-ÿ]+')) AS t FROM documents WHERE file_path IS NOT NULL),
        l AS (SELECT * FROM (VALUES {', '.join(str(x) for x in portal.LANGUAGES.items())}) AS l(code, named)), d AS (SELECT t.*, l.named FROM t LEFT JOIN l USING (code)),
        m AS (SELECT file_path, arg_max(named, {{'n': n, 'x': named}}) AS most FROM (SELECT file_path, named, count(*) AS n FROM d WHERE named IS NOT NULL GROUP BY ALL) GROUP BY file_path),
        c AS (SELECT file_path, {', '.join(f"sum(len(list_intersect(t, {ws.split()}))) AS {c}" for c, ws in MARKERS.items())} FROM d GROUP BY file_path)
        SELECT file_path, CASE WHEN da >= 3 AND da > greatest(no, sv) THEN 'Danish' WHEN no >= 3 AND no > greatest(da, sv) THEN 'Norwegian' WHEN sv >= 3 AND sv > greatest(da, no) THEN 'Swedish' ELSE most END AS language FROM c LEFT JOIN m USING (file_path)
        WHERE greatest(da, no, sv) >= 0 AND language IS NOT NULL""",
    "media_scan": r"SELECT DISTINCT path FROM media_inventory WHERE regexp_matches(lower(path), '\.(mp3|mp4|m4a|aac|flac|wav|wma|ogg)$') AND NOT regexp_matches(replace(lower(path), '\', '/'), '(^|/)_loop/')",
    "new_files": """WITH d AS (SELECT *, CAST(floor(mtime * 1000) AS BIGINT) AS t, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, scan_id DESC) AS back FROM media_inventory)
        SELECT scan_id FROM d WHERE back = 1 AND NOT EXISTS (SELECT 1 FROM d k WHERE k.back > 1 AND k.path = d.path AND k.size_bytes = d.size_bytes AND k.t = d.t)""",
    "best_artist": r"""WITH k AS (SELECT album, row_id AS ord, artist AS name, row_id % 10 AS score, trim(regexp_replace(trim(regexp_replace(replace(lower(replace(trim(regexp_replace(artist, '[\s\x{a0}\x{85}]+', ' ', 'g')), 'İ', 'i' || chr(775))), '&', 'and'), '[^a-z0-9/]+', ' ', 'g')), ' +', ' ', 'g')) AS k
        FROM smoke_final_completed WHERE artist IS NOT NULL AND album IS NOT NULL), b AS (SELECT * FROM k WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY album, k ORDER BY score DESC, ord) = 1)
        SELECT album, name, CAST(score AS BIGINT) AS score FROM b QUALIFY row_number() OVER (PARTITION BY album ORDER BY score DESC, ord) = 1""",
    "tags_payload": r"""SELECT scan_id, trim(regexp_replace(coalesce(nullif(trim(json_extract_string(tags_json, '$.title')), ''), ''), '[\s\x{a0}\x{85}]+', ' ', 'g')) AS title, trim(regexp_replace(coalesce(nullif(trim(json_extract_string(tags_json, '$.artist')), ''), ''), '[\s\x{a0}\x{85}]+', ' ', 'g')) AS artist
        FROM media_inventory WHERE json_valid(tags_json) AND tags_json <> ''""",
    "free_names": r"""WITH p AS (SELECT row_id AS seq, filename AS target, lower(replace(filename, 'İ', 'i' || chr(775))) AS base, regexp_replace(replace(filename, '\', '/'), '^(?s:.*)/', '') AS name FROM smoke_final_completed),
        t AS (SELECT lower(replace(regexp_extract(filename, '^(?s:(.*?))(?: \((\d+)\))?(\.[^.]*)?$', 1) || regexp_extract(filename, '^(?s:(.*?))(?: \((\d+)\))?(\.[^.]*)?$', 3), 'İ', 'i' || chr(775))) AS base,
          coalesce(TRY_CAST(nullif(regexp_extract(filename, '^(?s:(.*?))(?: \((\d+)\))?(\.[^.]*)?$', 2), '') AS INTEGER), 1) AS n FROM smoke_final_no_blanks),
        h AS (SELECT base, max(n) AS high FROM t GROUP BY base), r AS (SELECT p.*, row_number() OVER (PARTITION BY p.base ORDER BY seq) + coalesce(high, 0) AS no FROM p LEFT JOIN h USING (base))
        SELECT seq, CASE WHEN no = 1 THEN target ELSE regexp_replace(name, '(.)\.[^.]+$', '\1') || ' (' || no || ')' || lower(regexp_extract(name, '.(\.[^.]+)$', 1)) END AS target FROM r""",
    "find_media": rf"""WITH f AS (SELECT DISTINCT path, lower(path) AS low, lower(regexp_replace(replace(path, '\', '/'), '^(?s:.*)/', '')) AS name, {_NORM.format('path')} AS norm FROM media_inventory),
        r AS (SELECT row_id, CASE WHEN row_id % 3 <> 0 THEN file_path END AS file_path, lower(filename) AS name, {_NORM.format('filename')} AS norm FROM smoke_final_completed),
        l AS (SELECT low, min(path) AS path FROM f GROUP BY low), n AS (SELECT name, min(path) AS path FROM f GROUP BY name HAVING count(*) = 1), m AS (SELECT norm, min(path) AS path FROM f WHERE norm <> '' GROUP BY norm HAVING count(*) = 1)
        SELECT r.row_id, coalesce(f.path, l.path, n.path, m.path) AS path, CASE WHEN f.path IS NOT NULL THEN 'declared' WHEN l.path IS NOT NULL THEN 'relative' WHEN n.path IS NOT NULL THEN 'name' WHEN m.path IS NOT NULL THEN 'normalised' END AS how
        FROM r LEFT JOIN f ON f.path = r.file_path LEFT JOIN l ON l.low = lower(r.file_path) LEFT JOIN n ON n.name = r.name LEFT JOIN m ON m.norm = r.norm""",
}
