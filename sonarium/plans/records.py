"""Queries on logs, portal rows and distribution, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.functions import numbers, text, validity
from sonarium.operators import catalog, matching, portal, records, state
from sonarium.operators.timestamps import with_root
from sonarium.session import table


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def last_wins_state(spark, sf_dir):
    d = _t(spark, sf_dir, "media_inventory").select("path", "scan_id", "size_bytes", "scanned_at")
    return state.last_wins(d, ["path"], ["scanned_at", "scan_id"]).select("path", "scan_id", "size_bytes")


def compaction_ratio(spark, sf_dir):
    return state.bloat(_t(spark, sf_dir, "media_inventory"), ["path"])


def first_seen(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("file_path", "doc_id", "source").where("file_path IS NOT NULL")
    return state.first_per_key(d, ["file_path"], ["doc_id"])


def ttl_cache_hits(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("cache_key"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created_at"), "event_id", "props")
    log = e.select(F.col("event_type").alias("provider"), "cache_key", F.col("props").alias("response_json"), (F.col("created_at") + F.col("event_id") / 1e9).alias("created_at"))
    now = e.agg(F.max("created_at").alias("now"))
    asked = log.select("provider", "cache_key").distinct().crossJoin(now)
    return state.cached(asked, log, F.col("now"), 7 * 86400.0).select("provider", "cache_key", F.col("response").isNotNull().alias("hit"))


def resume_pending(spark, sf_dir):
    """P-05: the last scan of each file against the state that all earlier scans left, and an earlier stage of the report."""
    scans = _t(spark, sf_dir, "media_inventory").select("path", "size_bytes", "mtime", "scanned_at", "scan_id")
    media = state.last_wins(scans, ["path"], ["scanned_at", "scan_id"])
    log = scans.join(media.select("scan_id"), "scan_id", "left_anti").select("path", "size_bytes", "mtime", F.lit("updated").alias("status"), F.struct("scanned_at", "scan_id").alias("processed_at"))
    reported = _t(spark, sf_dir, "smoke_final_no_blanks").select(F.col("file_path").alias("path"))
    return state.pending(media, log, reported).select("path")


def first_value_propagation(spark, sf_dir):
    return state.propagated(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", ["event_id"], "value", "first_value").select("event_id", "first_value")


def budget_cap(spark, sf_dir):
    return state.first_gated(_t(spark, sf_dir, "events").select("event_id", "user_id", "value"), F.col("value") > 50, ["event_id"], 100)


def top_per_key(spark, sf_dir):
    return matching.ranked(_t(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), "event_id"], 3)


def best_row_per_key(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    rules = {"long": (F.col("n_chars") >= 500, 20), "short": (F.col("n_chars") < 50, -30), "tagged": (F.coalesce("lang", F.lit("")) != "", 10), "located": (F.col("file_path").isNotNull(), 5)}
    d = d.select("source", F.coalesce("lang", F.lit("")).alias("lang"), "doc_id", validity.points(**rules).alias("points"))
    return d.groupBy("source", "lang").agg(F.max(F.struct("points", (-F.col("doc_id")).alias("o"))).alias("b")).select("source", "lang", (-F.col("b.o")).alias("doc_id"), "b.points")


def distinct_then_filter(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", text.key_plain(F.coalesce("text", F.lit(""))).alias("k"), "n_chars")
    return state.first_per_key(d, ["k"], ["doc_id"]).where("n_chars >= 100").select("doc_id")


def circuit_breaker_runs(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return state.streaks(e, "user_id", "event_id", F.col("event_type") == "click", 2)


def provider_metrics(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    r = e.select(F.col("event_type").alias("provider"), F.get_json_object("props", "$.k").cast("int").alias("n_fields"), F.when(F.col("value") < 10, "error: low").alias("notes"), F.col("event_id").alias("elapsed_ms"))
    return state.run_metrics(r)


def stage_summary(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    notes = F.when(F.col("event_id") % 3 == 0, F.lit("free: x")).when(F.col("event_id") % 3 == 1, F.lit("paid: y"))
    return state.stage_summary(e.select("user_id", F.col("event_type").alias("provider"), notes.alias("notes")), "user_id")


def round_robin_assign(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"))
    c = _t(spark, sf_dir, "customer").select((F.col("c_custkey") % 150).alias("user_id"), F.col("c_custkey").alias("seq"), F.col("c_mktsegment").alias("folder"))
    return records.round_robin(e, c, "user_id", "seq", "folder")


def split_groups(spark, sf_dir):
    d = with_root(_t(spark, sf_dir, "smoke_final_completed").select("file_path"), "file_path", _t(spark, sf_dir, "library_roots"), "root", "root")
    d = d.select(records.folder_group(F.col("file_path"), F.col("root")).alias("folder"))
    return d.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))


def _facts(spark, sf_dir):
    """What the last scan of each file measured and read: its duration, and the title and artist in its tags."""
    d = _t(spark, sf_dir, "media_inventory").select("path", "duration_seconds", "tags_json", "scanned_at", "scan_id")
    last = state.last_wins(d, ["path"], ["scanned_at", "scan_id"])
    return last.select("path", "duration_seconds", *[text.squeeze(F.get_json_object("tags_json", f"$.{c}")).alias(c) for c in ("title", "artist")])


def _portal(spark, sf_dir):
    d = with_root(_t(spark, sf_dir, "smoke_final_completed"), "file_path", _t(spark, sf_dir, "library_roots"), "root", "_at")
    entries = catalog.dimension(_t(spark, sf_dir, "genre_catalog").select(F.col("genre_id").alias("ord"), "name"))
    said = portal.text_languages(_t(spark, sf_dir, "documents"), "file_path", "text", "lang")
    languages = d.select("row_id", "file_path").join(said, "file_path").select("row_id", "language")
    return portal.portal_rows(d, entries, _facts(spark, sf_dir), languages, root="_at")


def portal_rows(spark, sf_dir):
    """C-09 to C-18 and R-02: every report row as a portal row."""
    return _portal(spark, sf_dir)


def portal_convert(spark, sf_dir):
    return records.convert(_portal(spark, sf_dir))


def portal_counters(spark, sf_dir):
    return records.converter_counters(_t(spark, sf_dir, "smoke_final_completed"), records.convert(_portal(spark, sf_dir)))


def portal_issues(spark, sf_dir):
    d = _portal(spark, sf_dir)
    return d.select(F.explode(records.portal_issues(d)).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def factual_issues(spark, sf_dir):
    """P-15 over the portal rows."""
    d = _portal(spark, sf_dir)
    return d.select(F.explode(records.factual_issues(d)).alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


def validity_issues(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem")
    found = validity.issues(quantity=F.col("l_quantity") > 45, discount=F.col("l_discount") >= 0.09, returned=F.col("l_returnflag") == "R", tax=F.col("l_tax") > 0.07)
    return d.select(F.array_join(found, ";").alias("issues")).groupBy("issues").agg(F.count(F.lit(1)).alias("n"))


def tag_split(spark, sf_dir):
    d = _t(spark, sf_dir, "smoke_final_completed").select("row_id", text.distinct_values(text.split_values(F.col("moods")), F.lower).alias("v"))
    return d.select("row_id", F.array_join("v", "|").alias("moods"))


def clock_times(spark, sf_dir):
    return _t(spark, sf_dir, "media_inventory").select("scan_id", numbers.clock(F.col("duration_seconds")).alias("time"))


def number_fields(spark, sf_dir):
    d = _t(spark, sf_dir, "smoke_final_completed")
    return d.select("row_id", numbers.tempo(F.col("bpm")).alias("tempo"), numbers.energy_band(numbers.ratio(F.col("danceability"))).alias("band"))


def track_windows(spark, sf_dir):
    d = _t(spark, sf_dir, "media_inventory")
    return d.select("scan_id", F.explode(numbers.windows(F.col("duration_seconds"), 3, 15)).alias("w")).select("scan_id", "w.start", "w.length")


QUERIES = {f.__name__: f for f in (
    last_wins_state, compaction_ratio, first_seen, ttl_cache_hits, resume_pending, first_value_propagation, budget_cap, top_per_key, best_row_per_key, distinct_then_filter, circuit_breaker_runs,
    provider_metrics, stage_summary, round_robin_assign, split_groups, portal_rows, portal_convert, portal_counters, portal_issues, factual_issues, validity_issues, tag_split, clock_times, number_fields, track_windows,
)}

SQL = {
    "last_wins_state": "SELECT path, scan_id, size_bytes FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM media_inventory) WHERE rn = 1",
    "compaction_ratio": "SELECT count(*) AS disk_rows, count(DISTINCT path) AS unique_rows, count(*) > count(DISTINCT path) * 1.5 AS compact FROM media_inventory",
    "first_seen": "SELECT file_path, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents WHERE file_path IS NOT NULL GROUP BY file_path",
    "ttl_cache_hits": "WITH m AS (SELECT max(epoch(ts)) AS now FROM events) SELECT event_type AS provider, CAST(user_id AS VARCHAR) AS cache_key, floor(max(now)) - (floor(max(epoch(ts)))) <= 7 * 86400 AS hit FROM events, m GROUP BY event_type, user_id",
    "resume_pending": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY scanned_at DESC, scan_id DESC) AS back FROM media_inventory)
        SELECT path FROM s cur WHERE back = 1 AND NOT EXISTS (SELECT 1 FROM s st WHERE st.back = 2 AND st.path = cur.path AND st.size_bytes = cur.size_bytes AND abs(st.mtime - cur.mtime) < 0.001)
        AND NOT EXISTS (SELECT 1 FROM smoke_final_no_blanks r WHERE r.file_path = cur.path)""",
    "first_value_propagation": "SELECT event_id, first_value(value) OVER (PARTITION BY user_id ORDER BY event_id) AS first_value FROM events",
    "budget_cap": "SELECT event_id, user_id, value FROM events WHERE value > 50 ORDER BY event_id LIMIT 100",
    "top_per_key": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) <= 3",
    "best_row_per_key": """SELECT source, lang, doc_id, CAST(points AS INTEGER) AS points FROM (SELECT source, coalesce(lang, '') AS lang, doc_id, CASE WHEN n_chars >= 500 THEN 20 ELSE 0 END + CASE WHEN n_chars < 50 THEN -30 ELSE 0 END
        + CASE WHEN coalesce(lang, '') <> '' THEN 10 ELSE 0 END + CASE WHEN file_path IS NOT NULL THEN 5 ELSE 0 END AS points FROM documents) QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY points DESC, doc_id) = 1""",
    "distinct_then_filter": "WITH k AS (SELECT doc_id, n_chars, trim(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents) SELECT doc_id FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1) WHERE n_chars >= 100",
    "circuit_breaker_runs": """WITH d AS (SELECT user_id, event_id, event_type = 'click' AS f, sum(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
        SELECT user_id, min(event_id) AS first_at, max(event_id) AS last_at, count(*) AS failures FROM d WHERE f GROUP BY user_id, g HAVING count(*) >= 2""",
    "provider_metrics": "SELECT event_type AS provider, count(*) AS calls, count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 0) AS hits, count(*) FILTER (WHERE value < 10) AS errors, round(avg(event_id), 1) AS average_ms FROM events GROUP BY event_type",
    "stage_summary": """WITH s AS (SELECT user_id, CASE event_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'unknown' END AS stage, event_type FROM events),
        p AS (SELECT user_id, stage || '=' || string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS t FROM s GROUP BY user_id, stage) SELECT user_id, string_agg(t, '; ' ORDER BY t) AS summary FROM p GROUP BY user_id""",
    "round_robin_assign": """WITH g AS (SELECT c_custkey % 150 AS user_id, list(c_mktsegment ORDER BY c_custkey) AS l FROM customer GROUP BY 1),
        e AS (SELECT user_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) SELECT e.user_id, e.seq, coalesce(l[r % len(l) + 1], '_unmatched') AS folder FROM e LEFT JOIN g USING (user_id)""",
    "split_groups": r"""WITH p AS (SELECT row_id, replace(file_path, '\', '/') AS p FROM smoke_final_completed), r AS (SELECT replace(root, '\', '/') || '/' AS r FROM library_roots), i AS (SELECT substr(p, length(r) + 1) AS i FROM p JOIN r ON starts_with(p, r))
        SELECT CASE WHEN contains(i, '/') THEN split_part(i, '/', 1) ELSE '_unmatched' END AS folder, count(*) AS n FROM i GROUP BY 1""",
    "validity_issues": """SELECT array_to_string(list_filter([CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount >= 0.09 THEN 'discount' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_tax > 0.07 THEN 'tax' END], lambda x: x IS NOT NULL), ';') AS issues, count(*) AS n FROM lineitem GROUP BY 1""",
    "tag_split": r"""WITH p AS (SELECT row_id, unnest(regexp_split_to_array(coalesce(moods, ''), '[,;]')) AS v, generate_subscripts(regexp_split_to_array(coalesce(moods, ''), '[,;]'), 1) AS pos FROM smoke_final_completed),
        c AS (SELECT row_id, pos, trim(regexp_replace(v, '\s+', ' ', 'g')) AS v FROM p), f AS (SELECT row_id, min(pos) AS pos, arg_min(v, pos) AS v FROM c WHERE v <> '' GROUP BY row_id, lower(v)),
        g AS (SELECT row_id, string_agg(v, '|' ORDER BY pos) AS moods FROM f GROUP BY row_id) SELECT s.row_id, coalesce(g.moods, '') AS moods FROM smoke_final_completed s LEFT JOIN g USING (row_id)""",
    "clock_times": "SELECT scan_id, printf('%02d:%02d:%02d', coalesce(duration_seconds, 0) // 3600, coalesce(duration_seconds, 0) % 3600 // 60, coalesce(duration_seconds, 0) % 60) AS time FROM media_inventory",
    "number_fields": r"""SELECT row_id, CASE WHEN regexp_matches(bpm, '^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$') AND CAST(bpm AS DOUBLE) BETWEEN 30 AND 300 THEN CAST(round_even(CAST(bpm AS DOUBLE), 0) AS INTEGER) END AS tempo,
        CASE WHEN CAST(danceability AS DOUBLE) >= 0.67 THEN 'high' WHEN CAST(danceability AS DOUBLE) >= 0.40 THEN 'medium' WHEN danceability IS NOT NULL THEN 'low' END AS band FROM smoke_final_completed""",
    "track_windows": """WITH d AS (SELECT scan_id, coalesce(duration_seconds, 0) AS d FROM media_inventory), w AS (SELECT scan_id, CAST(floor((d - 15) * (i + 1) / 4) AS INTEGER) AS start, 15 AS length FROM d, (SELECT unnest([0, 1, 2]) AS i) WHERE d > 15
        UNION ALL SELECT scan_id, 0, CASE WHEN d > 0 THEN least(15, d) ELSE 15 END FROM d WHERE d <= 15) SELECT DISTINCT scan_id, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length FROM w""",
}
