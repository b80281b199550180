"""Queries that run whole pipelines: enrichment, final report, export, and streams replayed to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.operators import state, votes
from sonarium.plans.fusion import RULES
from sonarium.schema import REQUIRED, TAG_FIELDS
from sonarium.session import fresh_path, held, table
from sonarium.sources import files, providers
from sonarium.streaming import jobs


def _media(spark, sf_dir):
    """Every tag field that the report table holds, as the tags of its files."""
    d = table(spark, sf_dir, "smoke_final_completed")
    fields = [f for f in TAG_FIELDS if f in d.columns]
    tags = F.map_filter(F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.coalesce(f, F.lit("")) for f in fields])), lambda _, v: ~F.lower(F.trim(v)).isin("", "n/a", "-", "unknown", "needs_review"))
    return d.select(F.concat("file_path", F.lit("#"), F.col("row_id").cast("string")).alias("path"), tags.alias("tags"), (F.col("has_cover_art") == "yes").alias("has_cover_art"), "file_path")


def _merged(spark, sf_dir):
    media = _media(spark, sf_dir).drop("file_path")
    media = held(media, tags=F.col("tags"))
    own = [providers.in_rows("local_cleanup", "free", providers.cleanup_answers), providers.in_rows("rules_inference", "web", providers.rules_answers(RULES))]
    weights = spark.createDataFrame([("local_cleanup", 0.8), ("rules_inference", 0.9)], "provider string, weight double")
    return votes.merge_rows(providers.with_evidence(media, own, ["title", "artist", "mood"]), weights, 0.6, ["title", "artist", "mood"])


def enrich_report(spark, sf_dir):
    """Tags and two built-in providers fused into the final report's columns."""
    return files.final_rows(_merged(spark, sf_dir).withColumn("error", F.lit("")), list(REQUIRED))


def enrich_merged(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return m.select("path", F.array_join("providers_used", ",").alias("providers_used"), F.array_join("missing_required", ",").alias("missing"), F.col("fields")["title"].alias("title"))


def export_tags(spark, sf_dir):
    """K-05 with size, duration and bitrate from the last scan of each file."""
    facts = ("size_bytes", "duration_seconds", "bitrate")
    scans = table(spark, sf_dir, "media_inventory").select(F.col("path").alias("file_path"), *facts, "scanned_at", "scan_id")
    last = state.last_wins(scans, ["file_path"], ["scanned_at", "scan_id"]).select("file_path", *facts)
    m = _media(spark, sf_dir).join(last, "file_path", "left")
    return files.export_rows(m)


def paid_candidates(spark, sf_dir):
    return files.paid_candidates(table(spark, sf_dir, "smoke_final_completed"), ["bpm", "isrc", "key"]).select("row_id", "paid_candidate_reason")


def incremental_dedup(spark, sf_dir):
    """X-05: the events replayed as a stream into an emit-once table."""
    e = table(spark, sf_dir, "events")
    to = fresh_path(spark, "seen")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    jobs.run_once(stream.select("user_id", "event_type").withColumn("pair", F.concat_ws(":", "user_id", "event_type")), jobs.emit_once(to, "pair"), fresh_path(spark, "check"))
    return spark.read.parquet(to).select("user_id", "event_type")


def incremental_state(spark, sf_dir):
    """X-03: the events replayed into a log, and its current view."""
    e = table(spark, sf_dir, "events")
    to = fresh_path(spark, "log")
    stream = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    jobs.run_once(stream.select("user_id", "event_id", "event_type"), jobs.upsert_log(to), fresh_path(spark, "check"))
    return jobs.current(spark, to, ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


QUERIES = {f.__name__: f for f in (enrich_report, enrich_merged, export_tags, paid_candidates, incremental_dedup, incremental_state)}

SQL = {
    "paid_candidates": """WITH m AS (SELECT row_id, list_sort(list_intersect(list_transform(regexp_split_to_array(missing_tags, '[;,]'), lambda x: trim(x)), ['bpm', 'isrc', 'key'])) AS g FROM smoke_final_completed)
        SELECT row_id, array_to_string(g, '; ') AS paid_candidate_reason FROM m WHERE len(g) > 0""",
    "incremental_dedup": "SELECT DISTINCT user_id, event_type FROM events",
    "incremental_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
}
