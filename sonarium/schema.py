"""Column lists of the tables that are read and written."""

from __future__ import annotations

# The tag fields, in the order in which they vote.
TAG_FIELDS = (
    "title artist album album_artist year date genre subgenre mood moods energy valence danceability key language instruments vocals themes occasion weather season age_group "
    "track_number disc_number composer publisher copyright bpm isrc comment lyrics label catalog_number cover_art_url analysis_summary analysis_json"
).split()
# The final report, the debug report and the export of tags.
FINAL_COLUMNS = (
    "filename file_path title artist album album_artist year date genre subgenre mood moods energy valence danceability key language instruments vocals themes occasion weather season age_group "
    "track_number disc_number composer publisher copyright bpm isrc label catalog_number has_cover_art cover_art_url quality_score validation_status missing_tags sources"
).split()
DEBUG_COLUMNS = (
    ["filename", "file_path", "status", "written_fields", "missing_required", "providers_used", "error"]
    + [f for f in TAG_FIELDS if f not in ("cover_art_url", "analysis_summary", "analysis_json")]
    + ["has_cover_art", "cover_art_url", "analysis_summary", "analysis_json", "field_confidence_json", "field_sources_json", "hybrid_stage_summary", "notes"]
)
EXPORT_COLUMNS = ["filename", "file_path", "size_bytes", "duration_seconds", "bitrate", *TAG_FIELDS[:33], "has_cover_art", *TAG_FIELDS[33:]]
EXPORT_BASIC = ["filename", "title", "artist", "album", "genre"]
# The row that a portal imports.
PORTAL_COLUMNS = "title album artist time genre tempo filename year language isDL label vocal instrumental tag".split()
REQUIRED = ("title", "artist", "album", "year", "genre", "subgenre", "mood", "bpm", "key", "language", "track_number", "disc_number")

MEDIA = "path string, filename string, extension string, size_bytes bigint, mtime double, duration_seconds int, bitrate int, tags map<string,string>, has_cover_art boolean"
EVIDENCE = "path string, seq int, stage string, provider string, confidence double, fields map<string,string>, source_url string, notes string, raw string"
CACHE_LOG = "provider string, cache_key string, status_code int, response_json string, created_at double"
INVENTORY_LOG = "path string, size_bytes bigint, mtime double, extension string, duration_seconds int, bitrate int, tags_json string, has_cover_art string, scanned_at double"
STATE_LOG = "path string, size_bytes bigint, mtime double, status string, written_fields_json string, merged_json string, providers_json string, error string, processed_at double"
MANIFEST = "key string, root string, current_relpath string, size_bytes bigint, mtime_ns bigint, original_relpath string, first_seen_at string, last_seen_at string, status string, output_path string"
