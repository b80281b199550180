import pytest

from sonarium.plans import pipeline
from sonarium.schema import FINAL_COLUMNS, TAG_FIELDS


@pytest.fixture
def sf(spark, tmp_path):
    row = {c: f"{c} x" for c in FINAL_COLUMNS} | {"file_path": "/m/a.mp3", "bpm": "100", "year": "2001", "has_cover_art": "yes", "isrc": "N/A", "sources": "{}"}
    spark.createDataFrame([(1, *[row[c] for c in FINAL_COLUMNS])], "row_id bigint, " + ", ".join(f"`{c}` string" for c in FINAL_COLUMNS)).write.parquet(str(tmp_path / "smoke_final_completed.parquet"))
    scans = [(1, "/m/a.mp3", 5, 60, 128, 1.0), (2, "/m/a.mp3", 7, 61, 256, 2.0), (3, "/m/b.mp3", 9, 1, 1, 3.0)]
    spark.createDataFrame(scans, "scan_id bigint, path string, size_bytes bigint, duration_seconds int, bitrate int, scanned_at double").write.parquet(str(tmp_path / "media_inventory.parquet"))
    return str(tmp_path), row


def test_export_has_every_tag_and_the_last_scan(spark, sf):
    at, row = sf
    (got,) = pipeline.export_tags(spark, at).collect()
    assert (got.size_bytes, got.duration_seconds, got.bitrate, got.isrc) == ("7", "61", "256", "")
    assert all(got[f] == row[f] for f in TAG_FIELDS if f in row and f != "isrc")


def test_report_has_every_tag(spark, sf):
    at, row = sf
    (got,) = pipeline.enrich_report(spark, at).collect()
    for f in ("composer", "key", "label", "language", "moods", "track_number", "album_artist", "disc_number"):
        assert got[f] == row[f]
    assert not {"key", "language", "track_number", "disc_number"} & set(got.missing_tags.split("; "))
