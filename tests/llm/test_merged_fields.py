from datetime import datetime

from sonarium.llm import queries, survivors
from sonarium.schema import FINAL_COLUMNS


def test_every_report_column_survives(spark):
    assert queries.FIELDS == FINAL_COLUMNS
    rows = [
        {"title": "Song", "mood": "calm", "quality_score": "0.9", "validation_status": "needs_review", "missing_tags": "energy; isrc; cover_art", "sources": '{"title": "itunes", "mood": "final_completion"}'},
        {"title": "Song", "mood": "happy", "energy": "high", "has_cover_art": "yes", "quality_score": "0,5", "validation_status": "validated", "missing_tags": "none", "sources": '{"mood": "deezer", "energy": "clap"}'},
    ]
    cols = "row_id bigint, processed_at timestamp, " + ", ".join(f"`{c}` string" for c in FINAL_COLUMNS)
    d = spark.createDataFrame([(i, datetime(2021, 1, i), *[r.get(c) for c in FINAL_COLUMNS]) for i, r in enumerate(rows, 1)], cols)
    recs = spark.createDataFrame([(1, (1, "song")), (2, (1, "song"))], "row_id bigint, recording struct<entity:bigint,key:string>")
    got = survivors.merged_records(d, recs, d.select("row_id", "quality_score"), queries.FIELDS).first().asDict()
    assert list(got) == ["first_row_id", "n_rows", *FINAL_COLUMNS]
    assert (got["mood"], got["energy"], got["has_cover_art"], got["quality_score"]) == ("happy", "high", "yes", "0.9")
    assert (got["sources"], got["validation_status"], got["missing_tags"]) == ('{"title":"itunes","mood":"deezer","energy":"clap"}', "needs_review", "isrc")
