from sonarium.operators import catalog, portal, records
from sonarium.schema import FINAL_COLUMNS


def test_time_is_measured_and_scored(spark):
    base = {"title": "Song", "artist": "Ann", "genre": "dance", "language": "English", "year": "2020", "bpm": "120", "vocals": "vocal", "filename": "Ann - Song.mp3"}
    rows = [base | {"file_path": "/a"}, base | {"file_path": "/b"}, base | {"file_path": "/c", "filename": "Ann - Else.mp3", "title": "Else"}]
    d = spark.createDataFrame([(i, *[r.get(c, "") for c in FINAL_COLUMNS]) for i, r in enumerate(rows, 1)], "row_id bigint, " + ", ".join(f"`{c}` string" for c in FINAL_COLUMNS))
    facts = spark.createDataFrame([("/a", None), ("/b", 3725)], "path string, duration_seconds int")
    genres = catalog.dimension(spark.createDataFrame([(1, "Dance")], "ord int, name string"))
    rows = portal.portal_rows(d, genres, facts)
    got = {r.seq: r.time for r in rows.collect()}
    assert got == {1: "00:00:00", 2: "01:02:05", 3: "00:00:00"}
    # the measured row of the file name wins by its points, not the earlier one
    assert {r.title: r.time for r in records.convert(rows, strict=False).collect()} == {"Song": "01:02:05", "Else": "00:00:00"}
    # a row without a duration is not valid
    assert [r.title for r in records.convert(rows).collect()] == ["Song"]
