from datetime import datetime, timedelta

from pyspark.sql import functions as F

from sonarium.operators.timestamps import date_cases, estimate_zones, normal_dates, normal_years, with_root

DATES = {
    "2020-09-10T03:33:43+02:00": "2020-09-10T01:33:43Z", "20201016": "2020-10-16", "20120325T025643Z": "2012-03-25T02:56:43Z", "17/02/2019 23:21": "2019-02-17T22:21:00Z",
    "15.11.2016 kl. 15.11": "2016-11-15T14:11:00Z", "1485444647": "2017-01-26T15:30:47Z", "1561767464686": "2019-06-29T00:17:44Z", "Wed, 09 Dec 2009 18:52:44 +0100": "2009-12-09T17:52:44Z",
    "26. december 2024": "2024-12-26", "01-AUG-2023": "2023-08-01", "August 23rd, 2013": "2013-08-23", "Jun 29 2016 12:37 AM": "2016-06-28T22:37:00Z", "March 2012": "2012-03", "08/2017": "2017-08",
    "26/6/11": "2011-06-26", "2016/2/4": "2016-02-04", "2015-10-11T23:41:36[America/New_York]": "2015-10-12T03:41:36Z", "2019-01-19 23:44:34 JST": "2019-01-19T14:44:34Z",
    "2017-01-18T13:56:59.811": "2017-01-18T12:56:59Z", " 2013-01-02 ": "2013-01-02", "2020-02-30": None, "31/11/2013": None, "0000-00-00": None, "soon": None, "": None, "2020-13": None,
    "2021-10-31 02:30:00": "2021-10-31T00:30:00Z", "2021-03-28 02:30:00": "2021-03-28T01:30:00Z", "2021-01-01 25:00:00": None, "2021-01-01 10:00:61": None, "2021-05-05 10:00 Nowhere/Land": None,
}
YEARS = {"(2024)": "2024", "© 2016": "2016", "year 2014": "2014", "'18": "2018", "18": "2018", "2019.0": "2019", "2019?": "2019", "2019-06": "2019", "2019-06-31": None, "5/3/23": "2023", "Mar 2019": "2019", "２０１９": "2019", "unknown": None, "0000": None}


def test_dates(spark):
    d = spark.createDataFrame([(k,) for k in DATES], "t string").withColumn("z", F.lit("Europe/Copenhagen"))
    assert {r.t: r.n for r in normal_dates(d, "t", "n", "z").collect()} == DATES
    none = spark.createDataFrame([("2021-01-01 10:00:00",), (None,)], "t string")
    assert [r.n for r in normal_dates(none, "t", "n").collect()] == [None, None]


def test_years(spark):
    d = spark.createDataFrame([(k,) for k in YEARS], "t string")
    assert {r.t: r.n for r in normal_years(d, "t", "n").collect()} == YEARS


def test_cases_take_the_zone_of_the_root(spark):
    roots = spark.createDataFrame([(1, "/srv/a", "Asia/Tokyo"), (2, "D:\\lib", "UTC")], "root_id int, root string, time_zone string")
    rows = [(1, "/srv/a/x.mp3", "2020-01-01 12:00:00", "2020"), (2, "D:\\lib\\x.mp3", "2020-01-01", " 2020"), (3, None, "2020-01-01 12:00:00", None), (4, "/srv/ab/x", "2020-01-01 12:00:00", "20")]
    d = spark.createDataFrame(rows, "row_id bigint, file_path string, date string, year string")
    got = sorted(tuple(r) for r in date_cases(d, roots).collect())
    assert got == [(1, "date", "2020-01-01T03:00:00Z"), (2, "year", "2020"), (4, "year", "2020")]
    assert date_cases(d.limit(0), roots).count() == 0
    assert date_cases(d, roots.limit(0)).count() == 2


def test_root_needs_a_whole_folder(spark):
    roots = spark.createDataFrame([("/a", "UTC"), ("/a/b", "Asia/Tokyo")], "root string, time_zone string")
    d = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/x",)], "file_path string")
    assert {r.file_path: r.z for r in with_root(d, "file_path", roots, "time_zone", "z").collect()} == {"/a/b/c": "Asia/Tokyo", "/a/bc": "UTC", "/x": None}


def test_zone_estimate(spark):
    start = datetime(2021, 1, 1)
    rows = [("t", start + timedelta(days=9 * i, hours=9 + i % 5), start + timedelta(days=9 * i, hours=i % 5, minutes=20)) for i in range(40)]
    rows += [("n", start + timedelta(days=9 * i, hours=i % 5), start + timedelta(days=9 * i, hours=5 + i % 5, minutes=5)) for i in range(9)] + [("x", None, start)]
    d = spark.createDataFrame(rows, "s string, l timestamp_ntz, a timestamp")
    got = {r.source: (r.time_zone, r.violations) for r in estimate_zones(d, "s", "l", "a", ["UTC", "Asia/Tokyo", "America/New_York"], 2).collect()}
    assert got == {"t": ("Asia/Tokyo", 0), "n": ("America/New_York", 0)}


def test_roots_of_many_depths(spark):
    roots = ["/r" * n for n in range(1, 61)]
    r = spark.createDataFrame([(x, f"Zone/{i}") for i, x in enumerate(roots, 1)], "root string, time_zone string")
    d = spark.createDataFrame([(x + "/file",) for x in roots], "file_path string")
    assert [int(x.z.split("/")[1]) for x in with_root(d, "file_path", r, "time_zone", "z").orderBy(F.length("file_path")).collect()] == list(range(1, 61))


def test_very_many_roots(spark):
    r = spark.range(2500).select(F.format_string("/root%d/", "id").alias("root"))
    d = spark.range(0, 2500, 500).select(F.format_string("/root%d/a/b.mp3", "id").alias("p"))
    assert {x.p: x.z for x in with_root(d, "p", r, "root", "z").collect()} == {f"/root{i}/a/b.mp3": f"/root{i}" for i in range(0, 2500, 500)}


def test_zones_in_order(spark, monkeypatch):
    from sonarium.operators import state
    from sonarium.operators.timestamps import estimate_zones_in_order

    rows = []
    for i in range(60):
        utc = datetime(2021, 3, 27, 12) + timedelta(hours=i)
        tokyo, berlin = utc + timedelta(hours=9), utc + timedelta(hours=1 if utc < datetime(2021, 3, 28, 1) else 2)
        rows += [("t", i, None if i % 2 else tokyo, utc if i % 2 else None), ("b", i, None if i % 2 else berlin, utc if i % 2 else None), ("none", i, None, utc), (None, i, tokyo, None)]
    d = spark.createDataFrame(rows, "s string, o int, l timestamp_ntz, k timestamp_ntz")
    for size in (1_000_000, 17):
        monkeypatch.setattr(state, "WINDOW_ROWS", size)
        got = {r.source: (r.time_zone, r.violations, r.n) for r in estimate_zones_in_order(d, "s", "o", "l", "k", ["Asia/Tokyo", "Europe/Berlin", "Europe/London", "UTC"]).collect()}
        assert got == {"t": ("Asia/Tokyo", 0, 30), "b": ("Europe/Berlin", 0, 30)}
    assert estimate_zones_in_order(d.limit(0), "s", "o", "l", "k", ["UTC"]).count() == 0


def test_roots_without_a_zone(spark):
    rows = [(i, f"/a/{i}", f"2021-01-{i:02d} 20:00", None, datetime(2021, 1, i, 11, 5)) for i in range(1, 9)] + [(9, "/b/x", "2021-01-01 20:00", "21", datetime(2021, 1, 1))]
    d = spark.createDataFrame(rows, "row_id bigint, file_path string, date string, year string, processed_at timestamp_ntz")
    roots = spark.createDataFrame([("/a", None), ("/b", "UTC"), ("/c", "Asia/Tokyo"), ("/d", "Europe/Berlin")], "root string, time_zone string")
    got = {(r.row_id, r.field_name): r.normal_value for r in date_cases(d, roots).collect()}
    assert got[(1, "date")] == "2021-01-01T11:00:00Z" and got[(9, "date")] == "2021-01-01T20:00:00Z" and got[(9, "year")] == "2021"
