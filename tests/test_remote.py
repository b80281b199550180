import json
import pickle

import pytest
from pyspark.sql import functions as F

from sonarium.sources import remote


class Line:
    """Answers in a line, and a clock that sleeping moves on."""

    def __init__(self, *answers):
        self.answers, self.at, self.slept = list(answers), 0.0, []

    def __call__(self, request):
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a if len(a) == 3 else (*a, {})

    def sleep(self, s):
        self.slept.append(s)
        self.at += s

    def manners(self, **more):
        return remote.Manners(self, sleep=self.sleep, clock=lambda: self.at, **more)


def test_attempts():
    line = Line((503, None), (429, None, {"Retry-After": "7"}), (200, {"a": 1}))
    assert line.manners()({}) == {"a": 1} and 1 <= line.slept[0] <= 2 and 7 <= line.slept[1] <= 9
    assert Line((404, None)).manners()({}) == {}
    m = Line((200, "text")).manners()
    assert m({}) is None and m.failed == 1
    line = Line(OSError(), OSError(), OSError())
    assert line.manners()({}) is None and len(line.slept) == 2
    assert Line((400, {"a": 1})).manners()({}) is None


def test_waiting():
    none = lambda a, b: 0.0
    assert [remote.waiting(a, jitter=none) for a in range(6)] == [1, 2, 4, 8, 15, 15] and remote.waiting(0, "99", jitter=none) == 15 and remote.waiting(2, "soon", jitter=none) == 4
    assert all(4 <= remote.waiting(2) <= 6 for _ in range(50))


def test_breaker_and_pace():
    line = Line(*[(400, None)] * 2, (200, []), *[(400, None)] * 3)
    m = line.manners(failures=3)
    assert [m({}) for _ in range(7)] == [None, None, [], None, None, None, None] and m.open() and not line.answers
    assert not pickle.loads(pickle.dumps(remote.Manners(len, failures=3))).open()
    line = Line((200, {}), (200, {}))
    m = line.manners(delay=2.0)
    m({})
    line.at += 0.5
    m({})
    assert line.slept == [1.5]


def test_pages(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError
        return (404 if "gone" in url else 200), ("text/plain" if "text" in url else "text/html; charset=x"), "<p>"

    d = spark.createDataFrame([("http://a",), ("http://a",), ("http://bad",), ("http://gone",), ("http://text",), (None,)], "url string")
    assert [tuple(r) for r in remote.fetched_pages(d, fetch).collect()] == [("http://a", "<p>")]
    pages = spark.createDataFrame([(1, "u1", "Winter Road", "Nora Falk"), (1, "u2", "Winter Road", ""), (1, "u3", "Other", "Nora Falk"), (2, "u4", "Ice", "Any One"), (3, "u5", None, None)], "e int, url string, title string, artist string")
    wanted = spark.createDataFrame([(1, "Winter Road", "Nora Falk"), (1, "Winter", "Nora"), (2, "Ice", "")], "e int, title string, artist string")
    got = {r.url: round(r.identity, 6) for r in remote.identified_pages(pages, wanted, "e").collect()}
    assert got == {"u1": 1.0, "u4": 0.86}


def test_recordings(spark):
    wanted = spark.createDataFrame([(1, "Winter Road", "Nora Falk"), (2, "Ice", None), (3, "Zzz", "Q")], "e int, title string, artist string")
    recs = [(1, 1, "r1", "Winter Road (Live)", "Nora Falk", 0.9, "l1", "w1"), (1, 2, "r2", "Winter Road", "Nora Falk", 1.0, "l2", "w9"), (1, 3, "r3", "Winter Road", "Nora Falk", 1.0, "l1", "w1"), (2, 1, "r4", "Ice", "X", 0.1, None, "w1"), (3, 1, "r5", "Aaa", "B", 1.0, None, None)]
    d = spark.createDataFrame(recs, "e int, seq int, recording_id string, title string, artist string, api_score double, release_id string, work_id string")
    rel = spark.createDataFrame([("l1", "One", "2001", "1", "1"), ("l2", "Two", "2002", "4", "1")], "release_id string, album string, date string, track string, disc string")
    got = {r.e: (r.recording_id, r.album, r.composer) for r in remote.recording_chain(wanted, d, rel, spark.createDataFrame([("w1", "Ida")], "work_id string, composer string"), "e").collect()}
    assert got == {1: ("r2", "Two", None), 2: ("r4", None, "Ida")}


@pytest.mark.parametrize("provider,payload,want", [
    ("spotify", {"name": "T", "artists": [{"name": "A"}, {"name": "B"}], "album": {"name": "L", "artists": [{"name": "A"}], "release_date": "2001-02-03", "images": [{"url": "u"}]}, "external_ids": {"isrc": "X"}, "track_number": 3}, {"title": "T", "artist": "A, B", "album": "L", "album_artist": "A", "date": "2001-02-03", "year": "2001", "isrc": "X", "track_number": "3", "cover_art_url": "u"}),
    ("discogs", {"title": "A - L", "year": 1999, "genre": [], "style": ["House", "Dub"], "label": ["X"], "catno": "C1"}, {"album": "A - L", "year": "1999", "genre": "House, Dub", "label": "X", "catalog_number": "C1"}),
    ("musicbrainz", {"title": "T", "artist-credit": [{"name": "A"}], "first-release-date": "1987"}, {"title": "T", "artist": "A", "date": "1987", "year": "1987"}),
    ("lastfm", {"name": "T", "album": {"image": [{"#text": ""}, {"#text": "m"}]}}, {"title": "T", "cover_art_url": "m"}), ("wikidata", {}, {}), ("cover_art_archive", {"images": [{"image": "i"}]}, {"cover_art_url": "i"}),
])
def test_payloads(spark, provider, payload, want):
    d = spark.createDataFrame([(json.dumps(payload),), ("broken{",), (None,)], "p string")
    assert [r.m for r in d.select(remote.projected(provider, F.col("p")).alias("m")).collect()] == [want, {}, {}]


def test_write_plan(spark):
    rows = [("/a.MP3", {"title": "T", "year": "2001", "date": "2001-02-03"}, {"title": 0.9, "year": 0.9, "date": 0.9}, {"title": "t"}), ("/b.m4a", {"year": "1999"}, {"year": 0.9}, None), ("/c.ogg", {"title": "X"}, {"title": 1.0}, {})]
    d = spark.createDataFrame(rows, "path string, fields map<string,string>, field_confidence map<string,double>, tags map<string,string>")
    assert sorted(tuple(r) for r in remote.write_plan(d, 0.5).collect()) == [("/a.MP3", "id3", "date", "2001-02-03"), ("/b.m4a", "mp4", "year", "1999")]
