"""Resolution of portal rows and the rules around them, on tables of cases."""

import json

import pytest
from pyspark.sql import functions as F

from sonarium.functions import text, validity
from sonarium.operators import catalog, portal, records

COLUMNS = ["title", "artist", "album", "album_artist", "genre", "subgenre", "mood", "moods", "weather", "season", "age_group", "filename", "file_path", "year", "language", "vocals", "instrumental", "time", "bpm", "merged_json", "providers_json", "spotify_artist", "web_artist"]
BASE = {"title": "Winter Road", "artist": "Nora Falk", "genre": "House", "language": "English", "year": "2019", "bpm": "118", "vocals": "vocal", "filename": "clip.mp3", "time": "3:05"}


def _rows(spark, *rows):
    full = [(i, *[(BASE | r).get(c, "") for c in COLUMNS]) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(full, "row_id bigint, " + ", ".join(f"`{c}` string" for c in COLUMNS))


def _genres(spark):
    return catalog.dimension(spark.createDataFrame([(1, "House"), (2, "Deep House"), (3, "Drum & Bass"), (4, "Folk")], "ord int, name string"))


def _resolved(spark, *rows, **more):
    return [r for r in portal.portal_rows(_rows(spark, *rows), _genres(spark), **more).orderBy("seq").collect()]


def test_titles(spark):
    cases = {
        ("Winter Road", "clip.mp3"): "Winter Road", ("Nora Falk - Winter Road", "clip.mp3"): "Winter Road", ("Somebody - Winter Road", "clip.mp3"): "Somebody - Winter Road",
        ("Winter Road (feat. Ines) #new", "clip.mp3"): "Winter Road", ("Winter Road", "a/Nora Falk – Winter Road [Lyrics].mp4"): "Winter Road (Lyrics)", ("2019-03", "Nora Falk - Winter Road.mp3"): "Winter Road",
        ("unknown title", "Nora Falk — Ice.mp3"): "Ice", ("winter road", "Nora Falk - Winter Road (Official Video).mp3"): "winter road", ("", "clip.mp3"): "", ("https://x.example", "x.mp3"): "",
        ("RÃ¸d Vinter", "clip.mp3"): "Rød Vinter", ("Winter Road", "lyrics clip.mp3"): "Winter Road (Lyrics)",
    }
    got = _resolved(spark, *[{"title": t, "filename": f} for t, f in cases])
    assert {c: r.title for c, r in zip(cases, got)} == cases


def test_artists(spark):
    merged = json.dumps({"provider": "deezer", "confidence": 0.5, "fields": {"artist": "From Deezer"}})
    several = json.dumps([{"provider": "local_cleanup", "fields": {"artist": "Low"}}, {"provider": "spotify", "confidence": 0.1, "fields": {"artist": {"name": "Highly"}}}])
    rows = [
        {"artist": "Nora Falk"}, {"artist": "unknown artist", "filename": "Ann Bee - Winter Road.mp3"}, {"artist": "unknown", "merged_json": merged}, {"artist": "", "providers_json": several},
        {"artist": "dance pop", "spotify_artist": "Spot", "web_artist": "Web"}, {"artist": "n/a", "merged_json": "{broken", "filename": "x.mp3"}, {"artist": "Kept", "spotify_artist": "Other"},
        {"artist": "Kept", "filename": "Ann Bee - Winter Road.mp3"}, {"artist": "", "spotify_artist": "Winter Road", "web_artist": "Real - Winter Road"},
    ]
    assert [r.artist for r in _resolved(spark, *rows)] == ["Nora Falk", "Ann Bee", "From Deezer", "Highly", "Spot", "", "Kept", "Ann Bee", "Real"]
    facts = spark.createDataFrame([("/f", "In The File", "Its Title", 61)], "path string, artist string, title string, duration_seconds int")
    r = _resolved(spark, {"artist": "", "title": "", "file_path": "/f", "time": ""}, facts=facts)[0]
    assert (r.artist, r.title, r.time) == ("In The File", "Its Title", "00:01:01")


def test_payload_walk():
    p = {"provider": "itunes", "confidence": 0.5, "fields": {"artist": ["A", {"name": "B"}]}, "field_confidence": {"artist": 0.9}, "artist_name": "C", "merged": {"artist": "D", "fields": {"artists": "E"}}}
    assert [(round(s, 2), n) for s, n in portal.artists_in(json.dumps(p))] == [(6.85, "A, B"), (4.45, "C"), (5.95, "E"), (4.45, "D")]
    assert portal.artists_in(None) == portal.artists_in("") == portal.artists_in("[1, 2]") == portal.artists_in("{") == []
    deep = json.dumps({"artist": "x"})
    for _ in range(300):
        deep = "[" + deep + "]"
    assert portal.artists_in(deep) == [(3.5, "x")]


def test_genres_and_tags(spark):
    rows = [
        {"genre": "deep house; folk", "subgenre": "drum and bass, McFly Sound; deep house", "moods": "Upbeat; general; 2019; A major; upbeat", "album": "Calm", "mood": "calm"},
        {"genre": "0.78", "file_path": "/m/Folk/Aug 2026/x.mp3"}, {"genre": "Winter Road", "file_path": "/m/mp3/1990s/New Wave (new)/x.mp3"}, {"genre": "", "file_path": "x.mp3"}, {"genre": "Rare Kind"},
        {"genre": "not listed", "file_path": "/nora falk/x.mp3"},
    ]
    d = _rows(spark, *rows).withColumn("_at", F.when(F.col("file_path").startswith("/m/"), "/m"))
    got = portal.portal_rows(d, _genres(spark), root="_at").orderBy("seq").collect()
    assert [r.genre for r in got] == ["Deep House", "Folk", "New Wave (new)", "", "Rare Kind", ""]
    assert got[0].tag == "Drum & Bass,McFly Sound,Upbeat"


def test_voices_and_measures(spark):
    rows = [{"vocals": "vocal"}, {"vocals": "Instrumental"}, {"vocals": ""}, {"vocals": "no vocal"}, {"vocals": "unknown"}, {"instrumental": "1"}]
    assert [(r.vocal, r.instrumental) for r in _resolved(spark, *rows)] == [("1", "0"), ("0", "1"), ("", ""), ("0", "1"), ("", ""), ("0", "1")]
    facts = spark.createDataFrame([("/f", "0", "1", 99.6), ("/g", None, None, None)], "path string, vocal string, instrumental string, bpm double")
    rows = [{"file_path": "/f", "bpm": "", "vocals": "vocal"}, {"file_path": "/g", "bpm": "500"}, {"file_path": "/h", "bpm": "127.5"}]
    got = _resolved(spark, *rows, facts=facts, verify_voice=True)
    assert [(r.vocal, r.instrumental, r.tempo) for r in got] == [("0", "1", "100"), ("", "", ""), ("1", "0", "128")]


def test_languages(spark):
    d = spark.createDataFrame([("a", "x", "en"), ("a", "y", "EN"), ("a", None, "de"), ("b", "Kærlighed, hvad stadig?", "no"), ("c", "", "und"), (None, "hvad", "da"), ("d", "hvad", None)], "f string, t string, l string")
    said = {r.f: r.language for r in portal.text_languages(d, "f", "t", "l").collect()}
    assert said == {"a": "English", "b": "Danish"}
    evidence = spark.createDataFrame([(1, "Danish"), (2, "Danish")], "row_id bigint, language string")
    assert [r.language for r in _resolved(spark, {"language": "unknown language"}, {"language": "English"}, {"language": "2019"}, languages=evidence)] == ["Danish", "English", ""]


def test_lyric_hits(spark):
    rows = spark.createDataFrame([(1, "Winter Road", "Nora Falk"), (2, "Ice", ""), (3, "None", "X")], "row_id bigint, title string, artist string")
    hits = [(1, 1, "Winter", "Nora Falk", "part"), (1, 2, "Winter Road", "Nora Falk", "whole"), (1, 3, "Winter Road", "Nora Falk", " "), (1, 4, "Winter Road", "Zzz Qqq", "wrong"), (2, 1, "Ice", "Anybody", "ice"), (3, 1, "Qqqq", "X", "no")]
    got = {r.row_id: r.lyrics for r in portal.lyrics_ranked(rows, spark.createDataFrame(hits, "row_id bigint, seq int, title string, artist string, lyrics string"), "row_id").collect()}
    assert got == {1: "whole", 2: "ice"}


def test_issues(spark):
    good = {"title": "Winter Road", "artist": "Nora Falk", "album": "Single", "genre": "House", "language": "English", "time": "00:03:05", "tempo": "118", "year": "2019", "vocal": "1", "instrumental": "0", "filename": "x.mp3", "label": "L", "tag": "Calm"}
    cases = [
        ({}, [], []), ({"title": "2019-01-02"}, ["title invalid"], ["title not verified"]), ({"time": "00:00:00", "language": ""}, ["duration not resolved", "language invalid"], ["language not verified"]),
        ({"tempo": "", "year": ""}, ["tempo missing", "year missing"], ["year not verified"]), ({"year": "20x9", "tempo": "999"}, ["year invalid", "tempo invalid"], []),
        ({"vocal": "1", "instrumental": "1"}, ["vocal/instrumental invalid"], []), ({"title": "Nora Falk"}, [], ["title and artist are not distinct"]),
        ({"album": "Br�d"}, [], ["album contains unresolved encoding damage"]), ({"genre": "nora falk"}, [], ["genre conflicts with track identity"]),
    ]
    d = spark.createDataFrame([(i, *(good | c).values()) for i, (c, _, _) in enumerate(cases)], "i int, " + ", ".join(f"`{k}` string" for k in good))
    got = d.select("i", records.portal_issues(d).alias("a"), records.factual_issues(d).alias("b")).orderBy("i").collect()
    assert [(r.a, r.b) for r in got] == [(a, b) for _, a, b in cases]


@pytest.mark.parametrize("value,tag,title,artist,language", [
    ("Not listed in free sources", False, False, False, False), ("A", True, True, True, True), ("A major", False, True, True, True), ("c# minor", False, True, True, True), ("1999", False, False, True, False),
    ("needs review: x", False, False, False, False), ("unknown thing", True, False, False, False), ("House", True, True, False, False), ("12.5", False, False, True, False), ("nan", False, False, True, False),
    ("http://a.b", False, False, True, False), ("1/2/99", False, False, True, False), (None, False, False, False, False), ("Various Artists", True, True, True, True),
])
def test_usable(spark, value, tag, title, artist, language):
    d = spark.createDataFrame([(value,)], "v string")
    r = d.select(*[f(F.col("v")).alias(f"c{i}") for i, f in enumerate((validity.usable_tag, validity.usable_title, validity.usable_artist, validity.usable_language))]).first()
    assert tuple(bool(x) for x in r) == (tag, title, artist, language)


def test_clean_titles(spark):
    cases = {
        "Song (feat. X) #tag (1080p)": "Song", "Song (Official Video) [Official Audio] (Lyric Video)": "Song", "Song - Official Music Video": "Song", "Song | Videoclip": "Song", "☀ Song ☀️": "Song",
        'The ""Real"" Song': "The Real Song", "Video Games": "Video Games", "Song ft. A & B (Live)": "Song", "Song [ ] ( )": "Song", "Song (Jon Hamm)": "Song (Jon Hamm)", "Song ( Live )": "Song (Live)",
        "": "", "Official Video": "", "Song (Video) (Audio) (Clean) (Dirty) (Album Mix) (Musikvideo) (Coke Studio)": "Song", "a" * 5000 + " (video)" * 300: "a" * 5000, "- Song -": "Song",
    }
    d = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [r.c for r in d.select("i", text.clean_title(F.col("t")).alias("c")).orderBy("i").collect()]
    assert dict(zip(cases, got)) == cases


def test_values_and_keys(spark):
    d = spark.createDataFrame([("unpopular music",), ("Popular Music & More",), ("RÃ¸d ",), ("Café",), (None,)], "t string")
    assert [r.k for r in d.select(text.key_value(F.col("t")).alias("k")).collect()] == ["unpopular music", "pop and more", "r d", "cafe", ""]
    assert [r.v for r in d.select(text.clean_value(F.col("t")).alias("v")).collect()] == ["unpopular music", "Popular Music & More", "Rød", "Café", ""]
    assert text.mended("ÃƒÂ¸") == "ø" and text.mended("Ærø") == "Ærø"
    tags = d.limit(1).select(text.title_case(F.lit("McFly dj rnb"), lower_rest=False).alias("a"), text.title_case(F.lit("McFly dj rnb")).alias("b")).first()
    assert (tags.a, tags.b) == ("McFly DJ Rnb", "Mcfly DJ RNB")


def test_lyrics_marks(spark):
    cases = {"Song [Lyrics]": "Song (Lyrics)", "Song lyric video": "Song video (Lyrics)", "Lyrics": "", "Song": "Song", "Song - lyrics": "Song (Lyrics)"}
    d = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert [r.v for r in d.select("i", text.lyrics_marked(F.col("t")).alias("v")).orderBy("i").collect()] == list(cases.values())


def test_empty_and_clashing_columns(spark):
    d = _rows(spark, {}).withColumn("_title", F.lit("x")).withColumn("seq", F.lit(1))
    assert portal.portal_rows(d.limit(0), _genres(spark)).count() == 0
    assert portal.portal_rows(d, _genres(spark)).first().title == "Winter Road"
