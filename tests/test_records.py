from pyspark.sql import functions as F

from sonarium.functions import numbers
from sonarium.operators import catalog, intake, labels, portal, records, state, web
from sonarium.schema import FINAL_COLUMNS, PORTAL_COLUMNS


def test_round_robin(spark):
    g = spark.createDataFrame([("k", i, f"g{i}") for i in (1, 2, 3)], "k string, seq int, folder string")
    t = spark.createDataFrame([("k", i) for i in range(5)] + [("z", 9), (None, 8)], "k string, seq int")
    got = [(r.seq, r.folder) for r in records.round_robin(t, g, "k", "seq", "folder").orderBy("seq").collect()]
    assert got == [(0, "g1"), (1, "g2"), (2, "g3"), (3, "g1"), (4, "g2"), (8, "_unmatched"), (9, "_unmatched")]
    assert records.round_robin(t, g, "k", "seq", "folder", False).count() == 5


def _report(spark, *rows):
    full = [{c: "" for c in FINAL_COLUMNS} | {"row_id": i} | r for i, r in enumerate(rows, 1)]
    return spark.createDataFrame([tuple(r[c] for c in ["row_id", *FINAL_COLUMNS]) for r in full], "row_id bigint, " + ", ".join(f"`{c}` string" for c in FINAL_COLUMNS))


def _catalog(spark):
    return catalog.dimension(spark.createDataFrame([(1, "Dance"), (2, "House"), (3, "Electronic")], "ord int, name string"))


def test_convert(spark):
    base = {"title": "Song", "artist": "Ann", "genre": "dance, electronic", "language": "English", "year": "2020", "bpm": "120", "vocals": "vocal", "moods": "Upbeat; upbeat; Ann; general", "file_path": "/f"}
    d = _report(
        spark, base | {"filename": "Ann - Song.mp3"}, base | {"filename": "ann – song.MP3", "language": ""}, base | {"filename": "x.mp3", "genre": "House"},
        base | {"filename": "y.mp3", "title": "Bad", "artist": "12", "language": ""},
    )
    facts = spark.createDataFrame([("/f", 196)], "path string, duration_seconds int")
    rows = lambda x: portal.portal_rows(x, _catalog(spark), facts)
    got = records.convert(rows(d)).collect()
    assert len(got) == 1 and got[0].tag == "Upbeat" and got[0].genre == "Dance" and got[0].seq == 1 and got[0].time == "00:03:16"
    assert set(PORTAL_COLUMNS) < set(got[0].asDict())
    assert records.convert(rows(d), strict=False).count() == 2
    assert records.convert(rows(d.limit(0))).count() == 0


def test_logs(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert sorted((r.k, r.v) for r in state.last_wins(log, ["k"], ["o"]).collect()) == [("a", "z"), ("b", None)]
    b = state.bloat(log, ["k"]).first()
    assert (b.disk_rows, b.unique_rows, b.compact) == (4, 2, True)
    c = spark.createDataFrame([("p", "k1", 200, '{"a":1}', 100.0), ("p", "k2", 200, "broken{", 100.0)], "provider string, cache_key string, status_code int, response_json string, created_at double")
    asked = spark.createDataFrame([("p", "k1"), ("p", "k2"), ("p", "k3")], "provider string, cache_key string")
    hits = lambda ttl: {r.cache_key for r in state.cached(asked, c, F.lit(150.0), ttl).collect() if r.response}
    assert hits(60) == {"k1"} and hits(10) == set()


def test_pending(spark):
    m = spark.createDataFrame([("a", 1, 5.0), ("b", 1, 5.0), ("c", 1, 5.0)], "path string, size_bytes bigint, mtime double")
    log = spark.createDataFrame([("a", 1, 5.0004, "updated", 1.0), ("b", 1, 5.0, "failed", 1.0)], "path string, size_bytes bigint, mtime double, status string, processed_at double")
    assert {r.path for r in state.pending(m, log).collect()} == {"b", "c"}
    assert {r.path for r in state.pending(m, log, spark.createDataFrame([("c",)], "path string")).collect()} == {"b"}


def test_propagation_keeps_blank_first(spark):
    d = spark.createDataFrame([("s", 1, ""), ("s", 2, "Pop"), ("::", 1, "A"), ("::", 2, "B")], "k string, o int, g string")
    assert [r.x for r in state.propagated(d, "k", ["o"], "g", "x", "::").orderBy("k", "o").collect()] == ["A", "B", "", ""]
    d = spark.createDataFrame([(None, 1, "N"), (None, 2, "M"), ("s", 3, "S")], "k string, o int, g string")
    assert [r.x for r in state.propagated(d, "k", ["o"], "g", "x").orderBy("o").collect()] == ["N", "N", "S"]


def test_running_sums_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.random() < 0.4) for i in rng.sample(range(1000), 300)]
    d = spark.createDataFrame(rows, "k string, o int, f boolean")
    want, seen = {}, {}
    for k, o, _ in sorted(rows, key=lambda r: r[1]):
        want[o] = seen[k] = seen.get(k, 0) + 1
    assert {r.o: r.n for r in state.numbered(d, ["k"], "o", "n", rows=20).collect()} == want
    assert {r.o: r.n for r in state.numbered(d, ["k"], "o", "n").collect()} == want
    whole = sorted((str(r.k), r.first_at, r.last_at, r.failures) for r in state.streaks(d, "k", "o", F.col("f"), 2).collect())
    monkeypatch.setattr(state, "WINDOW_ROWS", 25)
    assert sorted((str(r.k), r.first_at, r.last_at, r.failures) for r in state.streaks(d, "k", "o", F.col("f"), 2).collect()) == whole and whole
    assert state.numbered(d.limit(0), ["k"], "o", "n").count() == 0


def test_last_wins_with_maps(spark):
    d = spark.createDataFrame([("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("b", 5, None)], "k string, o int, m map<string,string>")
    assert {r.k: r.m for r in state.last_wins(d, ["k"], ["o"]).collect()} == {"a": {"x": "2"}, "b": None}
    assert {r.k: r.m for r in state.first_per_key(d, ["k"], ["o"]).collect()} == {"a": {"x": "1"}, "b": None}


def test_web(spark):
    html = '<meta property="og:title" content="Meta"><script type="application/ld+json">{"name":"LD","byArtist":{"name":"Ann"}}</script><table><tr><th>Release date</th><td>2020</td></tr></table><dl><dt>Record label</dt><dd>Lab</dd></dl>'
    d = spark.createDataFrame([("u", html), ("v", ""), ("w", None)], "url string, html string")
    got = {(r.url, r.field): r.value for r in web.page_fields(d, "html", {"date": ["release date"], "label": ["label"]}).collect()}
    assert got == {("u", "date"): "2020", ("u", "label"): "Lab", ("u", "title"): "LD", ("u", "artist"): "Ann"}
    e = spark.createDataFrame([("e", 1, "d1", "f", "X", 1.0), ("e", 2, "d1", "f", "x", 1.0), ("e", 3, "d2", "f", "Y", 1.5)], "e string, seq int, domain string, field string, value string, weight double")
    assert web.consensus(e, "e").first().value == "Y"


def test_labels(spark):
    p = spark.createDataFrame([("p", 1, "Electronic---Techno", 0.9, "", ""), ("p", 2, "Rock---Punk", 0.8, "", ""), ("p", 3, "happy", 0.7, "mood head", ""), ("p", 4, "low", 0.01, "mood", "")], "path string, rank int, label string, score double, head string, field string")
    dim = spark.createDataFrame([("none", "x")], "label string, category string")
    got = {r.field: r.value for r in labels.bucket_fields(labels.categories(p, dim, 0.1)).collect()}
    assert got == {"genre": "Techno", "subgenre": "Punk", "moods": "happy"}
    v = spark.createDataFrame([("p", "vocal", 0.91), ("p", "instrumental", 0.09), ("q", "vocal", 0.54), ("q", "instrumental", 0.46), ("r", "odd", 1.0)], "path string, label string, score double")
    assert {r.path: (r.voice, r.error) for r in labels.accepted_voice(v, 0.5, 0.2).collect()} == {"p": ("vocal", None), "q": (None, "close"), "r": (None, "classes")}


def test_intake(spark):
    plan = spark.createDataFrame([(1, "f", "a.mp3"), (2, "f", "A.mp3"), (3, "g", "a.mp3")], "seq int, folder string, target string")
    taken = spark.createDataFrame([("f", "a (3).mp3")], "folder string, target string")
    assert [r.target for r in intake.free_names(plan, taken).orderBy("seq").collect()] == ["a (4).mp3", "A (5).mp3", "a.mp3"]
    d = spark.createDataFrame([("12345",), ("Ann - 12345",), ("Track 3",), ("Song",)], "s string")
    assert [r.g for r in d.select(intake.is_generic(F.col("s")).alias("g")).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([(1, "/m/A.mp3", "A.mp3"), (2, "/M/a.MP3", "a.mp3"), (3, None, "b.mp3"), (4, None, "dup.mp3")], "row_id int, file_path string, filename string")
    f = spark.createDataFrame([("/m/A.mp3",), ("/m/b.mp3",), ("/m/1/dup.mp3",), ("/m/2/dup.mp3",)], "path string")
    assert {r.row_id: r.how for r in intake.find_media(rows, f).collect()} == {1: "declared", 2: "relative", 3: "name", 4: None}


def test_numbers(spark):
    d = spark.createDataFrame([("1:02:03",), ("75:00",), ("196",), ("x",)], "t string")
    assert [r.c for r in d.select(records.clock_text(F.col("t")).alias("c")).collect()] == ["01:02:03", "01:15:00", "00:03:16", "00:00:00"]
    s = spark.createDataFrame([(240,), (60,), (None,)], "d int")
    assert [[tuple(x) for x in r.s] for r in s.select(numbers.segments(F.col("d")).alias("s")).collect()] == [[(29, 15), (113, 15), (197, 15)], [(0, 60)], [(0, 45)]]
    k = spark.createDataFrame([("1d",), ("1_000",), ("128.5",), ("nan",)], "t string")
    assert [r.n for r in k.select(numbers.number(F.col("t")).alias("n")).collect()] == [None, 1000.0, 128.5, None]
