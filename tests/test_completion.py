from pyspark.sql import functions as F

from sonarium.operators import completion, repair


def test_derived(spark):
    rows = [("Ice", "Nora", "", "", "deep house", "", "", "bright", "", "2019-05", "", ""), ("", "", "", "", "", "", "", "", "90", "", "X", "so low"), (None, None, None, None, None, None, None, None, None, None, None, None), ("Blå", "B", "", "", "ballad", "", "sad", "0.5", "", "2001", "", "")]
    d = spark.createDataFrame(rows, "title string, artist string, album string, album_artist string, genre string, moods string, mood string, valence string, bpm string, date string, isrc string, danceability string")
    a, b, c, e = completion.derived(d).collect()
    assert (a.album, a.album_artist, a.year, a.energy, a.mood, a.moods, a.valence, a.danceability, a.occasion, a.themes) == ("Ice", "Nora", "2019", "high", "upbeat", "upbeat", "0.78", "0.82", "busy store", "upbeat deep house")
    assert (a.label, a.publisher, a.copyright, a.isrc, a.catalog_number, a.language, a.subgenre, a.instruments) == ("Nora", "Nora", "(c) 2019 Nora", completion.UNLISTED, completion.UNLISTED, "English", "deep house", "electronic beat, synthesizer")
    assert (b.energy, b.mood, b.danceability, b.catalog_number, b.language, b.copyright, b.age_group) == ("medium", "balanced", "0.35", "X", "unknown", "", "general")
    assert (c.isrc, c.title, c.mood, c.track_number, c.themes) == ("", "", "balanced", "1", "balanced music")
    assert (e.energy, e.mood, e.valence, e.language) == ("low", "sad", "0.5", "unknown")
    full = completion.without_blanks(completion.derived(d)).collect()
    assert all(v != "" and v is not None for r in full for k, v in r.asDict().items())
    assert full[2].title == "unknown title" and full[2].label == completion.UNLISTED
    assert completion.derived(d.limit(0)).count() == 0 and completion.derived(d.withColumn("other", F.lit(1))).first().other == 1


def test_best_source(spark):
    rows = [
        (1, "Ann - Ice.mp3", "2019", "Ann", "Pop", "", "", "", "", "", ""), (2, "Ann - Ice.mp3 ", "Ice", "Ann", "Pop", "Dance Pop", "", "", "", "", ""), (3, "Ann - Ice.mp3", "Ice", "Ann", "Pop", "house", "", "", "", "", ""),
        (4, "7 - 7.mp3", "7", "7", "Pop", None, None, None, None, None, None), (5, None, None, None, None, None, None, None, None, None, None),
    ]
    d = spark.createDataFrame(rows, "row_id int, filename string, title string, artist string, genre string, " + ", ".join(f"{c} string" for c in repair.FIELDS))
    points = {r.row_id: r.p for r in repair.source_points(d, "p").collect()}
    assert points == {1: -50 + 30 + 10 + 0 + 10, 2: 30 + 30 + 10 + 5 + 10, 3: 30 + 30 + 10 + 5 + 10, 4: 30 - 50 + 10 + 10, 5: -50 - 50 - 10}
    assert {r.name: r.row_id for r in repair.best_sources(d, "row_id").collect()} == {"Ann - Ice.mp3": 2, "7 - 7.mp3": 4, "": 5}


def test_rebuilt(spark):
    schema = "i int, title string, artist string, album string, genre string, label string, source struct<" + ", ".join(f"{c}:string" for c in repair.FIELDS) + ">"
    rows = [
        (1, "Ice", "Ann", "Single", "House", "L", ("dance pop; 2019, techno; Ice", "Calm", "odd words; calm", "rainy", "", "kids")),
        (2, "Pop", "Ann", "Single", "Rock", "L", ("", "", "", "", "", "")), (3, "Ice", "Ann", "", "Unheard", "", None),
    ]
    d = repair.rebuilt(spark.createDataFrame(rows, schema)).orderBy("i")
    got = [r.tag for r in d.collect()]
    assert got == ["Dance-pop,Techno,Calm,Rainy,All Weather,All Season,Youth/adult", "Energetic,All Weather,All Season,Youth/adult", "All Weather,All Season,Youth/adult".join(["Balanced,", ""])]
    cases = {"": ["blank tag"], "Pop,pop": ["duplicate tag"], "Pop,2019,Ann": ["bad tag value: 2019", "tag duplicates core field: Ann"], "Pop": []}
    t = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, t string")
    assert [r.x for r in t.select("i", repair.tag_issues(F.col("t"), [F.lit("Ann"), F.lit("")]).alias("x")).orderBy("i").collect()] == list(cases.values())


def test_values(spark):
    valid = {"Pop": True, "ab12": False, "(c) 2019 X": False, "{x": False, "C minor": False, "mixed instrumentation": False, "Needs_Review": False, "needs review": False, "": False, "1/2/2020": False}
    d = spark.createDataFrame([(i, v) for i, v in enumerate(valid)], "i int, v string")
    assert dict(zip(valid, [r.x for r in d.select("i", repair.valid_tag(F.col("v")).alias("x")).orderBy("i").collect()])) == valid
    mapped = {"R & B": "R&B", "electro": "Electronic", "top 40, rock": "Pop", ", folk": "Folk", "my dj set": "My DJ Set", "": ""}
    d = spark.createDataFrame([(i, v) for i, v in enumerate(mapped)], "i int, v string")
    assert dict(zip(mapped, [r.x for r in d.select("i", repair.mapped_genre(F.col("v")).alias("x")).orderBy("i").collect()])) == mapped
    pairs = {"a/Ann – Ice (Clean).mp3": ("Ann", "Ice"), "Ice.flac": ("", "Ice"), "A - B - C.mp4": ("A", "B - C")}
    d = spark.createDataFrame([(i, v) for i, v in enumerate(pairs)], "i int, v string")
    assert dict(zip(pairs, [tuple(r.x) for r in d.select("i", repair.named_pair(F.col("v")).alias("x")).orderBy("i").collect()])) == pairs
