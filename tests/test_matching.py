from difflib import SequenceMatcher

from pyspark.sql import functions as F

from sonarium.functions import text
from sonarium.operators import catalog, matching


def test_similarity(spark):
    pairs = [("Hello (Official Video)", "hello"), ("abc", "abc"), ("Love Song", "Love"), ("", "x"), (None, "x"), ("kitten", "sitting"), ("a & b", "a and b")]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r.s for r in matching.with_similarity(d, "a", "b", "s").collect()}
    assert got[0] == 1.0 and got[1] == 1.0 and abs(got[2] - 0.7) < 1e-9 and got[3] == 0.0 and got[4] == 0.0 and got[6] == 1.0
    assert abs(got[5] - SequenceMatcher(None, "kitten", "sitting").ratio()) < 1e-12


def test_best_candidate_and_ties(spark):
    d = spark.createDataFrame([("e", 1, 0.9, 0.5), ("e", 2, 0.9, 0.5), ("e", 3, 0.5, 1.0), ("f", 1, 0.1, 0.1)], "e string, seq int, title_score double, artist_score double")
    assert [(r.e, r.seq) for r in matching.best_candidates(d, "e").collect()] == [("e", 1)]


def test_blocked_match(spark):
    left = spark.createDataFrame([(1, "Blue Moon", "Ann"), (2, "Red", None), (3, None, None)], "id int, title string, artist string")
    right = spark.createDataFrame([(10, "Blue Moon (Live)", "Ann"), (11, "Blue Moon", "Bob"), (12, "Red", "Zed")], "rid int, title string, artist string")
    got = {r.l_id: r.r_rid for r in matching.match_blocked(left, right, "id", "rid", "title", "artist").collect()}
    assert got == {1: 10, 2: 12}


def test_pairs(spark):
    d = spark.createDataFrame([("dir/Ann - Song (Official Video).mp3", "Song", "", "Album")], "f string, t string, a string, b string")
    got = d.select(matching.candidate_pairs(F.col("f"), F.col("t"), F.col("a"), F.col("b")).alias("p")).first().p
    assert [(x.artist, x.title) for x in got] == [("", "Song"), ("Ann", "Song"), ("", "Album")]


def test_catalogue(spark):
    c = catalog.dimension(spark.createDataFrame([(1, "Hip Hop"), (2, "R&B"), (3, "Deep House"), (4, "hiphop")], "ord int, name string"))
    v = spark.createDataFrame([("hiphop",), ("rnb",), ("Deep House Music",), ("Nothing",), ("",), (None,)], "value string")
    got = {r.value: r.name for r in catalog.lookup(v, c).collect()}
    assert got["hiphop"] == "Hip Hop" and got["rnb"] == "R&B" and got["Deep House Music"] == "Deep House" and got["Nothing"] is None and got[""] is None
    d = spark.createDataFrame([(1, "dance, electronic; Dance"), (2, None)], "i int, g string")
    assert {r.i: r.out for r in catalog.normalise_lists(d, "i", "g", c).collect()} == {1: "Dance, Electronic", 2: ""}


def test_rules_first_wins(spark):
    d = spark.createDataFrame([(1, "deep house pop")], "i int, t string")
    got = {r.field: r.value for r in catalog.keyword_rules(d, "i", F.col("t"), [("house", {"m": "a"}), ("deep house", {"m": "b", "e": "c"})]).collect()}
    assert got == {"m": "a", "e": "c"}


def test_keys(spark):
    d = spark.createDataFrame([("  The A&B [x] (y) Official Vidéo ",)], "t string")
    r = d.select(text.key_plain(F.col("t")).alias("n1"), text.key_match(F.col("t")).alias("n2"), text.key_value(F.col("t")).alias("n4"), text.title_case(F.lit("uk r&b hOUSE")).alias("tc")).first()
    assert (r.n1, r.n2, r.n4, r.tc) == ("the a and b x y official vid o", "the a and b vid o", "the aandb x y official vid o", "UK R&B House")
