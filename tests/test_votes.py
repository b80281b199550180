import random

from pyspark.sql import functions as F

from sonarium.operators import votes

MEDIA = "path string, tags map<string,string>, has_cover_art boolean"
EVIDENCE = "path string, seq int, provider string, confidence double, fields map<string,string>"
WEIGHTS = {"north": 1.0, "south": 0.8, "east": 0.5}


def _fused(spark, evidence, tags=None, least=0.65, required=("title", "composer", "isrc")):
    media = spark.createDataFrame([("/one", tags or {}, True)], MEDIA)
    rows = [("/one", n, source, sure, fields) for n, (source, sure, fields) in enumerate(evidence, 1)]
    return votes.merge(media, spark.createDataFrame(rows, EVIDENCE), spark.createDataFrame(list(WEIGHTS.items()), "provider string, weight double"), least, list(required)).first()


def test_what_lands_and_what_is_missing(spark):
    r = _fused(spark, [("south", 0.95, {"composer": "Ida", "key": "D minor"}), ("east", 0.9, {"title": "Low"}), ("nobody", 0.8, {"isrc": "X"})])
    assert r.fields == {"composer": "Ida", "key": "D minor"} and r.missing_required == ["title", "isrc"]
    assert {k: round(v, 6) for k, v in r.field_confidence.items()} == {"composer": 0.76, "key": 0.76, "title": 0.45, "isrc": 0.4}
    assert r.providers_used == ["east", "nobody", "south"] and r.field_sources == {"composer": "south", "key": "south"}


def test_agreement_adds_up_and_is_capped(spark):
    r = _fused(spark, [("east", 0.7, {"title": "Fjord"}), ("east", 0.7, {"title": "Fjord"}), ("south", 0.5, {"title": "Fjord"}), ("north", 0.6, {"title": "Fjell"})])
    assert r.fields["title"] == "Fjord" and r.field_confidence["title"] == 1.0 and r.field_sources["title"] == "east, south"
    assert r.notes == ["conflict on title: Fjord (1.10), Fjell (0.60)"]


def test_first_seen_wins_a_tie_and_dates_count_by_the_day(spark):
    r = _fused(spark, [("north", 0.7, {"label": "B"}), ("north", 0.7, {"label": "A"}), ("north", 0.4, {"date": "1987-06-05T10:00"}), ("north", 0.4, {"date": "1987-06-05"})])
    assert r.fields["label"] == "B" and r.fields["date"] == "1987-06-05" and abs(r.field_confidence["date"] - 0.8) < 1e-9


def test_the_files_own_tag(spark):
    r = _fused(spark, [("east", 0.2, {"composer": "Odd"})], {"composer": "Own  Spelling"}, least=0.8)
    assert r.fields["composer"] == "Own  Spelling" and r.field_sources["composer"] == votes.OWN and abs(r.field_confidence["composer"] - votes.OWN_WEIGHT) < 1e-9
    r = _fused(spark, [("north", 0.9, {"composer": "Sure"})], {"composer": "Own"}, least=0.8)
    assert r.fields["composer"] == "Sure"


def test_writable(spark):
    fields, sure, tags = {"composer": "Bo & Ida", "key": "D", "label": "X"}, {"composer": 0.9, "key": 0.7, "label": 0.2}, {"composer": "bo and ida"}
    d = spark.createDataFrame([(fields, sure, tags)], "f map<string,string>, c map<string,double>, t map<string,string>")
    w = lambda least: d.select(votes.writable(F.col("f"), F.col("c"), F.col("t"), least).alias("w")).first().w
    assert w(0.5) == {"key": "D"} and w(0.1) == {"key": "D", "label": "X"}


def test_tally_against_a_loop(spark):
    rng = random.Random(11)
    rows = [(f"e{rng.randint(0, 3)}", f"f{rng.randint(0, 1)}", rng.choice("uvw"), f"s{rng.randint(0, 4)}", rng.choice([0.15, 0.25, 0.6]), i) for i in range(300)]
    d = spark.createDataFrame(rows, "path string, field string, value string, source string, weight double, seq int")
    sums = {}
    for path, field, value, _, weight, _ in rows:
        sums.setdefault((path, field), {}).setdefault(value, []).append(weight)
    want = {k: max(((sum(w), v) for v, w in by.items()), key=lambda x: x[0]) for k, by in sums.items()}
    got = {(r.path, r.field): (r.score, r.value) for r in votes.winners(votes.tally(d, precise=True)).collect()}
    assert {k: (v, round(min(1.0, s), 9)) for k, (s, v) in want.items()} == {k: (v, round(s, 9)) for k, (s, v) in got.items()}
    assert votes.winners(votes.tally(d.limit(0))).count() == 0 and votes.conflicts(votes.tally(d.limit(0))).count() == 0
