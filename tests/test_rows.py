"""Enrichment within rows against the same by joins, and its plan."""

import random

from sonarium.operators import votes
from sonarium.plans import pipeline
from sonarium.schema import FINAL_COLUMNS
from sonarium.sources import providers

MEDIA = "path string, tags map<string,string>, has_cover_art boolean"
WEIGHTS = [("a", 0.9), ("a", 0.8), ("b", 0.5)]
NAMES = ["Ann - Low", "Low", "low!", " ", "", "2001-02-03T01", "about 1999", "7/12", "N/A", "Ann House"]


def _media(spark, n=60):
    r = random.Random(3)
    fields = ["title", "artist", "genre", "album", "year", "date", "bpm", "track_number", "mood", "other"]
    tags = [{f: r.choice(NAMES + ["techno", "house folk", "128", "70"]) for f in r.sample(fields, r.randint(0, 8))} for _ in range(n)]
    return spark.createDataFrame([(f"/m/{i} Ann - Song {i}.mp3", t if i else None, i % 3 == 0) for i, t in enumerate(tags)], MEDIA)


def _same(got, want):
    close = lambda d: {k: round(v, 9) for k, v in (d or {}).items()}
    assert set(got) == set(want)
    for path, w in want.items():
        g = got[path]
        assert (g.fields, g.field_sources, g.providers_used, g.missing_required, g.notes) == (w.fields, w.field_sources, w.providers_used, w.missing_required, w.notes)
        assert close(g.field_confidence) == close(w.field_confidence) and abs(g.quality_score - w.quality_score) < 1e-9


def test_merging_in_rows_is_merging_by_joins(spark):
    media, r = _media(spark), random.Random(5)
    fields = ["title", "year", "date", "bpm", "disc_number", "mood", "unknown_field"]
    evidence = {m.path: [(s, r.choice(["a", "b", "c"]), r.random(), {f: r.choice(NAMES) for f in r.sample(fields, r.randint(0, 4))}) for s in range(1, r.randint(1, 6))] for m in media.collect()}
    shape = "path string, seq int, provider string, confidence double, fields map<string,string>"
    table = spark.createDataFrame([(p, *e) for p, es in evidence.items() for e in es], shape)
    arrays = spark.createDataFrame(list(evidence.items()), "path string, evidence array<struct<seq:int,provider:string,confidence:double,fields:map<string,string>>>")
    weights = spark.createDataFrame(WEIGHTS, "provider string, weight double")
    for least in (0.3, 0.76, 0.9):
        want = {x.path: x for x in votes.merge(media, table, weights, least, ["title", "mood", "cover_art"]).collect()}
        got = {x.path: x for x in votes.merge_rows(media.join(arrays, "path"), weights, least, ["title", "mood", "cover_art"]).collect()}
        _same(got, want)


def test_evidence_in_rows_is_evidence_by_joins(spark):
    media = _media(spark)
    rules = [("house", {"energy": "steady", "mood": "warm"}), ("techno", {"mood": "driving"}), ("folk", {"energy": "soft"})]
    own = [providers.in_rows("a", "free", providers.cleanup_answers), providers.in_rows("b", "web", providers.rules_answers(rules))]
    need = ["title", "artist", "mood"]
    want = {(x.path, *x[1:5], tuple(sorted(x.fields.items())), x.notes) for x in providers.collect_evidence(media, own, need).collect()}
    d = providers.with_evidence(media, own, need)
    got = {(x.path, e.seq, e.stage, e.provider, e.confidence, tuple(sorted(e.fields.items())), e.notes) for x in d.collect() for e in x.evidence}
    assert got == want and {e[1] for e in got} == {1, 2} and d.columns == [*media.columns, "evidence"]
    assert {x.path: x.tags for x in d.collect()} == {x.path: x.tags for x in media.collect()}


def test_enrichment_shuffles_no_files(spark, tmp_path):
    spark.createDataFrame([(1, *["x"] * len(FINAL_COLUMNS))], "row_id bigint, " + ", ".join(f"`{c}` string" for c in FINAL_COLUMNS)).write.parquet(str(tmp_path / "smoke_final_completed.parquet"))
    for query in (pipeline.enrich_merged, pipeline.enrich_report):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        files = plan[plan.index("FileScan"):]
        assert plan.count("FileScan") == 1 and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1, files[:200]
