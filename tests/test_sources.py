import pytest

from sonarium.operators.catalog import parse_payload
from sonarium.sources import files, providers, settings
from sonarium.streaming import jobs


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes('﻿File Path,Tags\n/x,"{""a"": ""b,\nc""}"\n/y,\n'.encode())
    d = files.read_csv(spark, str(p))
    assert d.columns == ["file_path", "tags"] and [tuple(r) for r in d.collect()] == [("/x", '{"a": "b,\nc"}'), ("/y", "")]
    assert d.select(files.column(d, "nope", "tags", "file_path").alias("v")).collect()[1].v == "/y"
    out = str(tmp_path / "out")
    files.write_report(d, out)
    assert files.read_csv(spark, out).count() == 2


def test_discovery(tmp_path):
    for n in ("b.csv", "a.csv", "a_converted.csv", "x.txt"):
        (tmp_path / n).write_text("h\n")
    found = files.find_csv(str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.csv", "b.csv"]
    assert files.output_name("/q/a.csv") == "/q/a_converted.csv"
    assert files.find_pairs(["/s/a.csv"], ["/t/a.csv", "/t/a_tagged.csv"]) == [("/s/a.csv", "/t/a_tagged.csv")]


def test_scan_labels_manifest(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.mp3").write_bytes(b"x")
    (tmp_path / "m" / "b.txt").write_bytes(b"x")
    scan = files.scan_folder(spark, str(tmp_path / "m"), [".mp3"])
    assert [r.path.rsplit("/", 1)[1] for r in scan.collect()] == ["a.mp3"]

    def reader(path):
        return {"tags": {"title": " T ", "date": "2020-01-02", "x": ""}}

    assert files.read_tags(scan, reader).first().tags == {"title": "T", "date": "2020-01-02", "year": "2020"}
    (tmp_path / "l.txt").write_text("one\n\n two \n")
    assert [(r.ord, r.label) for r in files.read_labels(spark, str(tmp_path / "l.txt")).orderBy("ord").collect()] == [(0, "one"), (2, "two")]
    assert files.read_manifest(spark, str(tmp_path / "none")).count() == 0


def test_payload(spark):
    d = spark.createDataFrame([('{"data": "[{\\"DisplayName\\": \\"Pop\\"}]"}',), ('{"data": [{"DisplayName": "Rock"}]}',), ("broken",)], "p string")
    assert sorted(r.name for r in parse_payload(d, "p").collect()) == ["Pop", "Rock"]


def test_settings():
    s = settings.load({"SONARIUM_MIN_FIELD_CONFIDENCE": "0.7", "SONARIUM_WEIGHTS": "a=0.5,b=1", "SONARIUM_PROVIDERS": "x, local_cleanup"})
    assert s.min_field_confidence == 0.7 and s.weights == {"a": 0.5, "b": 1.0} and settings.check(s) == ["not enabled: x"]
    with pytest.raises(settings.SettingsError):
        settings.load({"SONARIUM_PAID_CAP": "many"})
    with pytest.raises(settings.SettingsError):
        settings.load({"SONARIUM_MIN_FIELD_CONFIDENCE": "2"})


def test_providers_gate_cache_and_errors(spark):
    m = spark.createDataFrame([("Ann - Song.mp3", {"genre": "House", "bpm": "130"}, False), ("b.mp3", {"title": "B", "artist": "C"}, False)], "path string, tags map<string,string>, has_cover_art boolean")
    log = spark.createDataFrame([], "provider string, cache_key string, status_code int, response_json string, created_at double")

    def fetch(request):
        raise RuntimeError("down")

    remote = providers.with_cache("remote", "paid", lambda x: x.selectExpr("path", "map('q', path) AS request"), fetch, log, 0.0, 14)
    own = providers.Provider("local_cleanup", "free", providers.local_cleanup)
    got = providers.collect_evidence(m, [own, remote], ["title", "artist"]).collect()
    assert [(r.provider, r.path, r.fields) for r in got] == [("local_cleanup", "Ann - Song.mp3", {"artist": "Ann", "title": "Song"})]
    got = providers.collect_evidence(m, [own, remote], ["title", "artist", "year"]).where("provider = 'remote'").collect()
    assert len(got) == 2 and all("error: down" in r.notes and r.confidence == 0 for r in got)
    rules = providers.rules_provider([("house", {"energy": "x"})])(m).collect()
    assert len(rules) == 1 and rules[0].fields == {"energy": "x", "mood": "energetic"}


def test_streams(spark, tmp_path):
    src, to, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string").coalesce(1).write.parquet(src)
    stream = lambda: jobs.new_rows(spark, src, "k int, v string")
    jobs.run_once(stream(), jobs.emit_once(to, "k"), check)
    assert spark.read.parquet(to).count() == 2
    spark.createDataFrame([(2, "d"), (3, "e")], "k int, v string").coalesce(1).write.mode("append").parquet(src)
    jobs.run_once(stream(), jobs.emit_once(to, "k"), check)
    assert sorted(r.k for r in spark.read.parquet(to).collect()) == [1, 2, 3]
    log = str(tmp_path / "log")
    jobs.run_once(stream(), jobs.upsert_log(log), str(tmp_path / "check2"))
    assert {r.k for r in jobs.current(spark, log, ["k"], ["v"]).collect()} == {1, 2, 3}
