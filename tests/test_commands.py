import pytest

from sonarium import __main__ as command
from sonarium.operators import labels
from sonarium.session import exists, release, shared_dir, stored
from sonarium.sources import files, settings
from sonarium.streaming import jobs

REPORT = """title,artist,genre,subgenre,mood,moods,weather,season,age_group,filename,file_path,year,language,vocals,duration,bpm
Winter Road,Nora Falk,House,"Deep House; techno",Calm,"Calm, rainy",,,,Nora Falk - Winter Road.mp3,/m/A/x.mp3,2019,English,vocal,185,118
,unknown,House,,,,,,,Nora Falk - Ice.mp3,/m/B/y.mp3,2020,English,vocal,200,120
Bad,12,,,,,,,,z.mp3,z.mp3,,,,,
"""


def test_commands(spark, tmp_path):
    (tmp_path / "r.csv").write_text(REPORT)
    (tmp_path / "g.csv").write_text("name\nHouse\nDeep House\n")
    at = lambda n: str(tmp_path / n)
    assert command.main(["convert", at("r.csv"), at("rows"), "--genres", at("g.csv"), "--label", "L"], spark) == 0
    rows = {r.title: r for r in files.read_csv(spark, at("rows")).collect()}
    assert set(rows) == {"Winter Road", "Ice"} and rows["Winter Road"].tag == "Deep House,Techno,Calm,Rainy" and rows["Ice"].artist == "Nora Falk" and rows["Ice"].time == "00:03:20"
    assert command.main(["repair", at("rows"), at("r.csv"), at("fixed")], spark) == 0
    fixed = {r.title: r.tag for r in files.read_csv(spark, at("fixed")).collect()}
    assert fixed["Winter Road"] == "Techno,Calm,Rainy,All Weather,All Season,Youth/adult" and fixed["Ice"] == "Upbeat,All Weather,All Season,Youth/adult"
    assert command.main(["split", at("rows"), at("r.csv"), at("groups"), "--by", "parent"], spark) == 0
    assert {p.name for p in (tmp_path / "groups").iterdir() if p.is_dir()} == {"group=A", "group=B"}
    spark.createDataFrame([("a", 1), ("a", 2)], "path string, processed_at int").write.parquet(at("log"))
    assert command.main(["compact", at("log"), at("small"), "--force"], spark) == 0 and spark.read.parquet(at("small")).count() == 1


def test_exit_codes(spark, monkeypatch, capsys):
    assert command.main(["nothing"], spark) == 2 and command.main([], spark) == 2 and command.main(["query", "none", "/x", "/y"], spark) == 2
    monkeypatch.setenv("SONARIUM_PAID_CAP", "many")
    assert command.main(["query", "none", "/x", "/y"], spark) == 2
    monkeypatch.delenv("SONARIUM_PAID_CAP")

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(command, "query", stop)
    assert command.main(["query", "x", "/x", "/y"], spark) == 130


def test_heads_and_specifications(spark):
    assert settings.heads(" a.pb | a.txt ; b.pb|b.txt|out ;") == [{"model": "a.pb", "labels": "a.txt", "output": ""}, {"model": "b.pb", "labels": "b.txt", "output": "out"}]
    with pytest.raises(settings.SettingsError):
        settings.heads("only")
    d = spark.createDataFrame([(1, "mood: calm"), (2, "calm"), (3, "mood: calm"), (4, " ")], "ord int, label string")
    assert sorted((r.ord, r.field, r.label, r.prompt) for r in labels.specifications(d).collect()) == [(1, "mood", "calm", "a calm song"), (2, "theme", "calm", "a calm song")]


def test_stored_tables_go(spark):
    d = stored(spark.range(3), "some")
    assert d.count() == 3 and exists(spark, d._stored_at) and d._stored_at.startswith(shared_dir(spark).rstrip("/"))
    assert release(spark) >= 1 and not exists(spark, d._stored_at) and release(spark) == 0


def test_a_shared_folder_without_a_setting(monkeypatch):
    from sonarium import session

    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        applicationId, master = "app-x", "local[4]"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    own = session.shared_dir(Session())
    assert own.startswith("file://") and session.shared_dir(Session()) == own
    Context.applicationId, Context.master = "app-y", "yarn"
    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_emit_once_and_stages(spark, tmp_path):
    to, at = str(tmp_path / "out"), str(tmp_path / "in")
    body = jobs.stages(lambda b: b.withColumnRenamed("v", "key"), to=jobs.emit_once(to, "key", buckets=4))
    for rows in ([("a",), ("b",), ("a",), (None,)], [("b",), ("c",), (None,)]):
        spark.createDataFrame(rows, "v string").write.mode("append").parquet(at)
        jobs.run_once(jobs.new_rows(spark, at, "v string"), body, str(tmp_path / "check"))
    assert sorted(r.key or "" for r in spark.read.parquet(to).collect()) == ["", "a", "b", "c"]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        jobs.emit_once(str(tmp_path / "broken"), "v")(spark.createDataFrame([("a",)], "v string"), 0)
    assert len(list((tmp_path / "broken").glob("*.parquet"))) == 1
