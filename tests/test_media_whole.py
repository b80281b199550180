from difflib import SequenceMatcher

from sonarium.plans import evidence, fusion


def test_every_suffix(spark, tmp_path):
    paths = [f"/m/x{s}" for s in evidence.MEDIA_SUFFIXES] + ["/m/X.FLAC", "/m/_loop/x.m4a", "/m/x.txt", "/m/mp3"]
    spark.createDataFrame([(p,) for p in paths], "path string").write.parquet(str(tmp_path / "media_inventory.parquet"))
    assert {r.path for r in evidence.media_scan(spark, str(tmp_path)).collect()} == set(paths[:9])


def test_languages(spark, tmp_path):
    texts = [(1, "Kærlighed, hvad STADIG?"), (2, "Hva med kjærlighet"), (3, "och inte jag"), (4, "dig"), (5, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.da, r.no, r.sv, r.language) for r in evidence.marker_language(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, 0, "da"), 2: (0, 2, 0, "no"), 3: (0, 0, 3, "sv"), 4: (1, 0, 1, ""), 5: (0, 0, 0, "")}


def test_reports_against_all_pairs(spark, tmp_path):
    a = [(1, "blue moon", "ann"), (2, "red river", "bob"), (3, "green hill", "zed"), (4, "lone", "")]
    b = [(10, "blue mood", "ann"), (11, "moon of blue", "anne"), (12, "red", "xyz"), (13, "red rivers", "bobby"), (14, "hill", "q"), (15, "lone star", "kim")]
    for name, rows in (("smoke_final_completed", a), ("smoke_final_no_blanks", b)):
        spark.createDataFrame(rows, "row_id bigint, title string, artist string").write.parquet(str(tmp_path / f"{name}.parquet"))

    def sim(x, y):
        return 0.0 if not x or not y else max(0.7, min(len(x), len(y)) / max(len(x), len(y))) if x in y or y in x else SequenceMatcher(None, x, y).ratio()

    want = {}
    for i, t, n in a:
        scored = [(0.6 * sim(t, u) + 0.4 * s, -j) for j, u, m in b if set(t.split()) & set(u.split()) for s in [sim(n, m) if n else 0.65] if sim(t, u) >= 0.55 and s >= 0.45]
        if scored:
            want[i] = (-max(scored)[1], round(max(scored)[0], 6))
    assert {r.row_id: (r.match_id, r.score) for r in fusion.match_reports(spark, str(tmp_path)).collect()} == want and 3 not in want
