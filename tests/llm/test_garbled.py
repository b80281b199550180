import pytest

from sonarium.llm import garbled

GOOD = ["Kærlighed", "CORAÇÃO DE VERÃO", "ÂNGULO", "½ Moon ½ Mule", "Жёлтый фонарь", "Ô Marée", "夜の自転車", "Łódź o Świcie", "Sigríður", "Ten € Tango", "It’s “Quiet” – yes", "Đêm Ở Phố Cũ", "What?", "", "SÃO LUÍS À NOITE", "Naïve Façade", "Renéée", "Příliš Mnoho Měsíců", "Γεια σου"]


def _bad(text, encoding):
    out = []
    for b in text.encode():
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("encoding", [e for e in garbled.ENCODINGS if e not in ("iso8859_15", "koi8_r")])
def test_round_trip(encoding):
    for t in ("Kærlighed", "Übermut", "Renée Stovek", "Corazón de Cañón", "Łódź o Świcie", "Жёлтый фонарь", "夜の自転車", "It’s Only Röntgen", "CORAÇÃO DE VERÃO"):
        assert garbled.repair(_bad(t, encoding), garbled.no_statistics()) == (t, True), (t, encoding)
    assert garbled.repair(_bad(_bad("Kærlighed på Øen", "cp1252"), "cp1252"), garbled.no_statistics()) == ("Kærlighed på Øen", True)


def test_good_text_stays():
    for t in GOOD:
        assert garbled.repair(t, garbled.no_statistics()) == (t, False), t


def test_partly_lost_and_single_byte():
    assert garbled.repair("Hj�rtat", garbled.no_statistics()) == ("Hj�rtat", True)
    assert garbled.repair("Jürgen sÃ¸gte", garbled.no_statistics()) == ("Jürgen søgte", True)
    assert garbled.repair("Ïîåçä íà ñåâåð", garbled.no_statistics()) == ("Поезд на север", True)


def test_segments():
    import numpy as np

    assert garbled.segments(np.array([-1.0, 2, 3, -1, 2, -9, 4])) == [(1, 5), (6, 7)]
    assert garbled.segments(np.array([])) == []


def _statistics(texts):
    """What gather counts in texts that are correct, without a table."""
    from collections import Counter

    place, chars = garbled._alphabet()
    pairs = Counter()
    for t in texts:
        codes = [int(place[ord(c)]) for c in garbled.EDGE + t + garbled.EDGE]
        pairs.update(a * len(chars) + b for a, b in zip(codes, codes[1:]))
    return garbled.Statistics(sorted(pairs), [pairs[p] for p in sorted(pairs)])


def test_the_corpus_decides():
    """One shape of bytes: two signs that stand for a letter where the corpus has that letter, and for themselves where it has them."""
    shape = "MAÇÃ®"
    french = _statistics(["MAÇîMAÇîM", "maître", "île", "chaîne d'août"] * 200)
    brands = _statistics(["CORAÇÃO", "MAÇÃ", "FÉ®", "AÇAÍ®", "MAÇÃ ®", "IRMÃ®"] * 200)
    assert garbled.repair(shape, french) == ("MAÇî", True)
    assert garbled.repair(shape, brands) == (shape, False)
    assert garbled.improbable(shape, french) and not garbled.improbable("CORAÇÃO", brands)


def test_counts_decide_between_readings():
    bad = _bad("Ωραία", "mac_roman")
    greek = _statistics(["Ωραία νύχτα", "Γεια σου"] * 50)
    assert garbled.repair(bad, greek) == ("Ωραία", True)
    assert garbled.repair(_bad("Kærlighed", "iso8859_15"), _statistics(["Kærlighed", "Fødselsdag", "Når æblerne falder"] * 50)) == ("Kærlighed", True)


def test_each_pair_has_a_count_of_its_own(spark):
    texts = ["".join(chr(0x100 + (i * 7 + j) % 300) for j in range(12)) for i in range(300)]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    stats = garbled.gather(d, ["t"])
    want = _statistics([t for t in texts if not garbled._ambiguous().search(t)])
    assert set(want.pairs) <= set(stats.pairs) and len(stats.pairs) <= len(garbled._alphabet()[1]) ** 2
    assert stats.n >= want.n


def test_held_out_restoration(spark):
    """Correct values of the test table, read wrongly: restored to the originals, by statistics of other rows."""
    import os
    import random

    path = "/root/testdata/sf0.001/smoke_final_completed.parquet"
    if not os.path.isdir(path) and not os.path.isfile(path):
        pytest.skip("no test tables")
    d = spark.read.parquet(path)
    stats = garbled.gather(d.where("row_id % 2 = 0"), ["title", "artist", "album"])
    rows = d.where("row_id % 2 = 1").select("title", "artist", "album").collect()
    values = sorted({v for r in rows for v in r if v and not v.isascii() and not garbled._ambiguous().search(v)})
    random.Random(1).shuffle(values)
    assert not any(garbled.repair(v, stats)[1] for v in values[:300])
    for encoding in ("cp1252", "cp437", "mac_roman", "cp1251", "cp850", "cp1254", "cp1253"):
        right = sum(garbled.repair(_bad(v, encoding), stats) == (v, True) for v in values[:100])
        assert right >= 0.95 * len(values[:100]), (encoding, right)


def test_tables(spark):
    rows = [(i, t, None) for i, t in enumerate(GOOD)] + [(100, "RenÃ©e", "x"), (101, None, "CafÃ©"), (100, "RenÃ©e", "x"), (102, "abc " * 20000 + "Ã¸", None)]
    d = spark.createDataFrame(rows, "row_id bigint, title string, restored string")
    stats = garbled.gather(d, ["title", "restored"])
    got = sorted((r.row_id, r.field_name) for r in garbled.repaired(d, "row_id", ["title", "restored"], stats).collect())
    assert got == [(100, "title"), (100, "title"), (101, "restored"), (102, "title")]
    j = spark.createDataFrame([(1, '{"title": "Ren\\u00c3\\u00a9e'), (2, '{"title": "Ren\\u00e9e"}')], "scan_id bigint, tags_json string")
    assert [(r.scan_id, r.restored) for r in garbled.repaired(j, "scan_id", ["tags_json"], stats).collect()] == [(1, '{"title": "Renée')]
    assert garbled.repaired(d.limit(0), "row_id", ["title"], garbled.gather(d.limit(0), ["title"])).count() == 0
    col = garbled.repair_column(d.where("row_id = 100"), "title", "fixed", stats).collect()
    assert {r.fixed for r in col} == {"Renée"}
