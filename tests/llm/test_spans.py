import random

import numpy as np

from sonarium.llm import parsing, spans


def brute(docs, least):
    where = {}
    for k, t in docs.items():
        for i in range(len(t or "") - least + 1):
            where.setdefault(t[i : i + least], set()).add(k)
    out = {}
    for k, t in docs.items():
        hit = np.zeros(len(t or ""), bool)
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                hit[i : i + least] = True
        if hit.any():
            out[k] = int(hit.sum())
    return out


def _found(spark, docs):
    d = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id bigint, text string, begin int").repartition(3)
    return {r.doc_id: r.shared_chars for r in spans.shared_chars(spans.shared_spans(d, "doc_id", "text", 200)).collect()}


def _random(rng, n, letters="abcdefghij klmnop"):
    return "".join(rng.choice(letters) for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(7)
    passages = [_random(rng, n) for n in (199, 200, 201, 260, 700)] + ["夜" * 30 + _random(rng, 190), "ab" * 150, "x" * 350, "=" * 90 + _random(rng, 100) + "-" * 60]
    docs = {}
    for k in range(120):
        parts = [_random(rng, rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.choice([0, 0, rng.randint(0, 40)])
            parts += [p[a : len(p) - rng.choice([0, 0, rng.randint(0, 40)])], _random(rng, rng.randint(0, 120))]
        docs[k] = "".join(parts)
    docs |= {200: None, 201: "", 202: " " * 500, 203: " " * 300, 204: "y" * 1000, 205: "y" * 199, 206: passages[4] + passages[4]}
    assert _found(spark, docs) == brute(docs, 200)


def test_repeats_in_low_entropy_text(spark):
    rng = random.Random(8)
    docs = {k: _random(rng, rng.randint(150, 900), "ab") if k % 2 else ("abc" * 300)[rng.randint(0, 5) : rng.randint(300, 800)] for k in range(40)}
    assert _found(spark, docs) == brute(docs, 200)


def test_copies_and_empty(spark):
    rng = random.Random(9)
    t = _random(rng, 400)
    assert _found(spark, {1: t, 2: t, 3: t[:250]}) == {1: 400, 2: 400, 3: 250}
    assert _found(spark, {1: t}) == {}
    d = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_spans(d, "doc_id", "text").count() == 0 and spans.shared_spans(d, "doc_id", "text", 30).count() == 0


def test_short_spans_against_brute_force(spark):
    rng = random.Random(12)
    passages = [_random(rng, 45) for _ in range(6)]
    docs = {k: "".join(_random(rng, rng.randint(0, 60)) + rng.choice(passages)[rng.randint(0, 9) :] for _ in range(rng.randint(0, 4))) for k in range(60)} | {100: None, 101: "", 102: "z" * 80, 103: "z" * 31}
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id: r.shared_chars for r in spans.shared_chars(spans.shared_spans(d, "doc_id", "text", 30)).collect()}
    assert got == brute(docs, 30) and got[102] == 80 and got[103] == 31


def test_hashes_differ_by_base():
    codes, _ = parsing.flatten(["abba" * 40])
    at = np.arange(100)
    assert (parsing.Windows(codes, 1).hash(at, at + 20) != parsing.Windows(codes, 2).hash(at, at + 20)).all()


def test_hot_passage_over_many_batches(spark, monkeypatch):
    rng = random.Random(10)
    p = _random(rng, 300)
    docs = {k: _random(rng, 50) + (p if k % 3 == 0 else "") + _random(rng, 250) for k in range(300)}
    got = _found(spark, docs)
    assert got == brute(docs, 200)


def test_parse_is_locally_consistent():
    rng = random.Random(11)
    for _ in range(20):
        w = _random(rng, 400)
        ends = []
        for _ in range(2):
            a, b = _random(rng, rng.randint(1, 200)), _random(rng, 100)
            codes, _s = parsing.flatten([a + w + b])
            at = parsing.boundaries(codes) - len(a)
            ends.append({x for x in at if parsing.CONTEXT <= x <= 400 - parsing.CONTEXT})
            assert np.diff(at).max() <= parsing.GAP
        assert ends[0] == ends[1]
