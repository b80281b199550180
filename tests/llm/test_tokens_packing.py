import random

import pytest
from pyspark.sql import functions as F

from sonarium.llm import packing, tokens

TEXTS = [None, "", " ", "\n\n  x  \r\n", "Hello world's end  ", "Größe naïve café", "夜の自転車に乗って" * 40, "a" * 9000, "<|endoftext|>", "��", "x\u0000y", ("word " * 3000) + "  end", "１２３ ½ №", "é" * 50 + " " * 300 + "z"]


def test_ids_and_back(spark):
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(TEXTS)] + [(1, "", "k")], "doc_id bigint, text string, ids string")
    got = tokens.encode_column(d, "doc_id", "text").collect()
    assert len(got) == len(TEXTS) + 1 and all(r.ids == [] for r in got if r.doc_id in (0, 1))
    enc = tokens.encoding()
    for r in got:
        assert r.ids == (enc.encode_ordinary(TEXTS[r.doc_id]) if TEXTS[r.doc_id] else [])
    back = {r.doc_id: r.text for r in tokens.decode_column(tokens.encode_column(d, "doc_id", "text"), "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    counts = {r.doc_id: r.n_tokens for r in tokens.count_column(d, "doc_id", "text").collect()}
    assert counts == {r.doc_id: len(r.ids) for r in got}
    assert tokens.encode_column(d.limit(0), "doc_id", "text").count() == 0


def test_same_as_the_other_library():
    tk = pytest.importorskip("tokenizers")
    t = tk.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for x in TEXTS:
        if x:
            assert tokens.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids


def test_parts_do_not_change_ids():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("ab'1. \n\té夜 ") for _ in range(rng.randint(1, 400)))
        cut = tokens.parts(text, rng.randint(1, 40))
        assert "".join(cut) == text
        assert [i for p in cut for i in tokens.encoding().encode_ordinary(p)] == tokens.encoding().encode_ordinary(text)


def _check(rows, sizes, capacity, most_items=10**9):
    fill, count, parts = {}, {}, {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        count[r.container_id] = count.get(r.container_id, 0) + 1
        parts.setdefault(r.doc_id, []).append((r.part_no, r.token_start, r.n_tokens))
    assert all(v <= capacity for v in fill.values()) and all(v <= most_items for v in count.values())
    assert set(parts) == set(sizes)
    for k, p in parts.items():
        p.sort()
        assert sum(x[2] for x in p) == sizes[k] and [x[0] for x in p] == list(range(1, len(p) + 1))
        assert all(x[1] == capacity * i for i, x in enumerate(p)) and (len(p) == 1 or sizes[k] > capacity)
    return len(fill)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_pack(spark, rule):
    rng = random.Random(2)
    sizes = {i: rng.choice([0, 0, 7, rng.randint(1, 100), rng.randint(1, 100), 250]) for i in range(600)}
    d = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens int")
    n = _check(packing.pack(d, "doc_id", 100, 40, rule=rule).collect(), sizes, 100, 40)
    assert n <= 1.05 * sum(sizes.values()) / 100 + 20


def test_pack_edges(spark):
    d = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id bigint, n_tokens int")
    assert _check(packing.pack(d, "doc_id", 10, 2).collect(), {1: 0, 2: 0, 3: 0}, 10, 2) == 2
    assert packing.pack(d.limit(0), "doc_id", 10).count() == 0
    r = packing.packing_report(packing.pack(d, "doc_id", 10), 10).first()
    assert (r.containers, r.pieces, r.tokens) == (1, 3, 0)
    same = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(5).alias("n_tokens"))
    assert _check(packing.pack(same, "doc_id", 10).collect(), {i: 5 for i in range(1000)}, 10) == 500
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10, 5, 100)


def test_cost_is_a_constraint():
    for first, times, content in packing.plan({5: 9, 3: 7, 1: 20}, 10, 100, 40):
        assert sum(s * k for s, k in content) <= 10 and sum(s * s * k for s, k in content) <= 40


def test_every_constraint_binds(spark, monkeypatch):
    rng = random.Random(9)
    sizes = {i: rng.choice([0, 1, 2, 45, 60, rng.randint(1, 70), 250]) for i in range(900)}
    d = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens int")
    monkeypatch.setattr(packing, "NUMBERED", 50)
    packed = packing.pack(d, "doc_id", 200, 6, 70**2)
    r = packing.packing_report(packed, 200).first()
    assert r.most_pieces == 6 and 0.9 * 70**2 < r.highest_cost <= 70**2 and r.tokens == sum(sizes.values())
    parts = {}
    for x in packed.collect():
        parts.setdefault(x.doc_id, []).append((x.part_no, x.token_start, x.n_tokens))
    for i, p in parts.items():
        assert sum(x[2] for x in p) == sizes[i] and (len(p) == 1) == (sizes[i] <= 70)
