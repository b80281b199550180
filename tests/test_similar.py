"""Bounds of similarities, and how few pairs of keys are compared with them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from sonarium.operators import matching, similar
from tests.test_blocked import _key, _similar, _tables


def _keys(n):
    r = random.Random(5)
    signs = "abcde 12 aaee"
    made = ["".join(r.choices(signs, k=r.choice([1, 3, 9, 20, 63, 64, 65, 90]))).strip() or "a" for _ in range(n)]
    return [*made, *[k[1:-1].strip() or "b" for k in made[:20]], *[k[: len(k) // 2].strip() or "c" for k in made[:20]], "aaaaaaaa", "aaaa"]


def test_bounds_are_never_less(spark):
    keys = _keys(60)
    pairs = [(i, j) for i in range(len(keys)) for j in range(len(keys))]
    rows = [(i, j, keys[i], keys[j]) for i, j in pairs]
    d = matching.measured(spark.createDataFrame(rows, "i int, j int, a string, b string"), "a", "b")
    letters = {(x.i, x.j): x.m for x in d.select("i", "j", matching.most_similar("a", "b").alias("m")).collect()}
    found = similar.bounds(keys, np.array([i for i, _ in pairs]), keys, np.array([j for _, j in pairs]))
    for (i, j), bound in zip(pairs, found):
        s = similar.similarity(keys[i], keys[j])
        assert s == _similar(keys[i], keys[j]) and bound >= s and letters[i, j] >= s - 1e-12
    assert similar.bounds(["abc", ""], np.array([0, 1]), ["xyz"], np.array([0, 0])).tolist() == [0.0, 0.0]


def test_few_pairs_are_compared(monkeypatch):
    """A left key and 4,000 right ones that share a token: what a better pair beats is not compared."""
    r = random.Random(3)
    name = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    right = [(f"the {name(9)}", f"{name(5)} {name(8)}") for _ in range(4000)] + [("the harvest moon", "anna bell"), ("harvest moon", "ann bell")]
    calls, real = [], similar.similarity
    monkeypatch.setattr(similar, "similarity", lambda a, b: calls.append(1) or real(a, b))
    t, a = zip(*right)
    x = pa.RecordBatch.from_pydict({"_t": ["the harvest moon"] * len(t), "_a": ["ann bell"] * len(t), "_least": [0.0] * len(t), "rt": list(t), "ra": list(a), "rid": list(range(len(t)))})
    out = list(similar.best_of_batches((0.60, 0.40), (0.55, 0.45), 0.65)([x]))[0].to_pydict()
    best = max(range(len(out["rid"])), key=lambda i: 0.60 * out["title_score"][i] + 0.40 * out["artist_score"][i])
    assert out["rt"][best] == "the harvest moon" and len(calls) < 40


@pytest.mark.parametrize("seed", [3])
def test_cells_of_hot_tokens(spark, monkeypatch, seed):
    """The same best rows if each token's pairs are split into many cells."""
    monkeypatch.setattr(matching, "CELL", 40)
    left, right = _tables(120, seed)
    want = {}
    for i, t, a in left:
        for j, u, b in right:
            if set(_key(t).split()) & set(_key(u).split()):
                x, y = _similar(_key(t), _key(u)), _similar(_key(a), _key(b)) if a else 0.65
                if x >= 0.55 and y >= 0.45:
                    want[i] = max(want.get(i, (0, 0)), (0.60 * x + 0.40 * y, -j))
    d = [spark.createDataFrame(x, "id int, title string, artist string") for x in (left, right)]
    got = {x.l_id: (round(x.score, 9), x.r_id) for x in matching.match_blocked(*d, "id", "id", "title", "artist").collect()}
    assert got == {i: (round(s, 9), -j) for i, (s, j) in want.items()} and len(got) > 40
