"""Blocked matching against brute force over all pairs that share a token."""

import random
import re
from difflib import SequenceMatcher

import pytest

from sonarium.functions.text import BRACKETS, MATCH_NOISE
from sonarium.operators import matching

WORDS = ["the", "moon", "river", "no", "at", "night", "a", "blue", "radio", "song", "song", "(live)", "ii", "&"]


def _key(t):
    t = re.sub(MATCH_NOISE, " ", re.sub(BRACKETS, " ", (t or "").lower()))
    return re.sub("[^a-z0-9]+", " ", t.replace("&", " and ")).strip()


def _similar(a, b):
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return max(0.7, min(len(a), len(b)) / max(len(a), len(b)))
    return SequenceMatcher(None, a, b).ratio()


def _tables(n, seed):
    r = random.Random(seed)

    def wrong(t):
        i = r.randrange(len(t))
        return r.choice([t, t, t[:i] + t[i + 1:], t[:i] + r.choice("aexz ") + t[i:], t + " remix", t.upper()])

    titles = [" ".join(r.choices(WORDS, k=r.randint(1, 6))) for _ in range(n // 3)] + ["Été", "Кино", "", "x " * 60, "the"]
    artists = ["Ann Bee", "Anna Beem", "Bob", "The Bobs", "Кино", "", None, "Ólaf", "Tom & Jerry", "Zz Top (live)", "aab bba"]
    row = lambda i: (i, wrong(t) if (t := r.choice(titles)) else t, wrong(x) if (x := r.choice(artists)) else x)
    return [row(i) for i in range(n)], [row(i) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_row_gets_the_best_of_all_pairs(spark, seed):
    left, right = _tables(150, seed)
    words = lambda k: set(k.split())
    want = {}
    for i, t, a in left:
        for j, u, b in right:
            if words(_key(t)) & words(_key(u)):
                x, y = _similar(_key(t), _key(u)), _similar(_key(a), _key(b)) if a else 0.65
                if x >= 0.55 and y >= 0.45:
                    want[i] = max(want.get(i, (0, 0)), (0.60 * x + 0.40 * y, -j))
    d = [spark.createDataFrame(x, "id int, title string, artist string") for x in (left, right)]
    got = {x.l_id: (round(x.score, 9), x.r_id) for x in matching.match_blocked(*d, "id", "id", "title", "artist").collect()}
    assert got == {i: (round(s, 9), -j) for i, (s, j) in want.items()} and 50 < len(got) < 150


def test_pairs_are_not_shuffled(spark):
    """A token that all rows hold makes a pair of each two of them; only rows with their tokens may be exchanged."""
    rows = [(i, f"the {i:05x}", f"name {i}") for i in range(3000)]
    d = spark.createDataFrame(rows, "id int, title string, artist string")
    m = matching.match_blocked(d, d, "id", "id", "title", "artist")
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    groups = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert not any("r_title" in g or "rt#" in g for g in groups)
    assert m.where("l_id = r_id and score = 1").count() == 3000
