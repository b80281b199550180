import random

import pytest

from sonarium.operators.packed import unpack_fields, with_values

CASES = [
    (None, None), ("", []), (" \t", []), ("one", ["one"]), ("a, b;c|d", ["a", "b", "c", "d"]), ("sad/happy / calm", ["sad/happy", "calm"]),
    ('"calm, almost still", b', ["calm, almost still", "b"]), ('"12"" snare"; piano', ['12" snare', "piano"]), ('["12\\" snare", "organ"]', ['12" snare', "organ"]),
    ("'war, remembered' / lost love", ["war, remembered", "lost love"]), ("children's day, lovers' quarrel", ["children's day", "lovers' quarrel"]),
    ("'rock 'n' roll life', 'x'", ["rock 'n' roll life", "x"]), (",a, ,b,,", ["a", "b"]), ('"", a', ["a"]), ("x\ny\tz", ["x", "y", "z"]), ("a · b", ["a", "b"]),
    ("\ue0000\ue001, 'a,b'", ["\ue0000\ue001", "a,b"]), ("a, a", ["a", "a"]), ("n/a", ["n/a"]),
]


def test_values(spark):
    d = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, v string")
    got = {r.i: r.s for r in with_values(d, "v", "s").collect()}
    assert got == {i: w for i, (_, w) in enumerate(CASES)}


def test_rows_positions_repeats_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a, b", "x", 9), (1, "a, b", "x", 9), (2, "a", None, 9)], "row_id bigint, moods string, pos string, item_text int")
    rows = sorted(tuple(r) for r in unpack_fields(d, "row_id", ["moods", "pos"]).collect())
    assert rows == [(1, "moods", 1, "a"), (1, "moods", 1, "a"), (1, "moods", 2, "b"), (1, "moods", 2, "b")]


def test_empty_table_and_long_text(spark):
    d = spark.createDataFrame([], "row_id bigint, moods string")
    assert unpack_fields(d, "row_id", ["moods"]).count() == 0
    long = spark.createDataFrame([(1, ", ".join(f"v{i}" for i in range(5000)))], "row_id bigint, moods string")
    assert unpack_fields(long, "row_id", ["moods"]).count() == 5000


def test_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        values = ["".join(rng.choice("ab ,;|/'") for _ in range(rng.randint(1, 8))).strip() or "x" for _ in range(rng.randint(1, 5))]
        packed = rng.choice([", ", ";", " | "]).join('"' + v.replace('"', '""') + '"' for v in values)
        rows.append((i, packed, values))
    d = spark.createDataFrame(rows, "i int, v string, w array<string>")
    bad = [r for r in with_values(d, "v", "s").collect() if r.s != r.w]
    assert not bad


@pytest.mark.parametrize("least,n", [(1, 1), (2, 0)])
def test_least(spark, least, n):
    d = spark.createDataFrame([(1, "a")], "row_id bigint, moods string")
    assert unpack_fields(d, "row_id", ["moods"], least).count() == n
