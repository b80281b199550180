"""Queries over whole tables, held against brute force on small tables."""

import re

import pytest

from sonarium.plans import scalars


@pytest.fixture
def tables(spark, tmp_path):
    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


def _plain(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower().replace("&", " and ")).strip()


NAMES = ["Ann Bee", "Björk", "Sunn O)))", "AC/DC", "Blink-182", "Tom & Jerry", "JosÃ© Supu", "Кино", None, "", "Earth, Wind & Fire"]


def test_written_differs_on_every_name(spark, tables):
    a = [(i, n) for i, n in enumerate(NAMES)] + [(100, "Only Here"), (101, "Ólafur")]
    b = [(i, n.upper() if n and i % 2 else n) for i, n in enumerate(NAMES)] + [(2, "Sunn"), (3, "AC-DC"), (4, "Blink-183"), (102, "M83")]
    at = tables(smoke_final_completed=(a, "row_id bigint, artist string"), smoke_final_no_blanks=(b, "row_id bigint, artist string"))
    left, right = [k for k, _ in a], [k for k, _ in b]
    want = [k for k, x in a for j, y in b if j == k and _plain(x) != _plain(y)]
    want += [k for k, x in a if k not in right and _plain(x)] + [k for k, y in b if k not in left and _plain(y)]
    assert sorted(r.path for r in scalars.written_differs(spark, at).collect()) == sorted(want) == [2, 4, 100, 101, 102]


def test_release_positions_of_every_title(spark, tables):
    rows = [(i, t, str(i)) for i, t in enumerate(["Plain Song", "Été 99", "It's (Live)", "Don't Stop - Now", "JosÃ©", None, "Other One", "Straße"])]
    at = tables(smoke_final_completed=(rows, "row_id bigint, title string, track_number string"))
    got = {r.row_id: (r.track, r.disc) for r in scalars.release_positions(spark, at).collect()}
    # "Other One" is already on the first disc
    assert got == {0: ("0", 2), 1: ("1", 2), 2: ("2", 2), 3: ("3", 2), 4: ("4", 2), 5: (None, None), 6: ("1", 1), 7: ("7", 2)}
