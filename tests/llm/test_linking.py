import random

import pytest
from pyspark.sql import functions as F

from sonarium.llm import names, survivors, vocabulary

ONE = ["José Supu Hosjormer", "JosÃ© Supu Hosjormer", "Pepe Supu Hosjormer", "Pepe Hosjormer", "Hosjormer, J. S.", "J.S. Hosjormer", "HOSJORMER, José S.", "Hosjormer, José Supu", "jose supu hosjormer", "José_Supu Hosjormer", "José Supu Hosjomrer", "JoséSupuHosjormer", " José Supu Hosjormer", "Hosjormer José Supu", "Jos� Supu Hosjormer", "�. S. Hosjormer", "José Hosjormer-Supu"]
TWO = ["The Femvil Vilfemsol Collective", "Femvil Vilfemsol Collective", "Femvil Vilfemsol Collective, The", "the femvil vilfemsol coll.", "The Femvil Vilemsol Collective", "F. Vilfemsol Collective", "Collective Femvil Vilfemsol", "Femvil Vilfemsol Colll."]
OTHERS = ["José Kelmun Døbraji", "Maria Supu Tantreli", "The Bomgun Hønkudru Collective", "Femvil Gromislos Trio", "The Nollus Pünlurme Sound Ssytem"]

#: A further person with whom Pepe stands for José, from which the short form is learned.
LEARNED = ["José Kirfo Madulten", "Pepe Kirfo Madulten"]


def test_variants_meet_and_others_do_not(spark):
    d = spark.createDataFrame([(n,) for n in [*ONE, *ONE[:2], *TWO, *OTHERS, *LEARNED, None, "", "n/a", "Various Artists", " VARIOUS ARTISTS"]], "name string")
    linked = names.link(d)
    got = {r.name: r.entity for r in linked.collect()}
    assert set(got) == {*ONE, *TWO, *OTHERS, *LEARNED}
    assert len({got[n] for n in ONE}) == 1 and len({got[n] for n in TWO}) == 1 and len({got[n] for n in LEARNED}) == 1
    assert len({got[ONE[0]], got[TWO[0]], got[LEARNED[0]], *[got[n] for n in OTHERS]}) == 3 + len(OTHERS)
    pairs = names.pairs(linked).collect()
    assert len(pairs) == sum(len(x) * (len(x) - 1) // 2 for x in (ONE, TWO, LEARNED)) and all(p.name_a < p.name_b for p in pairs)
    assert names.link(d.limit(0)).count() == 0


def test_parts():
    assert names.normal_name("The Nollus Pünlurme Soudn System") == names.normal_name("Nollus Punlurme S.S.") == ("soundsystem", "", "nollus", "punlurme")
    assert names.normal_name("S.S. Jelkluvol") == ("person", "s", "s", "jelkluvol") and names.normal_name("Pilhasdak, S. S.") == ("person", "s", "s", "pilhasdak")
    assert names.normal_name("Bovis Kurfafon 4teet")[0] == "quartet" and names.normal_name("Cher") == ("person", "", "", "cher")


def test_prefix_loses_no_near_pair():
    import numpy as np

    rng = random.Random(4)
    people = [("person", *["".join(rng.choice("abcd") for _ in range(5)) for _ in range(3)]) for _ in range(150)]
    counts = np.zeros(names.SLOTS, np.int64)
    for p in people:
        counts[np.unique(names._slots(names.grams(*p)))] += 1
    w = names.Weights(counts, len(people))
    vectors = [dict(zip(*w.vector(*p))) for p in people]
    prefixes = [set(w.prefix(0.5, *p).tolist()) for p in people]
    for i in range(len(people)):
        for j in range(i):
            if sum(v * vectors[j].get(k, 0.0) for k, v in vectors[i].items()) >= 0.5 + 1e-6:
                assert prefixes[i] & prefixes[j]


def _people(rng, n):
    part = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(4, 7)))
    lasts = [part() for _ in range(n // 6)]
    return sorted({(part(), part(), rng.choice(lasts)) for _ in range(n)})


def _cosines(people):
    import numpy as np

    counts = np.zeros(names.SLOTS, np.int64)
    for p in people:
        counts[np.unique(names._slots(names.grams("person", *p)))] += 1
    w = names.Weights(counts, len(people))
    vectors = [dict(zip(*w.vector("person", *p))) for p in people]
    return w, {(i, j): sum(float(v) * float(vectors[j].get(k, 0.0)) for k, v in vectors[i].items()) for i in range(len(people)) for j in range(i + 1, len(people))}


@pytest.mark.parametrize("block", [2000, 7])
def test_cosine_join_against_all_pairs(spark, monkeypatch, block):
    people = _people(random.Random(5), 180)
    w, cosines = _cosines(people)
    monkeypatch.setattr(names, "STEP", 50)
    nodes = spark.createDataFrame([(i, "person", *p) for i, p in enumerate(people)], "node bigint, kind string, first string, middle string, last string")
    found = names.cosine_pairs(names.postings(nodes, spark.sparkContext.broadcast(w), 0.4), 0.4, block)
    got = {(r.a, r.b): r.cosine for r in found.collect()}
    apart = lambda a, b: (names.letters(a) ^ names.letters(b)).bit_count()
    may = lambda i, j: apart(people[i][2], people[j][2]) <= 4 or apart("".join(people[i]), "".join(people[j])) <= 2
    want = {p for p, c in cosines.items() if c >= 0.4 and may(*p)}
    assert want and set(got) == want and all(abs(got[p] - cosines[p]) < 1e-5 for p in want)
    best = names.cosine_pairs(names.postings(nodes, spark.sparkContext.broadcast(w), 0.4), 0.4, block, top_n=1)
    nearest = {p for i in range(len(people)) for p in sorted((p for p in want if i in p), key=lambda p: (-got[p], sum(p) - i))[:1]}
    assert {(r.a, r.b) for r in best.collect()} == nearest
    assert names.cosine_pairs(names.postings(nodes.limit(0), spark.sparkContext.broadcast(w), 0.4), 0.4).count() == 0


def test_no_entity_below_the_threshold(spark):
    """At the highest threshold only equal name parts are one; a name whose parts agree but whose cosine is too low is linked at a lower one."""
    d = spark.createDataFrame([("Victoria Kektis Kutabro",), ("Victoria Kektis Kutalbro",), ("victoria kektis kutabro",)], "name string")
    entities = lambda at: len({r.entity for r in names.link(d, join_at=at, link_at=0.0).collect()})
    assert entities(0.95) == 2 and entities(0.05) == 1


def test_average_linkage():
    near = lambda c: {0: c, 1: (1 - c * c) ** 0.5}
    vectors = [{0: 1.0}, near(0.9), near(0.1)]
    links = [(0, 1), (1, 2)]
    assert names.average_linkage(vectors, links, 0.35) == [0, 0, 2]
    assert len(set(names.average_linkage(vectors, links, 0.15))) == 1
    assert names.average_linkage(vectors, [], 0.0) == [0, 1, 2]
    chain = [near(1 - i / 500) for i in range(400)]
    assert len(set(names.average_linkage(chain, [(i, i + 1) for i in range(399)], 0.0))) == 1


def test_average_linkage_against_a_dense_one():
    import numpy as np

    rng = random.Random(8)
    for _ in range(20):
        n = rng.randint(2, 9)
        m = np.array([[rng.random() for _ in range(4)] for _ in range(n)])
        m /= np.linalg.norm(m, axis=1)[:, None]
        least = rng.choice([0.7, 0.85, 0.95])
        groups = [{i} for i in range(n)]
        while len(groups) > 1:
            c, i, j = max((np.mean([m[x] @ m[y] for x in a for y in b]), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if c < least:
                break
            groups[i] |= groups.pop(j)
        label = names.average_linkage([dict(enumerate(v)) for v in m.tolist()], [(i, j) for i in range(n) for j in range(i + 1, n)], least)
        assert {frozenset(i for i in range(n) if label[i] == x) for x in label} == {frozenset(g) for g in groups}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a bigint, b bigint")
    got = {r.node: r.component for r in names.components(edges).collect()}
    assert {got[i] for i in range(31)} == {0} and got[101] == 100 and len(got) == 33


CATALOG = [(1, "House"), (2, "Deep House"), (3, "Hip Hop"), (4, "R&B"), (5, "Drum & Bass"), (6, "Chamber Music"), (7, "Children's Music"), (8, "Rock 'n' Roll"), (9, "Rock"), (10, "Disco"), (11, "Classical"), (12, "Spoken Word"), (13, "Black Metal"), (14, "Jazz")]
MEANT = {"house": 1, "#House": 1, "Genre: House": 1, "House (main)": 1, "House Music": 1, "Deeep Houuse": 2, "deep-hosse": 2, "DeepHouse": 2, "Hop Hop": 3, "hiphop": 3, "rnb": 4, "R n B": 4, "D&B": 5, "Drum&Bas": 5, "Chnaber Music": 6, "chilrden's muic": 7, "R'n'R": 8, "Rock_'n'_Roll": 8, "Rock.": 9, "Klassik": 11, "spppokenword": 12, "Back Metla": 13, "jazzz": 14, "disc 32": 0, "asdf": 0, "Blorpwave": 0, "128": 0, "???": 0, "https://radio.example/slot/1": 0, "F# minor": 0}


def test_vocabulary(spark):
    c = spark.createDataFrame(CATALOG, "genre_id int, name string")
    d = spark.createDataFrame([(v,) for v in [*MEANT, None]], "v string")
    assert {r.value: r.genre_id for r in vocabulary.map_values(d, "v", c).collect()} == MEANT


def test_cases_of_fields(spark):
    c = spark.createDataFrame(CATALOG, "genre_id int, name string")
    rows = [(1, " House", "House; 'hiphop', \"asdf\""), (2, "House", "n/a"), (3, None, ""), (4, "x" * 50000, "Jazz, jazz, jazz")]
    d = spark.createDataFrame(rows, "row_id bigint, genre string, subgenre string").withColumn("value", F.lit(1))
    got = sorted((r.row_id, r.field_name, r.genre_id) for r in vocabulary.mapped_fields(d, c).collect())
    assert got == [(1, "genre", 1), (1, "subgenre", 0), (1, "subgenre", 3), (4, "genre", 0), (4, "subgenre", 14)]
    assert vocabulary.mapped_fields(d.limit(0), c).count() == 0


def test_repaired_tokens_against_all_pairs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(40)]
    tokens = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(40)]
    got = {(r.token, r.word) for r in vocabulary.repaired_tokens(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    for t in set(tokens):
        for w in set(words):
            most = min(vocabulary.allowed(t), vocabulary.allowed(w)) if min(len(t), len(w)) < 4 else max(vocabulary.allowed(t), vocabulary.allowed(w))
            if names.edits(t, w, 1) <= min(1, most):
                assert (t, w) in got
            if (t, w) in got:
                assert names.edits(t, w, 2) <= 2


def test_survivors(spark):
    cols = "row_id bigint, processed_at timestamp, artist string, title string, sources string, album string"
    rows = [
        (1, "2021-01-01", "Ann Bee", "Song (Official Video)", '{"title": "itunes", "album": "final_completion"}', "Filled"), (2, "2021-01-02", "ann bee", "SONG", '{"title": "itunes", "album": "deezer"}', "Real"),
        (3, "2021-01-03", "Ann Bee", "Song (Live)", "", None), (4, "2021-01-04", "Ann Bee", "Ch�ri", "broken", None), (5, "2021-01-04", "Ann Bee", "Chéri", None, "n/a"), (6, "2021-01-04", None, "Song", None, None),
        (7, "2021-01-05", "Ann Bee", "Song", '{"title": "a", "album": "b"}', ""),
    ]
    from datetime import datetime

    d = spark.createDataFrame([(r[0], datetime.fromisoformat(r[1]), *r[2:]) for r in rows], cols)
    ent = spark.createDataFrame([("Ann Bee", 1), ("ann bee", 1)], "name string, entity bigint")
    recs = survivors.recordings(d, ent)
    scores = spark.createDataFrame([(1, "0,5"), (2, "50.0%"), (7, " 0.500"), (4, "NEEDS_REVIEW"), (4, None)], "row_id bigint, quality_score string")
    got = sorted((r.first_row_id, r.survivor_row_id) for r in survivors.best_rows(d, recs, scores).collect())
    assert got == [(1, 7), (4, 4)]
    merged = {r.first_row_id: r for r in survivors.merged_records(d, recs, scores, ["title", "album"]).collect()}
    assert merged[1].album == "Real" and merged[1].n_rows == 3 and merged[4].album is None and merged[6].title == "Song" and len(merged) == 4
    assert survivors.best_rows(d.limit(0), recs.limit(0), scores).count() == 0


def test_scores(spark):
    d = spark.createDataFrame([("0.430",), ("0,43",), ("43.0%",), (" 0.43 ",), ("NEEDS_REVIEW",), ("",), (None,)], "s string")
    assert [None if r.q is None else float(r.q) for r in d.select(survivors.score_value(F.col("s")).alias("q")).collect()] == [0.43] * 4 + [None] * 3


def test_lost_titles_join_no_other(spark):
    titles = ["東京", "大阪", "\ufffd\ufffd", "Chéri", "Chüri", "Ch\ufffdri", "Søster", "S\ufffdster"]
    d = spark.createDataFrame([(i, "Ann", t) for i, t in enumerate(titles)], "row_id bigint, artist string, title string")
    got = {r.row_id: r.recording for r in survivors.recordings(d, spark.createDataFrame([("Ann", 1)], "name string, entity bigint")).collect()}
    assert len({got[i] for i in range(6)}) == 6 and got[6] == got[7]


def test_very_long_tokens(spark):
    c = spark.createDataFrame(CATALOG, "genre_id int, name string")
    rng = random.Random(3)
    d = spark.createDataFrame([("".join(rng.choice("abcdefgh") for _ in range(20000)),), ("Howse",)], "v string")
    assert {r.value[:5]: r.genre_id for r in vocabulary.map_values(d, "v", c).collect()}["Howse"] == 1
    other = {r.value: r.genre_id for r in vocabulary.map_values(spark.createDataFrame([("dubby",)], "v string"), "v", c, aliases={"dubby": "House"}).collect()}
    assert other == {"dubby": 1}
