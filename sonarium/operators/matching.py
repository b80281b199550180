"""Fuzzy matching of candidates: hypotheses, similarity, plausibility and ranking."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.functions.text import clean_track, key_match, split_pair
from sonarium.operators import similar
from sonarium.session import held, small, spread, stored


def candidate_pairs(filename: Column, title: Column, artist: Column, album: Column, most: int = 4) -> Column:
    """F-07: up to ``most`` distinct (artist, title) hypotheses of a file, from its tags first, then from its name."""
    t, a, b = clean_track(title), clean_track(artist), clean_track(album)
    name, own = split_pair(clean_track(filename)), split_pair(t)
    pair = lambda x, y: F.struct(clean_track(x).alias("artist"), clean_track(y).alias("title"))
    hypotheses = F.array(
        pair(a, t), pair(name["artist"], name["title"]), pair(F.when(own["artist"] != "", own["artist"]).otherwise(a), own["title"]),
        pair(a, b), pair(F.lit(""), F.when(name["title"] != "", name["title"]).otherwise(t)),
    )
    return F.slice(F.array_distinct(F.filter(hypotheses, lambda p: p["title"] != "")), 1, most)


def search_texts(pairs: Column) -> Column:
    """F-07: the distinct search texts of hypotheses, case ignored."""
    from sonarium.functions.text import distinct_values

    return distinct_values(F.transform(pairs, lambda p: F.trim(F.concat_ws(" ", p["artist"], p["title"]))), F.lower)


def containment(a: Column, b: Column) -> Column:
    """F-14, built-in part: 0 if either key is blank, max(0.7, shorter/longer) if one holds the other, else null."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(F.contains(a, b) | F.contains(b, a), F.greatest(F.lit(0.70), shorter / longer))


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    memory = {}
    for pair in set(zip(a, b)):
        memory[pair] = None if pair[0] is None else SequenceMatcher(None, *pair).ratio()
    return pd.Series([memory[pair] for pair in zip(a, b)], dtype=float)


def with_similarity(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """F-14: ``df`` with the similarity of two text columns: containment in the JVM, the matching-blocks ratio for the rest.

    The rest goes through an Arrow UDF, whose arguments are null where containment decides; equal pairs of a batch are compared once.
    """
    d = held(df, _a=key_match(F.coalesce(F.col(a), F.lit(""))), _b=key_match(F.coalesce(F.col(b), F.lit(""))))
    return _of_keys(d, "_a", "_b", out).drop("_a", "_b")


def _of_keys(d: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``with_similarity`` of two columns that hold keys."""
    d = held(d, _known=containment(F.col(a), F.col(b)))
    open_ = F.col("_known").isNull()
    ratio = F.pandas_udf(_ratio, "double")(F.when(open_, F.col(a)), F.when(open_, F.col(b)))
    return d.withColumn(out, F.coalesce(F.col("_known"), ratio)).drop("_known")


def _letters(s: pd.Series) -> pd.DataFrame:
    """A key's signs as bits of two words, one for each sign's first, second and third occurrence, and how many signs have no bit."""
    signs = {c: i for i, c in enumerate(" abcdefghijklmnopqrstuvwxyz0123456789")}

    def one(key):
        places = [37 * k + signs[c] for c in set(key) for k in range(min(3, key.count(c)))]
        return sum(1 << p for p in places), len(key) - len(places)

    known = {k: one(k) for k in set(s)}
    words = np.array([(known[k][0] & 2**64 - 1, known[k][0] >> 64) for k in s], np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"x": words[:, 0], "y": words[:, 1], "n": [float(len(k)) for k in s], "more": [float(known[k][1]) for k in s]})


def measured(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the bits and the length of some keys: the columns ``_x``, ``_y``, ``_n`` and ``_more`` after each name."""
    letters = F.pandas_udf(_letters, "x bigint, y bigint, n double, more double")
    d = df.select("*", *[letters(k).alias(f"_of_{k}") for k in keys])
    return d.select(*df.columns, *[F.coalesce(F.col(f"_of_{k}.{c}"), F.lit(0).cast(kind)).alias(f"{k}_{c}") for k in keys for c, kind in (("x", "bigint"), ("y", "bigint"), ("n", "double"), ("more", "double"))])


def most_similar(a: str, b: str) -> Column:
    """An upper bound of the similarity of two measured keys that are not blank, by their lengths and signs.

    Matching blocks are made of signs of both. One key holds the other only if it has all its signs. The expression stays small, as
    the code of a join's condition is not compiled when it is long.
    """
    bits = [F.bit_count(F.col(f"{a}_{w}").bitwiseAND(F.col(f"{b}_{w}"))).cast("double") for w in "xy"]
    common = bits[0] + bits[1] + F.least(f"{a}_more", f"{b}_more")
    return F.greatest(2.0 * common / (F.col(f"{a}_n") + F.col(f"{b}_n")), F.when(common >= F.least(f"{a}_n", f"{b}_n"), F.lit(0.70)).otherwise(F.lit(0.0)))


def plausible(title: Column, artist: Column, least_title: float = 0.55, least_artist: float = 0.45) -> Column:
    """P-12, P-20: whether both similarities are high enough."""
    return (title >= least_title) & (artist >= least_artist)


def best_candidates(df: DataFrame, entity: str, weights: tuple[float, float] = (0.60, 0.40), order: str = "seq") -> DataFrame:
    """T-01: of each entity's plausible candidates (``title_score``, ``artist_score``) the one with the highest weighted score, the first on ties."""
    score = weights[0] * F.col("title_score") + weights[1] * F.col("artist_score")
    kept = df.where(plausible(F.col("title_score"), F.col("artist_score"))).withColumn("score", score)
    rest = [c for c in kept.columns if c not in (entity, "score", order)]
    top = kept.groupBy(entity).agg(F.max(F.struct("score", (-F.col(order)).alias("o"), *rest)).alias("b"))
    return top.select(entity, (-F.col("b.o")).alias(order), *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b.score").alias("score"))


def recording_score(api: Column, title: Column, artist: Column) -> Column:
    """T-02: 0.45 of the provider's own score and 0.55 of title and artist similarity; between 0.40 and 0.98."""
    return F.least(F.lit(0.98), F.greatest(F.lit(0.40), 0.45 * api + 0.55 * (0.60 * title + 0.40 * artist)))


def best_release(releases: Column) -> Column:
    """T-03: of an array of (similarity, official, dated, ...) structs the greatest, the first on ties."""
    return F.array_max(F.transform(releases, lambda r, i: F.struct(r["similarity"], r["official"], r["dated"], (-i).alias("order"), r.alias("release"))))["release"]


#: Pairs of keys that one cell of a token's grid holds; how similar the titles are of the pairs that are compared first.
CELL, CLOSE = 2**24, 0.75


def _token_pairs(l: DataFrame, r: DataFrame, able: Column) -> DataFrame:
    """The ``able`` pairs of left and right keys whose titles share a token, once for each such token.

    An equality join on the token, whose condition sees numbers only. A token that makes many pairs is split into a grid of cells.
    """
    tokens = lambda d, c: d.withColumn("token", F.explode(F.array_distinct(F.split(c, " "))))
    certain = lambda d: d.select(*[F.coalesce(c, F.lit(0).cast(kind)).alias(c) if kind in ("double", "bigint") and c != "rid" else c for c, kind in d.dtypes])
    l, r = tokens(certain(l), "_t"), tokens(certain(r), "rt")
    count = lambda d, c: d.groupBy("token").agg(F.count(F.lit(1)).alias(c))
    side = F.ceil(F.sqrt(F.col("_nl") * F.col("_nr") / CELL)).cast("int")
    grid = small(stored(count(l, "_nl").join(count(r, "_nr"), "token").select("token", side.alias("_side")).where("_side > 1"), "match_grid"))

    def cells(d, own, other, *key):
        d = d.join(grid, "token", "left").withColumn("_side", F.coalesce("_side", F.lit(1)))
        d = d.withColumn(own, F.pmod(F.xxhash64(*key), F.col("_side")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_side") - 1)))
        return spread(d.drop("_side"), "token", "_blank", "_row", "_column")

    return cells(l, "_row", "_column", "_t", "_a").hint("shuffle_hash").join(cells(r, "_column", "_row", "rt", "ra"), ["token", "_blank", "_row", "_column"]).where(able)


def match_blocked(left: DataFrame, right: DataFrame, left_id: str, right_id: str, title: str, artist: str) -> DataFrame:
    """J-05: for each left row the best plausible right row, both with ``title`` and ``artist``, the smallest id on ties.

    Candidates share a token of the title's key. Keys that repeat are compared once, the right ones with their smallest id. Nothing
    scores higher than equal keys, so those are one equality join. For the other left keys candidates are an equality join on
    tokens, and a pair is compared only if its lengths, its letters and its common subsequences allow a plausible score that no other
    pair beats. The pairs whose titles may be close go first and give all others the score to reach. Pairs are never shuffled.
    """
    key = lambda c: key_match(F.coalesce(F.col(c), F.lit("")))
    keyed = lambda d, *cols: held(d.select(*cols, title, artist), _t=key(title), _a=key(artist)).where(F.col("_t") != "")
    blank = F.coalesce(F.col(artist), F.lit("")) == ""
    # a left artist that has signs but no key is like none; so an empty key is that of a blank artist
    rows = keyed(left, left_id).where(blank | (F.col("_a") != "")).withColumn("_a", F.when(blank, F.lit("")).otherwise(F.col("_a")))
    r = stored(keyed(right, right_id).groupBy("_t", "_a").agg(F.min(F.struct(right_id, title, artist)).alias("r")), "match_right")
    # the right rows of each artist, and for left rows without one the first of each title
    best_of = r.where(F.col("_a") != "").unionByName(r.groupBy("_t").agg(F.min("r").alias("r")).select("_t", F.lit("").alias("_a"), "r"))
    found = stored(rows.select("_t", "_a").distinct().join(best_of, ["_t", "_a"], "left"), "match_left")
    flat, weights, floors = 0.65, (0.60, 0.40), (0.55, 0.45)
    equal = found.where(F.col("r").isNotNull()).select("_t", "_a", "r", F.lit(1.0).alias("title_score"), F.when(F.col("_a") == "", flat).otherwise(1.0).alias("artist_score"))

    rest = stored(measured(found.where(F.col("r").isNull()).select("_t", "_a", (F.col("_a") == "").alias("_blank")), "_t", "_a"), "match_rest")
    other = best_of.select(F.col("_t").alias("rt"), F.col("_a").alias("ra"), (F.col("_a") == "").alias("_blank"), F.col(f"r.{right_id}").alias("rid"))
    other = stored(measured(other, "rt", "ra"), "match_other")
    total = lambda t, a: weights[0] * t + weights[1] * a

    def best(pairs):
        scores = similar.best_pairs(pairs.select("_t", "_a", "_least", "rt", "ra", "rid"), weights, floors, flat)
        one = F.struct(total(F.col("title_score"), F.col("artist_score")).alias("score"), (-F.col("rid")).alias("o"), "rt", "ra", "title_score", "artist_score")
        return scores.groupBy("_t", "_a").agg(F.max(one).alias("b"))

    t, a = most_similar("_t", "rt"), F.when(F.col("_a_n") == 0, F.lit(flat)).otherwise(most_similar("_a", "ra"))
    able = (t >= F.col("_need")) & (a >= floors[1]) & (total(t, a) >= F.col("_least"))
    close = stored(best(_token_pairs(rest.withColumn("_least", F.lit(0.0)).withColumn("_need", F.lit(CLOSE)), other, able)), "match_close")
    reached = rest.join(close.select("_t", "_a", F.col("b.score").alias("_least")), ["_t", "_a"], "left")
    reached = reached.withColumn("_least", F.coalesce("_least", F.lit(0.0)) - similar.SLACK).withColumn("_need", F.lit(floors[0]))
    won = best(_token_pairs(reached, other, able)).unionByName(close).groupBy("_t", "_a").agg(F.max("b").alias("b")).select("_t", "_a", "b.*")
    won = won.join(best_of.select(F.col("_t").alias("rt"), F.col("_a").alias("ra"), "r"), ["rt", "ra"]).select("_t", "_a", "r", "title_score", "artist_score")
    won = equal.unionByName(won).withColumn("score", total(F.col("title_score"), F.col("artist_score")))
    rows = rows.select(F.col(left_id).alias("l_" + left_id), F.col(title).alias("l_" + title), F.col(artist).alias("l_" + artist), "_t", "_a")
    return rows.join(won, ["_t", "_a"]).select("l_" + left_id, *[F.col(f"r.{c}").alias("r_" + c) for c in (right_id, title, artist)], "title_score", "artist_score", "score", "l_" + title, "l_" + artist)


def ranked(df: DataFrame, key: list[str], order: list, most: int = 1) -> DataFrame:
    """T-04, T-08, T-10, T-13: the first ``most`` rows of each key by ``order``, by a window; ``most`` is the operator's meaning, not a cap."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
