"""Portal rows: best row per key, propagation, distinct identity, validity; distribution to folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.numbers import clock, seconds, tempo
from sonarium.functions.text import DAMAGE, key_filename, key_title, key_value, path_parts, safe_name, split_dashes, split_values
from sonarium.functions.validity import issues, missing, points, usable_artist, usable_genre, usable_language, usable_title
from sonarium.operators.state import first_per_key, numbered, propagated
from sonarium.session import held

#: Where rows go that no folder claims.
UNMATCHED = "_unmatched"


def _keyed(df: DataFrame) -> DataFrame:
    """``df`` with the keys that the rules compare, each computed once: of title, artist and genre, and of the pair in the file name."""
    d = held(df, _name=split_dashes(F.regexp_replace(F.col("filename"), r"\.[A-Za-z0-9]{2,4}$", "")))
    d = held(d, _tv=key_value(F.col("title")), _a=key_value(F.col("artist")), _g=key_value(F.col("genre")), _na=F.col("_name.artist"), _nt=F.col("_name.title"))
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"\blyrics?\b", " "), " +", " "))
    return held(d, _t=bare(F.col("_tv")), _nak=key_value(F.col("_na")), _ntk=key_title(F.col("_nt"))).drop("_name")


KEYS = ["_tv", "_a", "_g", "_na", "_nt", "_t", "_nak", "_ntk"]


def distinct_core(df: DataFrame) -> DataFrame:
    """C-09: an artist equal to the title gives way to the file name's, or to nothing; so does one that the file name contradicts; a genre equal to either is dropped."""
    d = _keyed(df)
    same = (F.col("_t") == F.col("_a")) & (F.col("_t") != "")
    agrees = (F.col("_na") != "") & (F.col("_t") != "") & (F.col("_ntk") == F.col("_t"))
    named = (F.col("_na") != "") & (F.col("_nak") != F.col("_t"))
    which = F.when(agrees, "name").when(same, F.when(named, "name").otherwise("none")).otherwise("own")
    d = held(d, _which=which)
    d = held(d, artist=F.when(F.col("_which") == "name", F.col("_na")).when(F.col("_which") == "none", "").otherwise(F.col("artist")), _a=F.when(F.col("_which") == "name", F.col("_nak")).when(F.col("_which") == "none", "").otherwise(F.col("_a")))
    return held(d, genre=F.when(F.col("_g").isin(F.col("_t"), F.col("_a")), "").otherwise(F.col("genre"))).drop("_which", *KEYS)


def with_points(df: DataFrame, out: str = "_points") -> DataFrame:
    """T-08: ``df`` with the points of each portal row."""
    d = _keyed(df)
    names = {c: ok(F.col(c)) for c, ok in (("title", usable_title), ("artist", usable_artist), ("genre", usable_genre), ("language", usable_language))}
    d = held(d, **{f"_ok_{c}": F.coalesce(v, F.lit(False)) for c, v in names.items()})
    t, a, fa = F.col("_tv"), F.col("_a"), F.col("_nak")
    begins = lambda x: (x != "") & ((t == x) | F.startswith(t, F.concat(x, F.lit(" "))))
    prefixed = begins(a) | begins(fa)
    rules = {f"has_{c}": (F.trim(c) != "", 5) for c in ("album", "tempo", "filename", "year", "label", "tag")}
    rules |= {
        "title": (F.col("_ok_title"), 10), "no_title": (~F.col("_ok_title"), -80), "artist": (F.col("_ok_artist"), 10), "no_artist": (~F.col("_ok_artist"), -60),
        "genre": (F.col("_ok_genre"), 10), "no_genre": (~F.col("_ok_genre"), -50), "language": (F.col("_ok_language"), 5), "no_language": (~F.col("_ok_language"), -20),
        "time": (seconds(F.col("time")) > 0, 15), "voice": (F.col("vocal").isin("0", "1") & F.col("instrumental").isin("0", "1") & (F.col("vocal") != F.col("instrumental")), 10),
        "prefixed": (prefixed, -25), "clean": (~prefixed, 25), "same_artist": ((a != "") & (a == fa), 20), "same_title": ((F.col("_nt") != "") & (F.col("_t") == F.col("_ntk")), 20),
    }
    return held(d, **{out: points(**rules)}).drop(*KEYS, *[f"_ok_{c}" for c in names])


def portal_issues(d: DataFrame) -> Column:
    """P-14: why a portal row is not valid; empty if it is."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    pair = F.col("vocal").isin("0", "1") & F.col("instrumental").isin("0", "1") & (F.col("vocal") != F.col("instrumental"))
    year = F.when(F.col("year").rlike(r"^\d{1,9}$"), F.col("year").try_cast("int"))
    return issues(**{
        "duration not resolved": ~(F.coalesce(seconds(F.col("time")), F.lit(0)) > 0), "title invalid": ~usable_title(F.col("title")), "artist invalid": ~usable_artist(F.col("artist")),
        "genre invalid": ~usable_genre(F.col("genre")), "language invalid": ~usable_language(F.col("language")), **{f"{c} missing": blank(F.col(c)) for c in ("tempo", "year", "vocal", "instrumental")},
        "year invalid": ~blank(F.col("year")) & ~F.coalesce(year.between(1900, 2100), F.lit(False)), "tempo invalid": ~blank(F.col("tempo")) & tempo(F.col("tempo")).isNull(),
        "vocal/instrumental invalid": ~pair,
    })


def factual_issues(d: DataFrame) -> Column:
    """P-15: what of a portal row is not verified, and which of its fields contradict each other or show a wrong decoding."""
    said = {f"{c} not verified": missing(F.col(c)) for c in ("title", "album", "artist", "genre", "filename", "year", "language", "label", "tag")}
    for c, ok in (("title", usable_title), ("artist", usable_artist), ("genre", usable_genre), ("language", usable_language)):
        said[f"{c} not verified"] = said[f"{c} not verified"] | ~ok(F.col(c))
    signs = lambda c: F.col(c).rlike("|".join(DAMAGE))
    said |= {f"{c} contains unresolved encoding damage": signs(c) for c in ("title", "album", "artist", "filename", "label")}
    t, a, g = key_title(F.col("title")), key_value(F.col("artist")), key_value(F.col("genre"))
    said["title and artist are not distinct"] = (t != "") & (t == a)
    said["genre conflicts with track identity"] = (g != "") & g.isin(t, a)
    return issues(**said)


def identity(df: DataFrame) -> Column:
    """T-07: title, artist, genre and the sorted set of tags, by their keys."""
    tags = F.array_sort(F.array_distinct(F.filter(F.transform(split_values(F.col("tag")), key_value), lambda x: x != "")))
    return F.struct(key_value(F.col("title")).alias("t"), key_value(F.col("artist")).alias("a"), key_value(F.col("genre")).alias("g"), tags.alias("tags"))


def convert(d: DataFrame, strict: bool = True) -> DataFrame:
    """Portal rows (portal.portal_rows) to those that go out: the best row of each file name (earliest on ties), the first genre of a song for all its rows,
    one row an identity, and then, if ``strict``, only valid ones. A row that is dropped as invalid still suppresses its twins."""
    d = with_points(held(d, _key=key_filename(F.col("filename"))))
    best = d.where(F.col("_key") != "").groupBy("_key").agg(F.min("seq").alias("_group"), F.max(F.struct("_points", (-F.col("seq")).alias("o"), *[c for c in d.columns if c[0] != "_" and c != "seq"])).alias("b"))
    d = best.select(F.col("_group").alias("seq"), *[F.col(f"b.{c}").alias(c) for c in d.columns if c[0] != "_" and c != "seq"])
    d = held(d, _song=F.concat_ws("::", key_title(F.col("title")), key_value(F.col("artist"))))
    d = propagated(d, "_song", ["seq"], "genre", "genre", exempt="::").drop("_song")
    d = first_per_key(held(d, _id=identity(d)), ["_id"], ["seq"]).drop("_id")
    return d.where(F.size(portal_issues(d)) == 0) if strict else d


def round_robin(tagged: DataFrame, groups: DataFrame, key: str, order: str, group: str, keep_unmatched: bool = True) -> DataFrame:
    """J-04: the i-th row of a key gets the i-th of that key's groups, turning over; rows without one get ``_unmatched`` or are left out.

    Rows are ranked within their key, a hot one in blocks; a group's turn is the rank modulo the number of groups, an equality join on (key, turn).
    """
    g = numbered(groups.select(key, F.col(order).alias("_o"), F.col(group).alias("_g")), [key], "_o", "_turn").withColumn("_turn", F.col("_turn") - 1).drop("_o")
    n = g.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    d = numbered(tagged, [key], order, "_rank").join(n, key, "left").withColumn("_turn", ((F.col("_rank") - 1) % F.col("_n")).cast("int"))
    d = d.join(g, [key, "_turn"], "left").withColumn(group, F.coalesce("_g", F.lit(UNMATCHED))).drop("_rank", "_n", "_turn", "_g")
    return d if keep_unmatched else d.where(F.col(group) != UNMATCHED)


def folder_group(path: Column, root: Column, by: str = "top") -> Column:
    """F-13: the top or parent folder of a path below ``root``, the root it begins with (null if none)."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    group = path_parts(F.when(root.isNotNull(), F.substr(p, F.length(root) + 1)).otherwise(p))[by]
    return F.when(group == "", UNMATCHED).otherwise(safe_name(group))


def write_groups(df: DataFrame, group: str, to: str) -> None:
    """K-11, T-15: one folder a group, replaced as a whole; groups that are not in ``df`` keep theirs.

    Rows are brought together by group, small groups in one task, a hot one over several (a rebalance that adaptive execution sizes).
    """
    df.withColumn("group", safe_name(F.col(group))).hint("rebalance", "group").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group").option("header", True).csv(to)


def converter_counters(rows: DataFrame, converted: DataFrame) -> DataFrame:
    """A-08: one row: rows read, distinct file names, rows written."""
    a = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key_filename(F.col("filename"))).alias("files"))
    return a.crossJoin(converted.agg(F.count(F.lit(1)).alias("written"))).withColumn("duplicates", F.col("rows") - F.col("files"))


def clock_text(c: Column) -> Column:
    """M-02 for a text: normalised ``hh:mm:ss``."""
    return clock(F.coalesce(seconds(c), F.lit(0)))
