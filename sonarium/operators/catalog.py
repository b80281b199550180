"""Genre catalogue: loading, exact and token-set lookup, normalising lists; ordered keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.text import key_genre, split_values, title_case
from sonarium.session import small


def parse_payload(df: DataFrame, column: str) -> DataFrame:
    """H-07, S-14: ``(ord, name)`` of a payload whose ``data`` is a list of entries or JSON text of one; anything else gives none."""
    entry = "array<struct<DisplayName:string>>"
    listed = F.from_json(F.get_json_object(column, "$.data"), entry)
    return df.select(F.posexplode(listed).alias("ord", "e")).select("ord", F.col("e.DisplayName").alias("name")).where(F.trim("name") != "")


def dimension(entries: DataFrame) -> DataFrame:
    """``(key, name, ord)``: the first spelling of each key of ``entries(ord, name)``."""
    d = entries.withColumn("key", key_genre(F.col("name"))).where(F.col("key") != "")
    return d.groupBy("key").agg(F.min(F.struct("ord", "name")).alias("m")).select("key", F.col("m.name").alias("name"), F.col("m.ord").alias("ord"))


def lookup(values: DataFrame, catalog: DataFrame, least: float = 0.80) -> DataFrame:
    """J-09: ``(value, name)`` of each distinct string of ``values(value)``, null where no entry fits.

    Exact keys first; of the others the entry with the largest share of common tokens, a quarter more if one key holds the
    other, from ``least`` on, the first entry on ties. The tokens are an equality join, so entries without a common token
    are never paired.
    """
    v = values.select("value").distinct().withColumn("key", key_genre(F.coalesce("value", F.lit(""))))
    exact = v.join(small(catalog.select("key", "name")), "key", "left")
    rest = exact.where(F.col("name").isNull() & (F.col("key") != "")).select("value", "key")
    tokens = lambda d: F.array_distinct(F.split(d, " "))
    a = rest.withColumn("t", tokens(F.col("key"))).withColumn("token", F.explode("t"))
    b = catalog.select(F.col("key").alias("k"), "name", "ord", tokens(F.col("key")).alias("u")).withColumn("token", F.explode("u"))
    pairs = a.join(small(b), "token").dropDuplicates(["value", "k"])
    shared = F.size(F.array_intersect("t", "u")) / F.greatest(F.size("t"), F.size("u"))
    score = shared + F.when(F.contains("key", F.col("k")) | F.contains(F.col("k"), "key"), 0.25).otherwise(0.0)
    best = pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("value").agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "name"))["name"].alias("fuzzy"))
    return exact.join(best, "value", "left").select("value", F.coalesce("name", "fuzzy").alias("name"))


def normalise_lists(df: DataFrame, key: str, column: str, catalog: DataFrame) -> DataFrame:
    """C-19: ``(key, out)``: the parts of a list as catalogue names, else in title case, one for each key in order, joined by commas."""
    parts = df.select(F.col(key), F.posexplode(split_values(F.col(column))).alias("pos", "value"))
    named = parts.join(lookup(parts, catalog), "value", "left").withColumn("name", F.coalesce("name", title_case(F.col("value"))))
    once = named.groupBy(key, key_genre(F.col("name")).alias("k")).agg(F.min(F.struct("pos", "name")).alias("m"))
    lists = once.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["name"]), ", ").alias("out"))
    return df.select(key).join(lists, key, "left").select(key, F.coalesce("out", F.lit("")).alias("out"))


def keyword_rules(df: DataFrame, key: str, text: Column, rules: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """J-10: ``(key, field, value, keyword)``: rules in order, a keyword holds where it stands anywhere in the text, the first rule that sets a field wins.

    The rules are parameters and become one array of a row, so there is no join at all.
    """
    each = [F.when(text.contains(word), F.struct(F.lit(i).alias("ord"), F.lit(word).alias("keyword"), F.lit(f).alias("field"), F.lit(v).alias("value"))) for i, (word, sets) in enumerate(rules) for f, v in sets.items()]
    hits = df.select(key, F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("r"))
    first = hits.groupBy(key, "r.field").agg(F.min(F.struct("r.ord", "r.value", "r.keyword")).alias("m"))
    return first.select(key, "field", "m.value", "m.keyword")


def fill_rules(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """C-01, C-02, C-06: ordered imputation; each rule fills its column where that is blank, and later rules see what earlier ones filled.

    Values lose their outer blanks; what no rule fills is null."""
    from sonarium.session import held

    for column, value in rules:
        df = held(df, **{column: F.coalesce(F.nullif(F.trim(column), F.lit("")), F.nullif(F.trim(value), F.lit("")))})
    return df
