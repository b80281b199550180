"""Free-entered values mapped to the entries of a canonical list."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.names import edits, fold
from sonarium.operators.packed import with_values
from sonarium.session import small, spread, stored

# What stands for a missing value.
MISSING = ("", "needs_review", "unknown", "n/a", "-", "null", "none")
# Names in other languages, short forms and synonyms, and the entry each means.
ALIASES = {
    "r and b": "R&B", "rhythm and blues": "R&B", "rnb": "R&B", "r n b": "R&B", "popular music": "Pop", "pop music": "Pop", "klassik": "Classical", "klassisk": "Classical",
    "clasica": "Classical", "classique": "Classical", "folkemusik": "Folk", "folk music": "Folk", "japanese pop": "J-Pop", "korean pop": "K-Pop", "psychedelic trance": "Psytrance", "psy trance": "Psytrance",
    "kammermusik": "Chamber Music", "cantautor": "Singer-Songwriter", "julemusik": "Christmas", "weihnachten": "Christmas", "xmas": "Christmas", "x mas": "Christmas",
    "kindermusik": "Children's Music", "bornemusik": "Children's Music", "kids music": "Children's Music", "ost": "Film Score", "movie score": "Film Score", "soundtrack": "Film Score",
    "filmmusik": "Film Score", "prog rock": "Progressive Rock", "prog house": "Progressive House", "country and western": "Country", "c and w": "Country",
    "d n b": "Drum & Bass", "dnb": "Drum & Bass", "d and b": "Drum & Bass", "drum n bass": "Drum & Bass", "rock and roll": "Rock 'n' Roll", "r n r": "Rock 'n' Roll", "ukg": "UK Garage", "u k garage": "UK Garage",
    "tekno": "Techno", "lofi": "Lo-Fi Hip Hop", "dnb music": "Drum & Bass", "rap": "Hip Hop",
}
#: Words that say little: they count this much where they meet nothing.
FILLERS = {"music": 0.05, "genre": 0.05, "main": 0.05, "and": 0.2, "n": 0.2, "the": 0.05}
#: Least score of the entry a value means.
LEAST = 0.7


def _tokens(text: str, camel: bool = True) -> list[str]:
    t = unicodedata.normalize("NFKC", text).strip()
    t = re.sub(r"(?i)^genre\s*:\s*|\s*\(main\)$", "", t)
    t = re.sub(r"(?<=[A-Za-z])['’](?=s\b)", "", t).replace("&", " and ")
    if camel and " " not in t.strip():
        t = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", t)
    return re.findall(r"[^\W_]+", fold(t))


def forms(text: str) -> list[list[str]]:
    """The ways to read a value as tokens: its words, and all in one; the latter not where digits or signs make it another thing."""
    words = _tokens(text)
    whole = "".join(words)
    out = [words] if words else []
    if len(words) > 1 and not any(c.isdigit() for c in whole):
        out.append([whole])
        if words[-1] == "music" and len(words) > 2:
            out.append(["".join(words[:-1])])
    return out


def deletions(token: str) -> list[str]:
    """The token with up to two characters left out (up to one for short ones): tokens within that many edits share one of these."""
    found = {token}
    layer = {token}
    for _ in range(allowed(token)):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        found |= layer
    return list(found)


def allowed(token: str) -> int:
    """Edits within which a token of that length counts as mistyped."""
    return 0 if len(token) < 3 or token.isdigit() else 1 if len(token) < 5 else 2


def _long(values: DataFrame, column: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(v, f, i, t) for v in pdf["v"] for f, tokens in enumerate(forms(v)) for i, t in enumerate(tokens)]
            yield pd.DataFrame(rows, columns=["v", "form", "pos", "token"])

    return values.select(F.col(column).alias("v")).mapInPandas(run, "v string, form int, pos int, token string")


def repaired_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(token, word, sim)``: the words of ``vocabulary(word)`` within the allowed edits of each distinct ``token``.

    Both sides are joined by equality on what remains after leaving characters out, then the distance is checked; no pair
    within the distance escapes and no cross join is needed, whatever the sizes. A token longer by more than the allowed
    edits than the longest word can meet none and is left out first.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def shortened(s: pd.Series) -> pd.Series:
        return s.map(deletions)

    @pandas_udf("double")
    def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            most = min(allowed(x), allowed(y)) if min(len(x), len(y)) < 4 else max(allowed(x), allowed(y))
            d = edits(x, y, most)
            out.append(1 - d / max(len(x), len(y)) if d <= most else 0.0)
        return pd.Series(out, dtype=float)

    longest = vocabulary.agg(F.max(F.length("word")).alias("n")).first().n or 0
    left = spread(tokens.select("token").where(F.length("token") <= longest + 2).distinct(), "token").withColumn("key", F.explode(shortened("token")))
    right = vocabulary.select("word").distinct().withColumn("key", F.explode(shortened("word")))
    pairs = left.join(small(right, 100_000), "key").select("token", "word").distinct()
    return pairs.withColumn("sim", likeness("token", "word")).where(F.col("sim") > 0)


def map_values(values: DataFrame, column: str, catalog: DataFrame, least: float = LEAST, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """``(value, genre_id, score)`` of every distinct non-missing string in ``values``; genre_id 0 and score 0 for those that mean no entry.

    Each distinct token is repaired by edit distance to the words of ``catalog(genre_id, name)`` and its aliases; complete
    entries are ranked by soft TF-IDF: the cosine of the weighted words, each pair counting by its likeness
    and each word on either side once. Ties go to the
    smallest id. A null value is left out; an empty list of entries maps all to 0. ``aliases`` are further names of entries,
    such as translations and short forms, which no spelling can show.
    """
    spark = values.sparkSession
    names = catalog.select("genre_id", F.col("name").alias("form"))
    known = spark.createDataFrame(list(aliases.items()), "form string, name string").join(catalog.select("genre_id", "name"), "name").select("genre_id", "form")
    entries = _long(names.union(known).select("form").distinct(), "form").toDF("entry", "entry_form", "entry_pos", "word")
    entries = stored(entries, "entries")
    forms_of = names.union(known).withColumnRenamed("form", "entry").groupBy("entry").agg(F.min("genre_id").alias("genre_id"))
    filler = F.expr("map(" + ", ".join(f"'{k}', {v}D" for k, v in FILLERS.items()) + ")")
    n = entries.select("entry", "entry_form").distinct().count()
    idf = entries.groupBy("word").agg((F.log(F.lit(n + 1.0) / F.count_distinct("entry", "entry_form")) + 0.1).alias("idf"))
    idf = idf.withColumn("idf", F.col("idf") * F.coalesce(F.try_element_at(filler, F.col("word")), F.lit(1.0)))
    weighed = entries.join(small(idf), "word")
    norms = weighed.groupBy("entry", "entry_form").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("entry_norm"))
    weighed = weighed.join(norms, ["entry", "entry_form"]).join(forms_of, "entry").select("entry", "entry_form", "entry_pos", "word", "idf", "entry_norm", "genre_id")

    distinct = spread(values.select(F.col(column).alias("value")).where(F.col("value").isNotNull()).distinct(), "value")
    tokens = stored(_long(distinct, "value").withColumnRenamed("v", "value"), "tokens")
    repaired = stored(repaired_tokens(tokens, entries), "repaired")
    unknown = float(np.log(n + 1.0) + 0.1)
    best = repaired.join(small(idf), "word").groupBy("token").agg(F.max(F.struct("sim", "idf")).alias("b")).select("token", F.col("b.idf").alias("token_idf"))
    weight = F.coalesce(F.col("token_idf"), F.try_element_at(filler, F.col("token")) * unknown, F.lit(unknown))
    own = tokens.join(best, "token", "left").withColumn("w", weight)
    value_norms = own.groupBy("value", "form").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("value_norm"))
    met = own.join(repaired, "token").join(small(weighed, 100_000), "word")
    key = ["value", "form", "entry", "entry_form", "genre_id", "entry_norm"]
    part = F.max(F.col("sim") * F.col("w") * F.col("idf")).alias("part")
    by_token = met.groupBy(*key, "pos").agg(part).groupBy(*key).agg(F.sum("part").alias("dot"))
    by_word = met.groupBy(*key, "entry_pos").agg(part).groupBy(*key).agg(F.sum("part").alias("dot"))
    total = by_token.unionByName(by_word).groupBy(*key).agg(F.min("dot").alias("dot"))
    scored = total.join(value_norms, ["value", "form"]).withColumn("score", F.least(F.lit(1.0), F.round(F.col("dot") / (F.col("entry_norm") * F.col("value_norm")), 9)))
    top = scored.where(F.col("score") >= least).groupBy("value").agg(F.max(F.struct("score", (-F.col("genre_id")).alias("g"))).alias("b"))
    return distinct.join(top, "value", "left").select("value", F.coalesce(-F.col("b.g"), F.lit(0)).cast("int").alias("genre_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def mapped_fields(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """``(row_id, field_name, value, genre_id, score)`` of the values of ``genre`` (one) and ``subgenre`` (packed) that are not,
    letter for letter, an entry; 0 for those that mean none. Missing values are no case; a value repeated in a row is one."""
    parts = with_values(df.select("row_id", F.col("subgenre").alias("_s")), "_s", "_v").select("row_id", F.lit("subgenre").alias("field_name"), F.explode("_v").alias("value"))
    all_ = df.select("row_id", F.lit("genre").alias("field_name"), F.col("genre").alias("value")).unionByName(parts)
    cases = all_.where(~F.lower(F.trim("value")).isin(*MISSING))
    exact = small(catalog.select(F.col("name").alias("value")).where(F.col("value").isNotNull()).distinct())
    cases = stored(cases.join(exact, "value", "left_anti").distinct(), "cases")
    return cases.join(map_values(cases, "value", catalog), "value").select("row_id", "field_name", "value", "genre_id", "score")
