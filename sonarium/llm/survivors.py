"""The best representative of each group of records that report the same recording."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sonarium.llm.garbled import LOST, Statistics, gather, no_statistics, repair
from sonarium.llm.names import fold
from sonarium.session import stored

# What a value may be written as where none was found.
MISSING = ("", "needs_review", "unknown", "n/a", "-", "none", "unknown year", "unknown key", "unknown bpm", "not listed in free sources", "embedded or not listed in free sources")
# Notes in brackets that say nothing about the version of a song.
NOISE = r"[\(\[]\s*(?:(?:official\s+)?(?:music\s+|lyrics?\s+)?video(?:\s+oficial)?|video\s+oficial|(?:official\s+)?audio|lyrics?|visuali[sz]er|hq|hd|4k|\d+\s*kbps|free\s+download)\s*[\)\]]"
FILLED = "final_completion"


def _plain(text: str) -> str:
    return re.sub(NOISE, " ", fold(text))


def title_keys(text: str | None, stats: Statistics | None = None) -> tuple[str | None, str | None]:
    """What titles of one version of a song have in common: repaired, folded, without notes on the upload; null if nothing is left.
    And the ASCII letters and digits alone, which are equal for a title and the same with its other characters lost.

    A title with lost characters is marked, and keyed by its plain ASCII letters alone.
    """
    if text is None or fold(text).strip() in MISSING:
        return None, None
    fixed = repair(text, stats or no_statistics())[0]
    bare = re.sub(r"[^a-z0-9&]+", "", re.sub(NOISE, " ", fixed.lower()))
    if LOST in fixed:
        return LOST + bare, bare
    return re.sub(r"[^\w&]+", " ", _plain(fixed)).strip() or fixed.strip(), bare


def _keys(shared):
    def keys(titles: pd.Series) -> pd.DataFrame:
        memory = {t: title_keys(t, shared.value) for t in titles.unique()}
        return pd.DataFrame([memory[t] for t in titles], columns=["key", "bare"])

    return pandas_udf(keys, "struct<key string, bare string>")


def recordings(df: DataFrame, entities: DataFrame) -> DataFrame:
    """``(row_id, recording)``: a key of artist and title version for every row; rows without artist or title get none.

    ``entities(name, entity)`` tells which spellings of an artist are one. A title with lost characters takes the key of the
    same artist's title that has the same letters otherwise, if there is just one; a title that lost all its letters stays alone
    with those that lost theirs in the same way. A hot artist is one key of the first join; adaptive execution
    splits it, and all later keys hold the title too. Wrong decodings are undone by the statistics of all titles.
    """
    keys = _keys(df.sparkSession.sparkContext.broadcast(gather(df, ["title"])))
    d = df.select("row_id", F.col("artist").alias("name"), keys("title").alias("k")).where(F.col("k.key").isNotNull())
    d = stored(d.select("row_id", "name", "k.key", "k.bare"), "titles")  # both branches below read it
    d = d.join(entities, "name").select("row_id", "entity", "key", "bare")
    lost = F.startswith("key", F.lit(LOST))
    one = F.when(F.min("key") == F.max("key"), F.min("key"))  # no title to choose where several have these letters
    known = d.where(~lost & (F.col("bare") != "")).groupBy("entity", "bare").agg(one.alias("known"))
    fixed = d.where(lost).join(known, ["entity", "bare"], "left").withColumn("key", F.coalesce("known", "key")).drop("known")
    return d.where(~lost).unionByName(fixed).select("row_id", F.struct("entity", "key").alias("recording"))


def score_value(text: Column) -> Column:
    """A share between 0 and 1 as decimal, from ``0.43``, ``0,43`` or ``43 %``; null if it is none."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    percent = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*%$", 1).try_cast("decimal(12,6)") / 100
    plain = F.regexp_extract(t, r"^([0-9]*\.?[0-9]+(?:[eE]-?[0-9]+)?)$", 1).try_cast("double").cast("decimal(12,6)")
    return F.coalesce(percent.cast("decimal(12,6)"), plain)


def ranked(df: DataFrame, scores: DataFrame) -> DataFrame:
    """``df`` with ``quality`` (decimal, -1 if missing) and ``found``, the number of fields in ``sources`` that were not filled in.

    ``scores(row_id, quality_score)`` has one row a key; should it repeat one, its highest counts.
    """
    s = scores.select("row_id", score_value(F.col("quality_score")).alias("q")).groupBy("row_id").agg(F.max("q").alias("q"))
    given = F.from_json("sources", "map<string,string>")
    found = F.size(F.filter(F.map_values(given), lambda v: v != FILLED))
    return df.join(s, "row_id", "left").withColumn("quality", F.coalesce("q", F.lit(-1).cast("decimal(12,6)"))).withColumn("found", F.greatest(F.lit(0), F.coalesce(found, F.lit(0)))).drop("q")


def best_rows(df: DataFrame, recs: DataFrame, scores: DataFrame) -> DataFrame:
    """``(first_row_id, survivor_row_id)`` of each recording reported by two rows or more.

    The survivor has the highest quality, then most fields found, then the latest ``processed_at``, then the smallest
    ``row_id``: one maximum of a struct in a partial aggregate, so a hot recording costs a map-side row per task.
    """
    d = ranked(df.select("row_id", "processed_at", "sources"), scores).join(recs, "row_id")
    order = F.struct("quality", "found", "processed_at", (-F.col("row_id")).alias("minus"))
    groups = d.groupBy("recording").agg(F.min("row_id").alias("first_row_id"), F.max(order).alias("b"), F.count(F.lit(1)).alias("n"))
    return groups.where(F.col("n") > 1).select("first_row_id", (-F.col("b.minus")).alias("survivor_row_id"))


def merged_records(df: DataFrame, recs: DataFrame, scores: DataFrame, fields: list[str]) -> DataFrame:
    """One record per recording, each field from the row that has it best: ``(first_row_id, n_rows, *fields)``.

    For each field the maximum of a composite struct (has a value, found rather than filled in, quality, time, value) in a
    single aggregation; a field that no row has is null. Rows without a recording stay records of their own.

    Four columns are about other columns or the whole row, if ``fields`` names them: ``quality_score`` is the highest that
    is a score, the latest on ties; ``sources`` has for each surviving field what the row it came from says of it;
    ``validation_status`` is that of the row that best_rows would choose, and ``missing_tags`` what that row misses and
    the record still lacks, or ``none``.
    """
    special = [f for f in ("quality_score", "sources", "validation_status", "missing_tags") if f in fields]
    plain = [f for f in fields if f not in special]
    d = ranked(df, scores).join(recs, "row_id", "left").withColumn("given", F.from_json("sources", "map<string,string>"))
    d = d.withColumn("recording", F.coalesce(F.to_json("recording"), F.concat(F.lit("#"), F.col("row_id").cast("string"))))

    def best(field: str) -> Column:
        has = F.col(field).isNotNull() & ~F.lower(F.trim(field)).isin(*MISSING)
        trusted = F.coalesce(F.try_element_at("given", F.lit(field)) != FILLED, F.lit(False))
        source = F.when(has, F.try_element_at("given", F.lit(field)))
        choice = F.struct(has.alias("has"), trusted.alias("trusted"), F.col("quality"), F.col("processed_at"), F.when(has, F.col(field)).alias("value"), source.alias("source"))
        return F.max(choice).alias(field)

    made = [best(f) for f in plain]
    if "quality_score" in special:
        score = score_value(F.col("quality_score"))
        made.append(F.max(F.when(score.isNotNull(), F.struct(score.alias("s"), F.col("processed_at"), F.col("quality_score").alias("value"))))["value"].alias("quality_score"))
    stated = [f for f in ("validation_status", "missing_tags") if f in special]
    made.append(F.max(F.struct("quality", "found", "processed_at", (-F.col("row_id")).alias("minus"), *stated)).alias("_row"))
    d = d.groupBy("recording").agg(F.min("row_id").alias("first_row_id"), F.count(F.lit(1)).alias("n_rows"), *made)
    out = {f: F.col(f)["value"] for f in plain} | {"quality_score": F.col("quality_score"), "validation_status": F.col("_row.validation_status")}
    if "sources" in special:
        said = F.map_from_arrays(F.array(*[F.lit(f) for f in plain]), F.array(*[F.col(f)["source"] for f in plain]))
        out["sources"] = F.to_json(F.map_filter(said, lambda _, v: v.isNotNull()))
    if "missing_tags" in special:
        there = [F.when(F.col(f)["value"].isNotNull(), F.lit(f)) for f in plain if f != "has_cover_art"]
        if "has_cover_art" in plain:
            there.append(F.when(F.col("has_cover_art")["value"] == "yes", F.lit("cover_art")))
        listed = F.filter(F.transform(F.split(F.coalesce("_row.missing_tags", F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: ~F.lower(x).isin(*MISSING))
        gone = F.array_except(listed, F.array(*there))
        out["missing_tags"] = F.when(F.size(gone) > 0, F.array_join(gone, "; ")).otherwise("none")
    return d.select("first_row_id", "n_rows", *[out[f].alias(f) for f in fields])
