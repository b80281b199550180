"""Fusion of candidate values from many sources by weighted confidence votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.numbers import clamp
from sonarium.functions.text import key_plain, key_vote
from sonarium.schema import TAG_FIELDS
from sonarium.session import held, small

#: Weight of a source without one, and what the file's own tags vote.
DEFAULT_WEIGHT, OWN_WEIGHT, OWN = 0.5, 0.76, "existing_file_tag"


def weighted(evidence: DataFrame, weights: DataFrame) -> DataFrame:
    """J-01: ``evidence`` with ``weight``, its confidence times its provider's weight, between 0 and 1; 0.5 for unknown providers."""
    w = small(weights.groupBy("provider").agg(F.max("weight").alias("_w")))
    return evidence.join(w, "provider", "left").withColumn("weight", clamp(F.col("confidence") * F.coalesce("_w", F.lit(DEFAULT_WEIGHT)))).drop("_w")


def ballots(media: DataFrame, evidence: DataFrame, weights: DataFrame, fields: list[str] = TAG_FIELDS) -> DataFrame:
    """A-01, first half: ``(path, field, value, source, weight, seq)``, one row a vote, the file's own tags first (seq 0).

    ``media(path, tags)`` and ``evidence(path, seq, provider, confidence, fields)``. Blank values and other fields do not
    vote; values are brought to the form they count for. A provider that reports twice votes twice.
    """
    own = media.select("path", F.explode("tags").alias("field", "raw"), F.lit(OWN).alias("source"), F.lit(OWN_WEIGHT).alias("weight"), F.lit(0).alias("seq"))
    given = weighted(evidence, weights).select("path", F.explode("fields").alias("field", "raw"), F.col("provider").alias("source"), "weight", "seq")
    votes = own.unionByName(given).where(F.col("field").isin(*fields) & (F.trim("raw") != ""))
    return votes.select("path", "field", key_vote(F.col("field"), F.col("raw")).alias("value"), "source", "weight", "seq")


def tally(votes: DataFrame, entity: str = "path", precise: bool = False) -> DataFrame:
    """A-01, A-04: ``(entity, field, value, score, first_seq, sources)``: votes summed per value.

    Sums, minima and sets are partial aggregates, so a hot entity is combined before the shuffle. ``precise`` adds the
    weights in order of seq instead, for sums equal to the last bit; it holds the votes of one value in one list.
    """
    total = F.sum("weight")
    if precise:
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("seq", "weight"))), F.lit(0.0), lambda s, x: s + x["weight"])
    return votes.groupBy(entity, "field", "value").agg(total.alias("score"), F.min("seq").alias("first_seq"), F.array_sort(F.collect_set("source")).alias("sources"))


def winners(tallied: DataFrame, entity: str = "path", least: float = 0.0) -> DataFrame:
    """A-02: ``(entity, field, value, score, landed, sources)``: the highest score wins, the first seen on ties, the score capped at 1."""
    best = F.max(F.struct("score", (-F.col("first_seq")).alias("order"), "value", F.array_join("sources", ", ").alias("sources"))).alias("b")
    w = tallied.groupBy(entity, "field").agg(best)
    score = F.least(F.col("b.score"), F.lit(1.0).cast(tallied.schema["score"].dataType))
    return w.select(entity, "field", "b.value", score.alias("score"), (score >= least).alias("landed"), "b.sources")


def with_own_tags(won: DataFrame, media: DataFrame) -> DataFrame:
    """A-03: a value that did not land gives way to the file's own tag, as it is written, at a confidence of at least 0.70."""
    own = media.select("path", F.explode("tags").alias("field", "raw")).where(F.col("raw") != "")
    d = won.join(own, ["path", "field"], "left")
    keep = ~F.col("landed") & F.col("raw").isNotNull()
    return d.select(
        "path", "field",
        F.when(F.col("landed"), F.col("value")).when(keep, F.col("raw")).alias("value"),
        F.when(keep, F.greatest(F.col("score"), F.lit(0.70))).otherwise(F.col("score")).alias("confidence"),
        F.when(F.col("landed"), F.col("sources")).when(keep, F.lit(OWN)).alias("sources"),
    )


def conflicts(tallied: DataFrame, entity: str = "path", most: int = 4) -> DataFrame:
    """A-05: ``(entity, field, n_keys, note)`` of the fields whose values differ after normalisation; the note lists the top values."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "first_seq", "value")))
    d = tallied.withColumn("k", F.nullif(key_plain(F.col("value")), F.lit(""))).groupBy(entity, "field").agg(F.count_distinct("k").alias("n_keys"), listed.alias("l"))
    text = F.array_join(F.transform(F.slice("l", 1, most), lambda x: F.format_string("%s (%.2f)", x["value"], (-x["s"]).cast("double"))), ", ")
    return d.where(F.col("n_keys") > 1).select(entity, "field", "n_keys", F.concat(F.lit("conflict on "), F.col("field"), F.lit(": "), text).alias("note"))


def missing_required(required: list[str], fields: Column, tags: Column, has_cover: Column) -> Column:
    """P-01: the required fields that neither the merged fields nor the tags have; cover_art is there with a cover or its address."""
    blank = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit("")) == ""
    rest = F.array(*[F.lit(r) for r in required if r != "cover_art"])
    gone = F.filter(rest, lambda r: blank(fields, r) & blank(tags, r))
    if "cover_art" in required:
        gone = F.concat(gone, F.when(~has_cover & blank(fields, F.lit("cover_art_url")), F.array(F.lit("cover_art"))).otherwise(F.array().cast("array<string>")))
    return gone


def writable(fields: Column, confidence: Column, tags: Column, least: float) -> Column:
    """P-06: the merged fields that differ from the tag after N1 and are sure enough to be written."""
    return F.map_filter(fields, lambda k, v: (v != "") & (key_plain(F.coalesce(F.try_element_at(tags, k), F.lit(""))) != key_plain(v)) & (F.coalesce(F.try_element_at(confidence, k), F.lit(0.0)) >= least))


def written_differs(intended: DataFrame, found: DataFrame) -> DataFrame:
    """P-07: ``(path, field, intended, found)`` where a re-read tag is not what was written; years by their first four characters."""
    d = intended.withColumnRenamed("value", "intended").join(found.withColumnRenamed("value", "found"), ["path", "field"], "full_outer")
    a, b = F.coalesce("intended", F.lit("")), F.coalesce("found", F.lit(""))
    same = F.when(F.col("field") == "year", F.substring(a, 1, 4) == F.substring(b, 1, 4)).otherwise(key_plain(a) == key_plain(b))
    return d.where(~same)


def overlay(tags: Column, fields: Column) -> Column:
    """R-04: ``{**tags, **fields}`` without null maps."""
    empty = F.create_map().cast("map<string,string>")
    t, f = F.coalesce(tags, empty), F.coalesce(fields, empty)
    return F.map_concat(F.map_filter(t, lambda k, v: ~F.map_contains_key(f, k)), f)


def provider_overlay(media: DataFrame, evidence: DataFrame, fields: list[str], least: float = 0.60) -> DataFrame:
    """R-03: ``media`` with its tags overlaid by the named fields of sure results, the later result winning."""
    sure = evidence.where(F.col("confidence") >= least).select("path", "seq", F.explode("fields").alias("field", "value")).where(F.col("field").isin(*fields) & (F.col("value") != ""))
    last = sure.groupBy("path", "field").agg(F.max(F.struct("seq", "value"))["value"].alias("value"))
    maps = last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_over"))
    return media.join(maps, "path", "left").withColumn("tags", overlay(F.col("tags"), F.col("_over"))).drop("_over")


def merge(media: DataFrame, evidence: DataFrame, weights: DataFrame, least: float, required: list[str]) -> DataFrame:
    """One row per file: merged fields, their confidence and sources, providers, missing fields and notes (A-01 to A-06, A-18, P-01)."""
    tallied = tally(ballots(media, evidence, weights), precise=True)
    won = with_own_tags(winners(tallied, least=least), media)
    entry = lambda v: F.struct("field", F.col(v).alias("v"))
    kept = F.col("value").isNotNull()
    per = won.groupBy("path").agg(
        F.map_from_entries(F.collect_list(F.when(kept, entry("value")))).alias("fields"), F.map_from_entries(F.collect_list(entry("confidence"))).alias("field_confidence"),
        F.map_from_entries(F.collect_list(F.when(kept, entry("sources")))).alias("field_sources"), F.avg("confidence").alias("quality"),
    )
    used = evidence.where(F.size("fields") > 0).groupBy("path").agg(F.array_sort(F.collect_set("provider")).alias("providers_used"))
    notes = conflicts(tallied).groupBy("path").agg(F.array_sort(F.collect_list("note")).alias("notes"))
    none = F.array().cast("array<string>")
    empty = F.create_map().cast("map<string,string>")
    d = media.select("path", "tags", "has_cover_art").join(per, "path", "left").join(used, "path", "left").join(notes, "path", "left")
    d = d.withColumns({"providers_used": F.coalesce("providers_used", none), "notes": F.coalesce("notes", none), "fields": F.coalesce("fields", empty)})
    gone = missing_required(required, F.col("fields"), F.coalesce("tags", empty), F.col("has_cover_art"))
    return d.select("path", "fields", "field_confidence", "field_sources", F.coalesce("quality", F.lit(0.0)).alias("quality_score"), "providers_used", gone.alias("missing_required"), "notes")


def merge_rows(media: DataFrame, weights: DataFrame, least: float, required: list[str], most: int = 4) -> DataFrame:
    """``merge`` where each file's row holds its ``evidence``, an array of (seq, provider, confidence, fields) in order of seq.

    The votes of a file are counted within its row, so nothing is shuffled and other columns of ``media`` are kept. For evidence of many
    rows a file, in tables of its own, there is ``merge``.
    """
    known = weights.where(F.col("provider").isNotNull()).groupBy("provider").agg(F.max("weight").alias("w"))
    known = known.agg(F.map_from_entries(F.collect_list(F.struct("provider", "w"))).alias("_weights"))  # one row
    empty = F.create_map().cast("map<string,string>")
    votes_of = lambda fields: F.filter(F.map_entries(F.coalesce(fields, empty)), lambda e: e["key"].isin(*TAG_FIELDS) & (F.trim(e["value"]) != ""))
    vote = lambda field, raw, source, weight, seq: F.struct(field.alias("field"), key_vote(field, raw).alias("value"), source.alias("source"), weight.alias("weight"), seq.alias("seq"))
    weight = lambda x: clamp(x["confidence"] * F.coalesce(F.try_element_at("_weights", x["provider"]), F.lit(DEFAULT_WEIGHT)))
    given = F.flatten(F.transform("evidence", lambda x: F.transform(votes_of(x["fields"]), lambda e: vote(e["key"], e["value"], x["provider"], weight(x), x["seq"]))))
    d = held(media.crossJoin(F.broadcast(known)), _given=given).drop("_weights")

    def counted(mine, value):
        same = F.filter(mine, lambda v: v["value"] == value)
        score = F.aggregate(same, F.lit(0.0), lambda s, v: s + v["weight"])
        sources = F.array_join(F.array_sort(F.array_distinct(F.transform(same, lambda v: v["source"]))), ", ")
        return F.struct(score.alias("score"), (-F.array_min(F.transform(same, lambda v: v["seq"]))).alias("order"), value.alias("value"), sources.alias("sources"))

    def of_field(field):
        raw = F.try_element_at("tags", field)
        own = F.when(F.trim(raw) != "", F.array(vote(field, raw, F.lit(OWN), F.lit(OWN_WEIGHT), F.lit(0))))
        given = F.filter("_given", lambda v: v["field"] == field)
        # of one array, so that the votes of a field are picked once
        return F.get(F.transform(F.array(F.coalesce(F.concat(own, given), given)), lambda m: F.struct(field.alias("field"), F.transform(F.array_distinct(F.transform(m, lambda v: v["value"])), lambda x: counted(m, x)).alias("values"))), F.lit(0))

    d = held(d, _tallied=F.transform(F.array_distinct(F.transform("_given", lambda v: v["field"])), of_field)).drop("_given")
    best = F.transform("_tallied", lambda t: F.struct(t["field"].alias("field"), F.array_max(t["values"]).alias("b"), F.nullif(F.try_element_at("tags", t["field"]), F.lit("")).alias("raw")))

    def landed(w):
        score = F.least(w["b"]["score"], F.lit(1.0))
        sure = score >= least
        keep = ~sure & w["raw"].isNotNull()
        return F.struct(
            w["field"].alias("field"), F.when(sure, w["b"]["value"]).when(keep, w["raw"]).alias("value"), F.when(keep, F.greatest(score, F.lit(0.70))).otherwise(score).alias("confidence"),
            F.when(sure, w["b"]["sources"]).when(keep, F.lit(OWN)).alias("sources"),
        )

    # a field that no provider reports has one vote, its tag
    alone = F.filter(votes_of(F.col("tags")), lambda e: ~F.exists("_tallied", lambda t: t["field"] == e["key"]))
    tag = lambda e: key_vote(e["key"], e["value"]) if least <= OWN_WEIGHT else e["value"]
    alone = F.transform(alone, lambda e: F.struct(e["key"].alias("field"), tag(e).alias("value"), F.lit(OWN_WEIGHT).alias("confidence"), F.lit(OWN).alias("sources")))
    d = held(d, _won=F.concat(alone, F.transform(best, landed)))
    kept = F.filter("_won", lambda w: w["value"].isNotNull())
    entries = lambda of, v: F.map_from_entries(F.transform(of, lambda w: F.struct(w["field"], w[v])))
    sums = F.aggregate("_won", F.lit(0.0), lambda s, w: s + w["confidence"])
    used = F.array_sort(F.array_distinct(F.transform(F.filter("evidence", lambda x: F.size(x["fields"]) > 0), lambda x: x["provider"])))
    d = held(d, fields=entries(kept, "value"), field_sources=F.when(F.size("_won") > 0, entries(kept, "sources")), quality_score=F.when(F.size("_won") > 0, sums / F.size("_won")).otherwise(0.0))

    def note(t):
        listed = F.slice(F.array_sort(F.transform(t["values"], lambda v: F.struct((-v["score"]).alias("s"), (-v["order"]).alias("first_seq"), v["value"].alias("value")))), 1, most)
        return F.concat(F.lit("conflict on "), t["field"], F.lit(": "), F.array_join(F.transform(listed, lambda x: F.format_string("%s (%.2f)", x["value"], -x["s"])), ", "))

    differ = F.filter("_tallied", lambda t: F.size(F.array_distinct(F.filter(F.transform(t["values"], lambda v: key_plain(v["value"])), lambda k: k != ""))) > 1)
    rest = [c for c in media.columns if c not in ("path", "tags", "evidence")]
    return d.select(
        "path", "fields", F.when(F.size("_won") > 0, entries("_won", "confidence")).alias("field_confidence"), "field_sources", "quality_score", used.alias("providers_used"),
        missing_required(required, F.col("fields"), F.coalesce("tags", empty), F.col("has_cover_art")).alias("missing_required"), F.array_sort(F.transform(differ, note)).alias("notes"), *rest,
    )
