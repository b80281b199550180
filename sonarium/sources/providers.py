"""Sources of evidence behind one interface: tables, built-in rules, and plug-ins with a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.functions.text import clean_track, content_key, squeeze, split_pair
from sonarium.functions.validity import missing
from sonarium.operators.state import cached
from sonarium.operators.votes import missing_required, overlay
from sonarium.session import held

EVIDENCE = ["path", "seq", "stage", "provider", "confidence", "fields", "notes"]


@dataclass(frozen=True)
class Provider:
    """G-01: a name, a stage, whether it is usable, and ``enrich(media) -> evidence(path, confidence, fields, notes)``.

    A provider that needs nothing but the row itself also has ``answer(media)``, which is ``media`` with ``_answer``, a struct
    of (confidence, fields, notes), null where it has none."""

    name: str
    stage: str
    enrich: Callable[[DataFrame], DataFrame]
    configured: bool = True
    answer: Callable[[DataFrame], DataFrame] | None = None


def in_rows(name: str, stage: str, answer: Callable[[DataFrame], DataFrame]) -> Provider:
    """A provider that answers from the row itself."""
    return Provider(name, stage, lambda media: answer(media).where(F.col("_answer").isNotNull()).select("path", "_answer.*"), answer=answer)


def _answered(d: DataFrame, confidence: float, notes: str) -> DataFrame:
    """``d`` with ``_answer`` of its map ``_found``, none where that is empty."""
    return d.withColumn("_answer", F.when(F.size("_found") > 0, F.struct(F.lit(confidence).alias("confidence"), F.col("_found").alias("fields"), F.lit(notes).alias("notes")))).drop("_found")


def usable(providers: Iterable[Provider], names: list[str]) -> list[Provider]:
    """P-04: the named providers that are configured, in the order of the names."""
    by = {p.name: p for p in providers if p.configured}
    return [by[n] for n in names if n in by]


def from_table(name: str, stage: str, table: DataFrame) -> Provider:
    """A provider whose answers are rows of a table ``(path, confidence, fields, notes)``."""
    return Provider(name, stage, lambda media: media.select("path").join(table, "path"))


def cleanup_answers(media: DataFrame) -> DataFrame:
    """R-13: artist and title parsed from the file name where the tags lack them, else the title without noise."""
    tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    d = held(media, _t=tag("title"), _a=tag("artist"), _p=split_pair(clean_track(F.col("path"))), _c=clean_track(tag("title"), stem=False))
    artist = F.when(missing(F.col("_a")), F.col("_p.artist")).otherwise(F.lit(""))
    title = F.when(missing(F.col("_t")), F.col("_p.title")).when(F.col("_c") != squeeze(F.col("_t")), F.col("_c")).otherwise(F.lit(""))
    d = held(d, _found=F.map_filter(F.create_map(F.lit("title"), title, F.lit("artist"), artist), lambda _, v: v != ""))
    return _answered(d.drop("_t", "_a", "_p", "_c"), 0.70, "parsed from names")


def local_cleanup(media: DataFrame) -> DataFrame:
    """R-13 as evidence."""
    return in_rows("local_cleanup", "free", cleanup_answers).enrich(media)


def rules_answers(rules: list[tuple[str, dict[str, str]]]) -> Callable[[DataFrame], DataFrame]:
    """C-06, J-10: fields inferred from genre, album and title by ordered keyword rules, and from the tempo."""

    def answer(media: DataFrame) -> DataFrame:
        tag = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
        text = F.lower(F.concat_ws(" ", *[F.nullif(tag(k), F.lit("")) for k in ("genre", "subgenre", "album", "title")]))
        d = held(media, _text=text, _bpm=F.when(tag("bpm").rlike(r"^\d{1,9}$"), tag("bpm").try_cast("int")))
        # the first rule that sets a field wins
        first = [x for f in dict.fromkeys(f for _, sets in rules for f in sets) for x in (F.lit(f), F.coalesce(*[F.when(F.col("_text").contains(w), F.lit(sets[f])) for w, sets in rules if f in sets]))]
        hits = F.map_filter(F.create_map(*first).cast("map<string,string>"), lambda _, v: v.isNotNull())
        fast = F.when(F.col("_bpm") >= 125, F.create_map(F.lit("energy"), F.lit("high"), F.lit("mood"), F.lit("energetic"))).when(F.col("_bpm") <= 80, F.create_map(F.lit("energy"), F.lit("low"), F.lit("mood"), F.lit("calm")))
        d = held(d, _found=hits)
        return _answered(held(d, _found=overlay(fast, F.col("_found"))).drop("_text", "_bpm"), 0.88, "inferred")

    return answer


def rules_provider(rules: list[tuple[str, dict[str, str]]]) -> Callable[[DataFrame], DataFrame]:
    """C-06, J-10 as evidence."""
    return in_rows("rules_inference", "web", rules_answers(rules)).enrich


def with_cache(name: str, stage: str, requests: Callable[[DataFrame], DataFrame], fetch: Callable[[dict], dict | None], log: DataFrame, now: float, ttl_days: float, least: float = 0.6) -> Provider:
    """S-12, S-13, G-03, R-10: a provider of remote answers: cached ones by a join, the misses through ``fetch``, one Arrow batch at a time.

    ``requests(media)`` gives ``(path, request map)``. An answer is ``{"confidence", "fields", "notes"}``; an exception
    becomes a row with confidence 0 and its message in the notes, and no row is lost.
    """

    def enrich(media: DataFrame) -> DataFrame:
        asked = requests(media).withColumn("provider", F.lit(name)).withColumn("cache_key", content_key("request"))
        found = cached(asked, log, F.lit(now), ttl_days * 86400)
        shape = "struct<confidence:double,fields:map<string,string>,notes:string>"
        hits = found.where(F.col("response").isNotNull()).select("path", F.from_json("response", shape).alias("r")).select("path", "r.*")

        def run(batches):
            for pdf in batches:
                rows = []
                for path, request in zip(pdf["path"], pdf["request"]):
                    try:
                        got = fetch(dict(request)) or {}
                        rows.append((path, float(got.get("confidence", 0.0)), dict(got.get("fields") or {}), str(got.get("notes", ""))))
                    except Exception as e:  # noqa: BLE001
                        rows.append((path, 0.0, {}, f"error: {e}"))
                yield pd.DataFrame(rows, columns=["path", "confidence", "fields", "notes"])

        misses = found.where(F.col("response").isNull()).select("path", "request").mapInPandas(run, "path string, confidence double, fields map<string,string>, notes string")
        return hits.unionByName(misses)

    return Provider(name, stage, enrich)


def collect_evidence(media: DataFrame, providers: list[Provider], required: list[str]) -> DataFrame:
    """U-01, P-02, R-04, R-10: evidence of all providers in order; those of the ``web`` and ``paid`` stages see only files that still miss a required field.

    The gate is a filter before the source, never a condition inside it: complete files do not reach it at all.
    """
    out = None
    state = media.withColumn("_now", F.col("tags"))
    for seq, p in enumerate(providers, 1):
        part = state.withColumn("tags", F.col("_now"))
        if p.stage in ("web", "paid"):
            none = F.create_map().cast("map<string,string>")
            part = part.where(F.size(missing_required(required, F.col("tags"), none, F.coalesce("has_cover_art", F.lit(False)))) > 0)
        got = p.enrich(part.drop("_now")).select("path", F.lit(seq).alias("seq"), F.lit(p.stage).alias("stage"), F.lit(p.name).alias("provider"), "confidence", "fields", F.concat(F.lit(p.stage + ": "), F.coalesce("notes", F.lit(""))).alias("notes"))
        out = got if out is None else out.unionByName(got)
        best = got.groupBy("path").agg(F.max_by("fields", "confidence").alias("_got"))  # a provider answers once a path
        state = state.join(best, "path", "left").withColumn("_now", overlay(F.col("_now"), F.col("_got"))).drop("_got")
    return out


def with_evidence(media: DataFrame, providers: list[Provider], required: list[str]) -> DataFrame:
    """U-01, P-02, R-04: ``collect_evidence`` of providers that answer in rows: ``media`` with the array ``evidence``, without a join or a shuffle."""
    d = media.withColumn("_own", F.col("tags"))
    none = F.create_map().cast("map<string,string>")
    for seq, p in enumerate(providers, 1):
        open_ = F.col("_answer").isNotNull()
        if p.stage in ("web", "paid"):
            open_ &= F.size(missing_required(required, F.col("tags"), none, F.coalesce("has_cover_art", F.lit(False)))) > 0
        notes = F.concat(F.lit(p.stage + ": "), F.coalesce("_answer.notes", F.lit("")))
        one = F.struct(F.lit(seq).alias("seq"), F.lit(p.stage).alias("stage"), F.lit(p.name).alias("provider"), "_answer.confidence", "_answer.fields", notes.alias("notes"))
        d = held(p.answer(d), **{f"_e{seq}": F.when(open_, one)}).drop("_answer")
        if seq < len(providers):
            d = held(d, tags=F.when(F.col(f"_e{seq}").isNull(), F.col("tags")).otherwise(overlay(F.col("tags"), F.col(f"_e{seq}.fields"))))
    given = F.filter(F.array(*[F.col(f"_e{i + 1}") for i in range(len(providers))]), lambda e: e.isNotNull())
    return d.select(*[F.col("_own").alias("tags") if c == "tags" else F.col(c) for c in media.columns], given.alias("evidence"))


def identity_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """P-03: paths whose title, artist or album is there and differs after N11: those are looked up again."""
    from sonarium.functions.text import key_identity

    d = before.select("path", F.col("tags").alias("a")).join(after.select("path", F.col("fields").alias("b")), "path")
    get = lambda m, k: key_identity(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit("")))
    changed = [(get("b", k) != "") & (get("a", k) != get("b", k)) for k in ("title", "artist", "album")]
    return d.where(changed[0] | changed[1] | changed[2]).select("path")
