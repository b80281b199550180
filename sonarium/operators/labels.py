"""Ranked model predictions turned into fields; zero-shot scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.numbers import clamp
from sonarium.functions.text import fill_templates, label_spec, pretty_label
from sonarium.session import BROADCAST_ROWS, small

#: Most values of each field (T-11).
LIMITS = {"genre": 1, "subgenre": 4, "moods": 6, "themes": 6, "occasion": 3, "instruments": 8}


def specifications(lines: DataFrame, template: str = "a {label} song", default: str = "theme") -> DataFrame:
    """G-06, F-19, F-20: ``(ord, field, label, prompt)``: a zero-shot vocabulary from ``lines(ord, label)`` of ``field: label``, one row a
    field and label, the first; blank lines are left out."""
    d = lines.where(F.trim("label") != "").select("ord", label_spec(F.col("label"), default).alias("s")).select("ord", "s.field", "s.label")
    once = d.groupBy("field", "label").agg(F.min("ord").alias("ord"))
    return once.select("ord", "field", "label", fill_templates(F.lit(template), F.col("label")).alias("prompt"))


def categories(predictions: DataFrame, dimension: DataFrame, least: float) -> DataFrame:
    """J-08, P-17, F-17: ``(path, rank, label, score, field)`` of predictions of at least ``least``; the field that was given, else by
    ``dimension(label, category)``, else by the head's name, else by a hierarchy mark; labels without a field are left out."""
    d = predictions.where(F.col("score") >= least)
    known = small(dimension.select(F.lower("label").alias("_l"), "category").groupBy("_l").agg(F.min("category").alias("_c")))
    d = d.withColumn("_l", F.lower(pretty_label(F.col("label")))).join(known, "_l", "left")
    head = F.lower(F.coalesce("head", F.lit("")))
    by_head = F.when(head.contains("instrument"), "instruments").when(head.contains("mood"), "moods").when(head.contains("theme"), "themes").when(head.contains("genre"), "genre")
    field = F.coalesce(F.nullif("field", F.lit("")), "_c", by_head, F.when(F.col("label").contains("---"), F.lit("genre")))
    return d.select("path", "rank", pretty_label(F.col("label")).alias("label"), "score", field.alias("field")).where(F.col("field").isNotNull())


def bucket_fields(categorised: DataFrame) -> DataFrame:
    """C-07, A-10, T-11: per file the values of each field in rank order, one for each spelling, at most LIMITS; genres after the first are subgenres."""
    once = categorised.groupBy("path", "field", F.lower("label").alias("k")).agg(F.min(F.struct("rank", "label")).alias("m"))
    lists = once.groupBy("path", "field").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["label"]).alias("v"))
    genres = lists.where(F.col("field") == "genre").select("path", F.lit("subgenre").alias("field"), F.slice("v", 2, LIMITS["subgenre"]).alias("v"))
    most = F.coalesce(*[F.when(F.col("field") == f, n) for f, n in LIMITS.items()], F.lit(6))
    rest = lists.withColumn("v", F.slice("v", F.lit(1), most)).unionByName(genres)
    merged = rest.where(F.size("v") > 0).groupBy("path", "field").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("v"))
    return merged.select("path", "field", F.array_join("v", ", ").alias("value"))


def dsp_fields(bpm: Column, key: Column, scale: Column, danceability: Column) -> Column:
    """R-14: measured features as fields; the dance measure, which goes to 3, as a share with three decimals."""
    share = F.round(clamp(danceability / 3), 3)
    return F.map_filter(
        F.create_map(F.lit("bpm"), F.bround(bpm).cast("int").cast("string"), F.lit("key"), F.concat_ws(" ", key, scale), F.lit("danceability"), share.cast("string")), lambda _, v: v.isNotNull() & (v != "")
    )


def combined(fields: Column, measured: Column) -> Column:
    """R-15: predicted fields, gaps filled by measured ones."""
    return F.map_concat(fields, F.map_filter(measured, lambda k, v: ~F.map_contains_key(fields, k)))


def evidence_confidence(best: Column, measured: Column, substantive: Column) -> Column:
    """A-14: 0.35 without substance, else 0.55 + 0.42 of the best score up to 0.92, at least 0.86 with measured features."""
    score = F.least(F.lit(0.92), 0.55 + 0.42 * F.coalesce(best, F.lit(0.0)))
    return F.round(F.when(~substantive, 0.35).when(measured, F.greatest(F.lit(0.86), score)).otherwise(score), 3)


def pooled(frames: DataFrame, entity: str, scores: str) -> DataFrame:
    """A-13: the mean of an array column per position over an entity's frames."""
    d = frames.select(entity, F.posexplode(scores).alias("pos", "s")).groupBy(entity, "pos").agg(F.avg("s").alias("s"))
    return d.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]).alias(scores))


def prompt_best(scored: DataFrame) -> DataFrame:
    """A-12: per (item, label) the best prompt's score, the first on ties, and how many prompts there were; of ``scored(item, label, pos, prompt, score)``."""
    d = scored.groupBy("item", "label").agg(F.max(F.struct("score", (-F.col("pos")).alias("o"), "prompt")).alias("b"), F.count(F.lit(1)).alias("prompts"))
    return d.select("item", "label", "b.score", "b.prompt", "prompts")


def zero_shot(items: DataFrame, labels: DataFrame, most: int, scale: float = 100.0, block: int = BROADCAST_ROWS) -> DataFrame:
    """M-08, T-10: ``(item, label, rank, share)``: the ``most`` labels nearest to each item by cosine, with their softmax share over all labels.

    ``labels(label, vector)`` is a vocabulary of prompts of any size, each label once. Blocks of about ``block`` labels travel to every task one
    after the other, as a matrix of that many rows; each block gives an item's best labels and the sum of its shares, which
    are merged by a partial aggregate, so no pair is ever shuffled. Ties go to the smallest label; a null or zero vector on
    either side has a cosine of -1.
    """
    spark = items.sparkSession
    blocks = labels.count() // block + 1
    label_type, item_type = labels.schema["label"].dataType, items.schema["item"].dataType.simpleString()
    shape = f"item {item_type}, top array<struct<s:double,label:{label_type.simpleString()}>>, high double, total double"
    parts = None
    for i in range(blocks):
        own = labels.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == i) if blocks > 1 else labels
        rows = sorted(own.select("label", "vector").collect(), key=lambda r: r.label)  # a block
        if not rows:
            continue
        width = max((len(r.vector) for r in rows if r.vector is not None), default=0)
        matrix = np.array([r.vector if r.vector is not None else [0.0] * width for r in rows], float).reshape(len(rows), width)
        shared = spark.sparkContext.broadcast(([r.label for r in rows], matrix))
        part = items.select("item", "vector").mapInPandas(_nearest(shared, most, scale), shape)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return spark.createDataFrame([], f"item {item_type}, label {label_type.simpleString()}, rank int, share double")
    if blocks > 1:
        each = F.array_sort(F.flatten(F.collect_list("top")), lambda a, b: F.when(a["s"] > b["s"], -1).when(a["s"] < b["s"], 1).when(a["label"] < b["label"], -1).otherwise(1))
        high = parts.groupBy("item").agg(F.max("high").alias("_h"))
        joined = parts.join(high, "item").withColumn("total", F.col("total") * F.exp(F.col("high") - F.col("_h")))
        parts = joined.groupBy("item").agg(F.slice(each, 1, most).alias("top"), F.max("_h").alias("high"), F.sum("total").alias("total"))
    best = parts.select("item", "high", "total", F.posexplode("top").alias("rank", "t"))
    return best.select("item", F.col("t.label").alias("label"), (F.col("rank") + 1).alias("rank"), (F.exp(scale * F.col("t.s") - F.col("high")) / F.col("total")).alias("share"))


def _nearest(shared, most: int, scale: float):
    """Per Arrow batch: the best labels of each item, the highest scaled cosine and the sum of the exponentials below it."""
    def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.linalg.norm(m, axis=1)
        return m / np.where(n > 0, n, 1)[:, None], n > 0

    def run(batches):
        names, matrix = shared.value
        known, there = unit(matrix)
        for pdf in batches:
            if not len(pdf):
                continue
            rows = np.array([v if v is not None and len(v) == matrix.shape[1] else np.zeros(matrix.shape[1]) for v in pdf["vector"]], float).reshape(len(pdf), -1)
            own, given = unit(rows)
            cosine = np.where(given[:, None] & there[None, :], own @ known.T, -1.0)
            order = np.argsort(-cosine, axis=1, kind="stable")[:, :most]
            high = scale * cosine.max(axis=1)
            total = np.exp(scale * cosine - high[:, None]).sum(axis=1)
            top = [[{"s": float(c[j]), "label": names[j]} for j in o] for c, o in zip(cosine, order)]
            yield pd.DataFrame({"item": pdf["item"], "top": top, "high": high, "total": total})

    return run


def accepted_voice(scores: DataFrame, least: float, margin: float) -> DataFrame:
    """P-23: ``(path, voice, error)`` from ``scores(path, label, score)``: both classes there, the top sure enough and far enough ahead."""
    cls = F.when(F.lower("label").contains("instrumental"), "instrumental").when(F.lower("label").rlike("voice|vocal"), "vocal")
    top = lambda c: F.max(F.when(F.col("c") == c, F.col("score")))
    d = scores.withColumn("c", cls).groupBy("path").agg(top("vocal").alias("v"), top("instrumental").alias("i"), F.count_if(F.col("c").isNull()).alias("odd"))
    error = F.when((F.col("odd") > 0) | F.col("v").isNull() | F.col("i").isNull(), "classes").when(F.greatest("v", "i") < least, "unsure").when(F.abs(F.col("v") - F.col("i")) < margin, "close")
    return d.select("path", F.when(error.isNull(), F.when(F.col("v") > F.col("i"), "vocal").otherwise("instrumental")).alias("voice"), error.alias("error"))
