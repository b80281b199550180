"""Append-only logs: current views, lookups with a lifetime, resuming, compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Statuses of a finished file, and the tolerance within which two modification times are one.
DONE, CLOCK = ("dry_run_done", "updated", "no_change"), 0.001


def _orderable(log: DataFrame, columns: list[str]) -> list[str]:
    """Of the columns those that have an order: not maps, nor what holds one, nor variants."""
    return [c for c in columns if not any(x in log.schema[c].dataType.simpleString() for x in ("map<", "variant"))]


def _chosen(df: DataFrame, key: list[str], order: list[str], choose) -> DataFrame:
    rest = [c for c in df.columns if c not in key and c not in order]
    by = F.struct(*order, *_orderable(df, rest))
    every = F.struct(*order, *rest) if rest or order else F.struct(F.lit(1))
    b = df.groupBy(*key).agg(choose(every, by).alias("_b"))
    return b.select(*[F.col(c) if c in key else F.col(f"_b.{c}").alias(c) for c in df.columns])


def last_wins(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """T-05, S-10, X-03: the last row of each key by ``order`` (the rest of the columns that have an order breaks ties).

    A choice combined before the shuffle: a key with a third of all rows costs one row a task.
    """
    return _chosen(log, key, order, F.max_by)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """U-02, X-05: the first row of each key by ``order``, likewise."""
    return _chosen(df, key, order, F.min_by)


def bloat(log: DataFrame, key: list[str], factor: float = 1.5) -> DataFrame:
    """A-09: one row: rows, distinct keys, and whether the log is worth compacting."""
    per = log.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("disk_rows"), F.count(F.lit(1)).alias("unique_rows")).withColumn("compact", F.col("disk_rows") > F.col("unique_rows") * factor)


def compact(spark, path: str, to: str, key: list[str], order: list[str], factor: float = 1.5, force: bool = False) -> bool:
    """K-10: the log at ``path`` rewritten to ``to``, last rows only, if it is bloated or ``force``; readers switch to the new folder."""
    log = spark.read.parquet(path)
    if not (force or bloat(log, key, factor).first().compact):
        return False
    last_wins(log, key, order).write.mode("overwrite").parquet(to)
    return True


def cached(requests: DataFrame, log: DataFrame, now: Column, ttl: float) -> DataFrame:
    """J-12, X-04: ``requests(provider, cache_key)`` with the ``response`` of the last log row, null (a miss) if older than ``ttl`` seconds or broken JSON."""
    current = last_wins(log, ["provider", "cache_key"], ["created_at"]).select("provider", "cache_key", "response_json", "created_at")
    d = requests.join(current, ["provider", "cache_key"], "left")
    fresh = (now - F.col("created_at") <= ttl) & F.try_parse_json("response_json").isNotNull()
    return d.withColumn("response", F.when(fresh, F.col("response_json"))).drop("response_json", "created_at")


def pending(media: DataFrame, log: DataFrame, reported: DataFrame | None = None) -> DataFrame:
    """J-02, J-03, P-05: files that no report has and that the current state does not hold as done with the same size and time."""
    done = last_wins(log, ["path"], ["processed_at"]).where(F.col("status").isin(*DONE)).select("path", F.col("size_bytes").alias("_size"), F.col("mtime").alias("_mtime"))
    same = (media["path"] == done["path"]) & (media["size_bytes"] == done["_size"]) & (F.abs(media["mtime"] - done["_mtime"]) < CLOCK)
    left = media.join(done, same, "left_anti")
    return left if reported is None else left.join(reported.select("path").distinct(), "path", "left_anti")


def propagated(df: DataFrame, key: str, order: list[str], value: str, out: str, exempt: str | None = None) -> DataFrame:
    """T-06: the first value of each key, blank or not, carried to all its rows; rows of the ``exempt`` key keep their own.

    The first value is found by a partial aggregate and joined back, so no key is sorted in one task. A null key is a key.
    """
    first = df.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*order, F.col(value).alias("v")))["v"].alias("_first"))
    d = df.join(first, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
    keep = F.coalesce(F.col(key) == exempt, F.lit(False)) if exempt is not None else F.lit(False)
    return d.withColumn(out, F.when(keep, F.col(value)).otherwise(F.col("_first"))).drop("_first")


def first_gated(df: DataFrame, gate: Column, order: list[str], most: int) -> DataFrame:
    """T-13, T-14, X-08: the first ``most`` rows, by ``order``, of those the gate lets through, for the whole run: a budget."""
    return df.where(gate).orderBy(*order).limit(most)


#: Rows that one task takes through a window, about: a key with more is split into ranges of its order.
WINDOW_ROWS = 1_000_000


def running_sum(df: DataFrame, key: list[str], order: str, value: Column, out: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of its key up to it by the numeric column ``order``, in which a key's rows differ.

    The range of ``order`` is cut into blocks of about ``rows`` rows; sums before a block come from one small row a key and
    block, so that a key with a third of all rows is as many tasks as it has blocks. A null key is a key.
    """
    rows = rows or WINDOW_ROWS
    s = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("n")).first()
    blocks = (s.n or 0) // rows + 1
    if blocks == 1:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(*key).orderBy(order)))
    width = (float(s.high) - float(s.low)) / blocks or 1.0
    d = df.withColumn("_block", F.floor((F.col(order) - F.lit(s.low)) / width).cast("int")).withColumn("_v", value)
    per = d.groupBy(*key, "_block").agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = d["_block"].eqNullSafe(per["_b"])
    for i, k in enumerate(key):
        same = same & d[k].eqNullSafe(per[f"_k{i}"])
    d = d.withColumn("_own", F.sum("_v").over(Window.partitionBy(*key, "_block").orderBy(order))).join(per, same, "left")
    return d.withColumn(out, F.col("_own") + F.col("_before")).drop("_block", "_v", "_own", "_b", "_before", *[f"_k{i}" for i in range(len(key))])


def numbered(df: DataFrame, key: list[str], order: str, out: str, rows: int | None = None) -> DataFrame:
    """``df`` with ``out``, the number of each row within its key by ``order``, from 1; hot keys as in running_sum where ``order`` is a number."""
    if not isinstance(df.schema[order].dataType, NumericType):
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    return running_sum(df, key, order, F.lit(1), out, rows).withColumn(out, F.col(out).cast("int"))


def streaks(log: DataFrame, key: str, order: str, failed: Column, least: int) -> DataFrame:
    """X-06: ``(key, first_at, last_at, failures)`` of each run of ``least`` or more failures in a row (when a breaker opens)."""
    d = running_sum(log.select(key, order, failed.alias("f")), [key], order, F.when(F.col("f"), 0).otherwise(1), "g")
    runs = d.where("f").groupBy(key, "g").agg(F.min(order).alias("first_at"), F.max(order).alias("last_at"), F.count(F.lit(1)).alias("failures"))
    return runs.where(F.col("failures") >= least).drop("g")


def run_metrics(results: DataFrame) -> DataFrame:
    """A-07: per provider of ``results(provider, n_fields, notes, elapsed_ms)``: calls, hits, errors, average latency."""
    return results.groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("n_fields") > 0).alias("hits"),
        F.count_if(F.coalesce(F.col("notes").contains("error:"), F.lit(False))).alias("errors"), F.round(F.avg("elapsed_ms"), 1).alias("average_ms"),
    )


def stage_summary(results: DataFrame, entity: str) -> DataFrame:
    """R-11: per entity ``stage=a,b; stage=c``, both sorted; the stage is what stands before a colon in the notes, else unknown."""
    stage = F.when(F.col("notes").contains(":"), F.substring_index("notes", ":", 1)).otherwise("unknown")
    per = results.groupBy(entity, stage.alias("stage")).agg(F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("p"))
    listed = F.array_sort(F.collect_list(F.concat("stage", F.lit("="), "p")))
    return per.groupBy(entity).agg(F.array_join(listed, "; ").alias("summary"))
