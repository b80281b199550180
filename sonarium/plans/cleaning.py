"""Queries for the general cleaning problems (3 and 6), with SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.operators.packed import unpack_fields
from sonarium.operators.timestamps import date_cases, estimate_zones, estimate_zones_in_order
from sonarium.session import table

PACKED = ["moods", "subgenre", "instruments", "themes"]


def p3_found(spark, sf_dir):
    return unpack_fields(table(spark, sf_dir, "smoke_final_completed"), "row_id", PACKED)


def p6_found(spark, sf_dir):
    return date_cases(table(spark, sf_dir, "smoke_final_completed"), table(spark, sf_dir, "library_roots"))


#: Candidate zones of the estimates, with offset histories that differ.
ZONES = ["America/New_York", "Asia/Tokyo", "Europe/Berlin", "Europe/London"]


def _clocks(spark, sf_dir):
    """Events as five clocks in four zones wrote them, every third with its zone stated, and when they arrived."""
    zone = F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.col("user_id") % 5 % 4 + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("clock"), F.col("ts").cast("timestamp_ntz").alias("utc"), zone.alias("zone"))
    e = e.withColumn("local", F.convert_timezone(F.lit("UTC"), F.col("zone"), F.col("utc"))).withColumn("arrived", F.col("utc") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("event_id") % 20))
    return e.withColumn("stated", F.when(F.col("event_id") % 3 == 0, F.col("utc")))


def p6_zones(spark, sf_dir):
    """The zone of each clock by when its events arrived."""
    return estimate_zones(_clocks(spark, sf_dir), "clock", "local", "arrived", ZONES, 1).select(F.col("source").alias("clock"), "time_zone", "violations", "n")


def p6_zones_in_order(spark, sf_dir):
    """The zone of each clock by the order of its events and the times of those that state one."""
    d = _clocks(spark, sf_dir).withColumn("local", F.when(F.col("stated").isNull(), F.col("local"))).withColumn("place", F.unix_micros(F.col("utc").cast("timestamp")) * 64 + F.col("event_id") % 64)
    return estimate_zones_in_order(d, "clock", "place", "local", "stated", ZONES).select(F.col("source").alias("clock"), "time_zone", "violations", "n")


QUERIES = {"p3_found": p3_found, "p6_found": p6_found, "p6_zones": p6_zones, "p6_zones_in_order": p6_zones_in_order}

# A plainer statement than the operator's: parts by one pattern. DuckDB's patterns have no look-around, so a slash between
# blanks becomes a bar first (no quoted span of the data holds one).
_P3 = """
WITH long AS (
  SELECT row_id, field_name, regexp_replace(regexp_replace(value, '^\\s*\\[(.*)\\]\\s*$', '\\1'), '\\s/\\s|[\\t\\n\\r]', ' | ', 'g') AS v, starts_with(ltrim(value), '[') AS listed
  FROM (UNPIVOT (SELECT row_id, moods, subgenre, instruments, themes FROM smoke_final_completed) ON moods, subgenre, instruments, themes INTO NAME field_name VALUE value)),
parts AS (
  SELECT row_id, field_name, list_filter(list_transform(
    regexp_extract_all(CASE WHEN listed THEN replace(v, '\\"', '""') ELSE v END, '\\s*(?:"(?:[^"]|"")*"|''(?:[^'']*)'')\\s*|[^,;|·\\t\\n\\r]+'),
    lambda x: CASE WHEN starts_with(trim(x), '"') AND length(trim(x)) > 1 THEN trim(replace(substr(trim(x), 2, length(trim(x)) - 2), '""', '"'))
              WHEN starts_with(trim(x), '''') AND length(trim(x)) > 1 THEN trim(substr(trim(x), 2, length(trim(x)) - 2)) ELSE trim(x) END), lambda x: x <> '') AS items
  FROM long)
SELECT row_id, field_name, CAST(pos AS INTEGER) AS pos, items[pos] AS item_text
FROM (SELECT row_id, field_name, items, unnest(range(1, len(items) + 1)) AS pos FROM parts WHERE len(items) >= 2)
"""

# The zone that each clock was given; the estimates never see it.
_ZONES = f"SELECT user_id % 5 AS clock, {ZONES}[user_id % 5 % 4 + 1] AS time_zone, 0 AS violations, count(*) AS n FROM events {{}} GROUP BY 1, 2"
SQL = {"p3_found": _P3, "p6_zones": _ZONES.format(""), "p6_zones_in_order": _ZONES.format("WHERE event_id % 3 <> 0")}
