"""Readers and writers of reports, logs, manifests and label files."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonarium.functions.text import path_parts
from sonarium.functions.validity import first_of
from sonarium.session import exists
from sonarium.schema import DEBUG_COLUMNS, EXPORT_BASIC, EXPORT_COLUMNS, FINAL_COLUMNS, MANIFEST


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S-07: a CSV with header, byte order mark, quoted delimiters and line ends; all text, missing cells empty; header names lower case with underscores."""
    d = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False, encoding="UTF-8")
    if not d.columns:
        raise ValueError(f"no header in {path}")
    return d.toDF(*[c.strip("﻿ ").lower().replace(" ", "_") for c in d.columns]).na.fill("")


def column(df: DataFrame, *names: str) -> Column:
    """R-01: the first of the named columns that the table has and that is not blank."""
    found = [F.col(f"`{n}`") for n in names if n in df.columns]
    return first_of(*found) if found else F.lit("")


def find_csv(path: str, suffix: str = "_converted") -> list[str]:
    """S-08: a file, or a folder's CSV and XLS files in order that are not results already."""
    if os.path.isfile(path):
        return [path]
    names = sorted(f for f in glob.glob(os.path.join(path, "*")) if f.lower().endswith((".csv", ".xls")))
    return [f for f in names if not os.path.splitext(f)[0].endswith(suffix)]


def find_pairs(sources: list[str], candidates: list[str], endings: tuple[str, ...] = ("_tagged.csv", "_portal.csv", ".csv")) -> list[tuple[str, str]]:
    """S-09: each source with the first candidate named after it, in the order of ``endings``; sources without one are left out."""
    by_name = {os.path.basename(c): c for c in candidates}
    found = []
    for s in sources:
        stem = os.path.splitext(os.path.basename(s))[0]
        match = next((by_name[stem + e] for e in endings if stem + e in by_name and by_name[stem + e] != s), None)
        if match:
            found.append((s, match))
    return found


def output_name(path: str, suffix: str = "_converted", extension: str = ".csv") -> str:
    """K-16."""
    stem = os.path.splitext(path)[0]
    return (stem if stem.endswith(suffix) else stem + suffix) + extension


def scan_folder(spark: SparkSession, root: str, suffixes: list[str]) -> DataFrame:
    """S-01: ``(root, path, size_bytes, mtime)`` of the files below a folder; contents are never read."""
    pattern = "*{" + ",".join(sorted({s.lower() for s in suffixes} | {s.upper() for s in suffixes})) + "}"
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return d.select(F.lit(root).alias("root"), F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").cast("double").alias("mtime"))


def read_tags(scan: DataFrame, reader) -> DataFrame:
    """S-04 to S-06: ``(path, tags, has_cover_art, duration_seconds, bitrate)`` by a plug-in ``reader(path) -> dict``, per Arrow batch.

    A file that cannot be read gives empty tags; a year is the first four characters of a date.
    """
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    got = reader(path)
                except Exception:  # noqa: BLE001
                    got = {}
                tags = {k: str(v).strip() for k, v in (got.get("tags") or {}).items() if v and str(v).strip()}
                if "year" not in tags and tags.get("date"):
                    tags["year"] = tags["date"][:4]
                rows.append((path, tags, bool(got.get("has_cover_art")), got.get("duration_seconds"), got.get("bitrate")))
            yield pd.DataFrame(rows, columns=["path", "tags", "has_cover_art", "duration_seconds", "bitrate"])

    return scan.select("path").mapInPandas(run, "path string, tags map<string,string>, has_cover_art boolean, duration_seconds int, bitrate int")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """S-15: ``(ord, label)`` of the lines that are not blank; ``ord`` follows the lines of one file, which is read as a whole."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "label"))
    return d.withColumn("label", F.trim("label")).where("label <> ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S-11: the manifest; a missing one is empty, and lines of one that are broken are left out. What cannot be read is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(path, mode="DROPMALFORMED")


def write_manifest(df: DataFrame, path: str) -> None:
    """S-11, K-17: a new version beside the old one, which readers switch to."""
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    """K-08, K-09: rows added to a log; what is current is a view (last_wins)."""
    df.write.mode("append").parquet(path)


def debug_rows(d: DataFrame) -> DataFrame:
    """K-02: merged results as the 48 columns of the debug report; lists joined, maps as JSON."""
    from sonarium.schema import TAG_FIELDS

    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    name = path_parts(F.col("path"))["name"]
    special = {
        "filename": name, "file_path": F.col("path"), "status": F.col("status"), "written_fields": F.array_join("written_fields", "; "), "missing_required": F.array_join("missing_required", "; "),
        "providers_used": F.array_join("providers_used", "; "), "error": F.coalesce("error", F.lit("")), "has_cover_art": F.when(F.col("has_cover_art") | (f("cover_art_url") != ""), "yes").otherwise("no"),
        "field_confidence_json": F.to_json("field_confidence"), "field_sources_json": F.to_json("field_sources"), "hybrid_stage_summary": F.coalesce("stage_summary", F.lit("")), "notes": F.array_join("notes", "; "),
    }
    return d.select(*[special.get(c, f(c)).alias(c) for c in DEBUG_COLUMNS if c in special or c in TAG_FIELDS])


def final_rows(d: DataFrame, required: list[str]) -> DataFrame:
    """K-03, C-03 to C-05: completed results as the 39 columns of the final report.

    ``d(path, fields, field_sources, quality_score, has_cover_art, error)``. A field without a source was filled in.
    """
    from sonarium.operators.votes import missing_required

    f = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))
    cover = F.col("has_cover_art") | (f("cover_art_url") != "")
    empty = F.create_map().cast("map<string,string>")
    d = d.withColumn("_gone", missing_required([*required, "cover_art"], F.col("fields"), empty, F.col("has_cover_art")))
    status = F.when(F.coalesce("error", F.lit("")) != "", "failed").when(F.size("_gone") > 0, "needs_review").otherwise("validated")
    filled = F.transform_values(F.map_filter("fields", lambda k, v: ~F.map_contains_key(F.coalesce("field_sources", empty), k)), lambda k, v: F.lit("final_completion"))
    special = {
        "filename": path_parts(F.col("path"))["name"], "file_path": F.col("path"), "has_cover_art": F.when(cover, "yes").otherwise("no"), "quality_score": F.round("quality_score", 3).cast("string"),
        "validation_status": status, "missing_tags": F.when(F.size("_gone") > 0, F.array_join("_gone", "; ")).otherwise("none"), "sources": F.to_json(F.map_concat(F.coalesce("field_sources", empty), filled)),
    }
    return d.select(*[special.get(c, f(c)).alias(c) for c in FINAL_COLUMNS])


def export_rows(media: DataFrame, basic: bool = False) -> DataFrame:
    """K-05: the tags that files have, in the full or the basic preset."""
    special = {"filename": path_parts(F.col("path"))["name"], "file_path": F.col("path"), **{c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("size_bytes", "duration_seconds", "bitrate")}}
    special["has_cover_art"] = F.when(F.col("has_cover_art"), "yes").otherwise("no")
    return media.select(*[special.get(c, F.coalesce(F.try_element_at("tags", F.lit(c)), F.lit(""))).alias(c) for c in (EXPORT_BASIC if basic else EXPORT_COLUMNS)])


def write_report(df: DataFrame, path: str) -> None:
    """K-06, K-12: a table as CSV with a header, values as they are, outer blanks too."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="")


def write_records(df: DataFrame, path: str) -> None:
    """K-04, K-07: nested records or a run summary as JSON lines."""
    df.write.mode("overwrite").json(path)


def paid_candidates(report: DataFrame, wanted: list[str]) -> DataFrame:
    """K-13, P-10: rows that miss a wanted field, with the sorted ones they miss."""
    gone = F.array_sort(F.array_intersect(F.transform(F.split("missing_tags", "[;,]"), lambda x: F.trim(x)), F.array(*[F.lit(w) for w in wanted])))
    return report.withColumn("paid_candidate_reason", F.array_join(gone, "; ")).where(F.size(gone) > 0)


def rewrite_checked(df: DataFrame, issue_list: Column, path: str, drop: str | None = None) -> None:
    """K-15: ``df``, without the column ``drop``, written only if no row has an issue; else the write fails and the target keeps what it has."""
    bad = df.select(issue_list.alias("i")).where(F.size("i") > 0)
    if bad.limit(1).count():
        raise ValueError(f"rows with issues: {bad.groupBy('i').count().limit(5).collect()}")
    write_report(df.drop(drop) if drop else df, path)
