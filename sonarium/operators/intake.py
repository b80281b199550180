"""New files: scans, manifest, target names, and finding the media of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.text import key_filename, path_parts, squeeze, to_fix_point
from sonarium.operators.state import numbered

# Noise at the end or in brackets of file names; names that say nothing.
NOISE = r"(?i)\s*[\[(]\s*(?:official|lyrics?|audio|video|visuali[sz]er|hd|hq|4k|free download|\d+ ?kbps)[^\])]*[\])]"
TRAILING = r"(?i)\s+(?:official (?:music )?video|official audio|lyrics? video|\d{3} ?kbps)\s*$"
GENERIC = r"(?i)^(?:\d{4,}|[0-9a-f]{8,}|(?:track|audio|file|untitled|unknown|recording)[ _-]*\d*)$"


def media_files(df: DataFrame, suffixes: list[str], excluded: tuple[str, ...] = ("normalized",)) -> DataFrame:
    """S-01, S-02: rows of ``df(root, path)`` with a wanted suffix and no excluded folder above, in order of root and path, case ignored."""
    p = path_parts(F.col("path"))
    folders = F.split(F.lower(p["folder"]), "/")
    kept = df.where(p["suffix"].isin(*[s.lower() for s in suffixes]) & ~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in excluded])))
    return kept.orderBy(F.lower("root"), F.lower("path"))


def limited(files: DataFrame, most: int | None) -> DataFrame:
    """T-12: the first ``most`` files by root and path, case ignored; all where it is None or not positive. The limit is the feature: a trial run."""
    return files if not most or most < 0 else files.orderBy(F.lower("root"), F.lower("path")).limit(most)


def selected(files: DataFrame, selection: DataFrame) -> DataFrame:
    """S-03, P-16: the files that a selection names."""
    return files.join(selection.select("path").distinct(), "path", "left_semi")


def is_generic(stem: Column) -> Column:
    """P-18: a stem that names nothing; never one with a dash between blanks."""
    t = F.regexp_replace(squeeze(stem), r"^[ .\-_]+|[ .\-_]+$", "")
    return (t == "") | (~t.rlike(r"\s-\s") & t.rlike(GENERIC))


def clean_name(name: Column) -> Column:
    """F-08: a file name without noise, however often it stands there, and illegal characters, one kind of dash, the suffix lower case."""
    parts = path_parts(name)
    stem = F.regexp_replace(squeeze(parts["stem"]), r"\s*[‐-―]\s*", " - ")
    stem = to_fix_point(stem, lambda s: F.regexp_replace(F.regexp_replace(s, NOISE, " "), TRAILING, ""))
    stem = F.regexp_replace(F.regexp_replace(stem, r'[<>:"/\\|?*\x00-\x1f]+', " "), r"\s+-\s+", " - ")
    stem = F.regexp_replace(squeeze(stem), r"^[ .\-_]+|[ .\-_]+$", "")
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.nullif(parts["stem"], F.lit("")), F.lit("media")), parts["suffix"])


def target_name(name: Column, artist: Column, title: Column) -> Column:
    """F-08, P-18: ``artist - title`` from the tags for a generic name, if both are there and differ; else the clean name."""
    parts = path_parts(name)
    a, t = squeeze(artist), squeeze(title)
    named = F.concat(a, F.lit(" - "), t, parts["suffix"])
    return F.when(is_generic(parts["stem"]) & (a != "") & (t != "") & (F.lower(a) != F.lower(t)), named).otherwise(clean_name(name))


def new_files(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """X-02, P-19: scanned files that the manifest does not hold with the same path, size and time."""
    known = manifest.select("root", F.col("current_relpath").alias("relpath"), "size_bytes", "mtime_ns").distinct()
    return scan.join(known, ["root", "relpath", "size_bytes", "mtime_ns"], "left_anti")


def free_names(plan: DataFrame, taken: DataFrame, folder: str = "folder", name: str = "target", order: str = "seq") -> DataFrame:
    """T-09: ``plan`` with names that neither each other nor ``taken(folder, target)`` have: later ones get `` (2)``, `` (3)`` and so on.

    Numbers start after the highest that is taken for the name, so one join and one ranking settle all at once.
    """
    parts = path_parts(F.col(name))
    p = plan.withColumn("_base", F.lower(F.col(name))).withColumn("_stem", parts["stem"]).withColumn("_suffix", parts["suffix"])
    with_number = r"^(.*?)(?: \((\d+)\))?(\.[^.]*)?$"
    t = taken.select(folder, F.lower(F.concat(F.regexp_extract(name, with_number, 1), F.regexp_extract(name, with_number, 3))).alias("_base"), F.coalesce(F.regexp_extract(name, with_number, 2).try_cast("int"), F.lit(1)).alias("_n"))
    high = t.groupBy(folder, "_base").agg(F.max("_n").alias("_high"))
    p = numbered(p, [folder, "_base"], order, "_no").join(high, [folder, "_base"], "left").withColumn("_no", F.col("_no") + F.coalesce("_high", F.lit(0)))
    final = F.when(F.col("_no") == 1, F.col(name)).otherwise(F.concat("_stem", F.lit(" ("), F.col("_no").cast("string"), F.lit(")"), "_suffix"))
    return p.withColumn(name, final).drop("_base", "_stem", "_suffix", "_high", "_no")


def find_media(rows: DataFrame, files: DataFrame, key: str = "row_id") -> DataFrame:
    """J-06, J-07: ``(key, path, how)``: the file of each row of ``rows(key, file_path, filename)``: its declared path, else the same path
    below any root with case ignored (the first such file), else a file name that only one file has, else its normalised name likewise.

    Each step is an equality join of the rows that are left with an index of unique keys; ambiguity is no match.
    """
    f = files.select("path", F.lower("path").alias("low"), F.lower(path_parts(F.col("path"))["name"]).alias("name"), key_filename(F.col("path")).alias("norm")).distinct()
    r = rows.select(key, "file_path", F.lower("file_path").alias("low"), F.lower("filename").alias("name"), key_filename(F.col("filename")).alias("norm"))
    steps = [
        ("declared", "file_path", f.select(F.col("path").alias("file_path"), "path").distinct()),
        ("relative", "low", f.groupBy("low").agg(F.min("path").alias("path"))),
        ("name", "name", f.groupBy("name").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")),
        ("normalised", "norm", f.groupBy("norm").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).where("n = 1 AND norm <> ''").drop("n")),
    ]
    d = r.withColumn("_path", F.lit(None).cast("string")).withColumn("_how", F.lit(None).cast("string"))
    for how, on, index in steps:
        d = d.join(index.withColumnRenamed("path", "_found"), on, "left")
        hit = F.col("_path").isNull() & F.col("_found").isNotNull()
        d = d.withColumn("_how", F.when(hit, how).otherwise(F.col("_how"))).withColumn("_path", F.coalesce("_path", "_found")).drop("_found")
    return d.select(key, F.col("_path").alias("path"), F.col("_how").alias("how"))
