"""Timestamps in mixed formats, precisions and zones, brought to one unambiguous form."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.session import held, small

# Month names by their first three letters (English, and the Danish ones that differ).
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "maj": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "okt": 10, "nov": 11, "dec": 12,
}
# Minutes east of UTC of the zone abbreviations that are read.
OFFSETS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}
WORD = r"\p{L}{3,9}"
TIME = r"(?:(?:T|\s+|,\s*|\s+kl\.?\s*)(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)?\s*([AaPp][Mm])?)?"
ZONE = r"\s*\[?(Z|[A-Z]{3,4}|[+-]\d{2}:?\d{2}|[A-Za-z]+(?:/[A-Za-z_+-]+)+)?\]?"
DAY = r"(?:\p{L}{2,9},?\s+)?"
#: Day-level forms: pattern of the date part and which of its groups are year, month and day.
DATES = [
    (r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3),
    (r"(\d{1,2})[/.](\d{1,2})[/.](\d{4}|\d{2})", 3, 2, 1),
    (rf"{DAY}(\d{{1,2}})(?:st|nd|rd|th)?[.]?[ -]({WORD})\.?[ -](\d{{4}})", 3, 2, 1),
    (rf"{DAY}({WORD})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})", 3, 1, 2),
]
COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})(?:[.,]\d+)?(Z|[+-]\d{2}:?\d{2})?)?$"
MONTH_FORMS = [(r"^(\d{4})[-/.](\d{1,2})$", 1, 2), (r"^(\d{1,2})[-/.](\d{4})$", 2, 1), (rf"^({WORD})\.?,? (\d{{4}})$", 2, 1)]


def clean(value: Column) -> Column:
    """Without outer blanks, full-width digits and marks made plain."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.regexp_replace(F.translate(value, wide, "".join(chr(c) for c in range(0x21, 0x7F))), r"(?U)^\s+|\s+$", "")


#: Field order of a parsed text; every form is rewritten to these eight, with bars between.
FIELDS = ("y", "mo", "d", "h", "mi", "s", "half", "zone")


def parse(text: Column) -> Column:
    """The eight FIELDS of a cleaned date text as array<string>, empty where the text does not name them; one element if no form fits.

    Each form is one rewrite; a rewritten text holds bars and fits no other form.
    """
    forms = [(f"^{date}{TIME}{ZONE}$", f"${y}|${mo}|${d}|$4|$5|$6|$7|$8") for date, y, mo, d in DATES]
    forms.append((COMPACT, "$1|$2|$3|$4|$5|$6||$7"))
    forms += [(p, f"${y}|${mo}||||||") for p, y, mo in MONTH_FORMS]
    for pattern, order in forms:
        text = F.regexp_replace(text, pattern, order)
    return F.split(text, r"\|", -1)


def _map(values: dict[str, int]) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")")


def _numbers(parsed: Column) -> dict[str, Column]:
    """The parsed fields as numbers, from an array column with eight elements."""
    names = _map(MONTHS)
    field = {name: F.nullif(F.get(parsed, i), F.lit("")) for i, name in enumerate(FIELDS)}
    n = {name: field[name].try_cast("int") for name in FIELDS[:6]}
    n["y"] = F.when(F.length(field["y"]) == 2, n["y"] + 2000).otherwise(n["y"])
    n["mo"] = F.coalesce(n["mo"], F.try_element_at(names, F.lower(F.substring(field["mo"], 1, 3))))
    half = F.lower(field["half"])
    n["h"] = F.when(half == "pm", n["h"] % 12 + 12).when(half == "am", n["h"] % 12).otherwise(n["h"])
    return n | {"zone": field["zone"]}


def _with_parsed(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with the columns _y to _zone of a cleaned text, and _at, the clock time they name (null if it does not exist)."""
    d = held(df, _f=parse(text))
    d = held(d, **{f"_{k}": F.when(F.size("_f") == len(FIELDS), v) for k, v in _numbers(F.col("_f")).items()}).drop("_f")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    at = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", F.col("_y"), F.col("_mo"), F.coalesce(F.col("_d"), F.lit(1)), zero("_h"), zero("_mi"), zero("_s"))
    return held(d, _at=F.when((F.col("_y") > 0) & F.col("_mo").isNotNull(), at.try_cast("timestamp_ntz")))


PARSED = [f"_{n}" for n in (*FIELDS[:6], "zone", "at")]


def _iso(at: Column) -> Column:
    return F.concat(F.replace(F.substring(at.cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("Z"))


def normal_dates(df: DataFrame, column: str, out: str, zone: str | None = None) -> DataFrame:
    """``df`` with ``out``: the date text in ``column`` in normal form, null where it denotes no existing date.

    With a time: ``YYYY-MM-DDTHH:MM:SSZ`` in UTC, fractions cut. Without: ``YYYY-MM-DD`` or ``YYYY-MM``, never shifted. A time
    without a zone is on the clock of the zone in the column ``zone``; where that is null too the value is not resolved
    (null). A local time that occurs twice is the first; one that is skipped is moved on by the gap. Ten digits are
    seconds and thirteen milliseconds since 1970. Null and blank texts give null.
    """
    known = ", ".join(f"'{z}'" for z in sorted(available_timezones()) if "/" in z and not z.startswith("posix"))
    d = _with_parsed(held(df, _t=clean(F.col(column))), F.col("_t"))
    name = F.col("_zone")
    offset = F.try_element_at(_map(OFFSETS), name)
    signed = F.when(F.substring(name, 1, 1) == "-", -1).otherwise(1)
    digits = F.regexp_replace(name, "[^0-9]", "")
    numeric = F.when(name.rlike("^[+-]"), signed * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")))
    clock = F.when(F.expr(f"_zone IN ({known})"), name).when(name.isNull(), F.col(zone) if zone else F.lit(None).cast("string"))
    d = held(d, _off=F.coalesce(offset, numeric), _clock=clock)
    utc = F.when(F.col("_off").isNotNull(), F.col("_at") - F.make_dt_interval(F.lit(0), F.lit(0), F.col("_off"))).when(
        F.col("_clock").isNotNull(), F.convert_timezone(F.col("_clock"), F.lit("UTC"), F.col("_at"))
    )
    epoch = F.when(F.col("_t").rlike(r"^\d{10}$"), F.col("_t").try_cast("bigint")).when(F.col("_t").rlike(r"^\d{13}$"), F.floor(F.col("_t").try_cast("bigint") / 1000))
    since = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), epoch.cast("decimal(18,6)"))
    d = held(d, _utc=F.when(epoch.isNotNull(), since).when(F.col("_h").isNotNull(), utc))
    value = (
        F.when(F.col("_utc").isNotNull(), _iso(F.col("_utc")))
        .when(F.col("_at").isNotNull() & F.col("_h").isNull() & F.col("_d").isNotNull(), F.substring(F.col("_at").cast("string"), 1, 10))
        .when(F.col("_at").isNotNull() & F.col("_d").isNull(), F.substring(F.col("_at").cast("string"), 1, 7))
    )
    return d.withColumn(out, value).drop("_t", "_off", "_clock", "_utc", *PARSED)


def normal_years(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``: the year that a text names, as four digits; a day or month with it must exist; null where it denotes none."""
    t = F.col("_t")
    d = _with_parsed(held(df, _t=clean(F.col(column))), t)
    bare = F.regexp_extract(t, r"(?i)^(?:\(|\[|©\s*|\(c\)\s*|year\s+|anno\s+|ca?\.?\s*)?(\d{4})(?:\.0+|\?|\)|\])?$", 1)
    short = F.regexp_extract(t, r"^['’]?(\d{2})$", 1)
    year = F.coalesce(F.nullif(bare, F.lit("")).try_cast("int"), F.nullif(short, F.lit("")).try_cast("int") + 2000, F.when(F.col("_at").isNotNull(), F.col("_y")))
    d = held(d, _year=year)
    return d.withColumn(out, F.when(F.col("_year") > 0, F.format_string("%04d", "_year"))).drop("_t", "_year", *PARSED)


def estimate_zones(df: DataFrame, source: str, local: str, arrived: str, zones: list[str], most_hours: int = 24) -> DataFrame:
    """``(source, time_zone, violations, n)``: of the candidate ``zones``, the one whose offset history fits each source best.

    ``local`` is a clock time without zone (timestamp_ntz), ``arrived`` the UTC time of ingestion. Under the right history
    an event comes before its ingestion and not more than ``most_hours`` before it; each row outside is a violation. The
    zone with the fewest wins, then the one with the least total lag, then the first by name. One partial aggregate per
    source and zone: a source with a third of all rows shuffles as many rows as any other. Null times count nowhere; a
    source without usable rows is not returned; an empty table gives an empty one.
    """
    tries = df.where(F.col(local).isNotNull() & F.col(arrived).isNotNull()).select(
        F.col(source).alias("source"), F.col(local).alias("local"), F.col(arrived).cast("timestamp_ntz").alias("arrived"), F.explode(F.array(*[F.lit(z) for z in zones])).alias("time_zone")
    )
    lag = F.timestamp_diff("SECOND", F.convert_timezone(F.col("time_zone"), F.lit("UTC"), F.col("local")), F.col("arrived"))
    bad = (lag < 0) | (lag > most_hours * 3600)
    per = tries.groupBy("source", "time_zone").agg(F.count_if(bad).alias("violations"), F.sum(F.abs(lag)).alias("lag"), F.count(F.lit(1)).alias("n"))
    best = per.groupBy("source").agg(F.min(F.struct("violations", "lag", "time_zone", "n")).alias("b"))
    return best.select("source", "b.time_zone", "b.violations", "b.n")


def estimate_zones_in_order(df: DataFrame, source: str, order: str, local: str, known: str, zones: list[str]) -> DataFrame:
    """``(source, time_zone, violations, n)`` where nothing tells when rows arrived, but their order is that of their times.

    ``known`` is the UTC time of rows that state one, ``local`` the clock time of the others, ``order`` a number in which a
    source's rows differ. Under the right offset history a converted time is not before any known one that precedes it, nor
    after any that follows; each row that is counts as a violation. The zone with the fewest wins, then the first by name.
    What a row must lie between comes from running maxima in blocks (as state.running_sum's), so a hot source is many tasks.
    Null sources, times and orders count nowhere; a source without usable rows is not returned.
    """
    d = df.where(F.col(source).isNotNull() & F.col(order).isNotNull()).select(F.col(source).alias("source"), F.col(order).alias("o"), F.col(local).alias("local"), F.col(known).cast("timestamp_ntz").alias("known"))
    d = _running(_running(d, "o", "known", "after", F.max), "o", "known", "until", F.min, -1)
    d = d.where(F.col("known").isNull() & F.col("local").isNotNull()).withColumn("time_zone", F.explode(F.array(*[F.lit(z) for z in zones])))
    utc = F.convert_timezone(F.col("time_zone"), F.lit("UTC"), F.col("local"))
    bad = F.coalesce(utc < F.col("after"), F.lit(False)) | F.coalesce(utc > F.col("until"), F.lit(False))
    per = d.groupBy("source", "time_zone").agg(F.count_if(bad).alias("violations"), F.count(F.lit(1)).alias("n"))
    best = per.groupBy("source").agg(F.min(F.struct("violations", "time_zone", "n")).alias("b"))
    return best.select("source", "b.time_zone", "b.violations", "b.n")


def _running(d: DataFrame, order: str, value: str, out: str, most, sign: int = 1) -> DataFrame:
    """``d`` with ``out``, the extreme of ``value`` over the source's rows before a row in order (after it, with ``sign`` -1)."""
    from sonarium.operators.state import WINDOW_ROWS

    s = d.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("n")).first()
    width = (float(s.high or 0) - float(s.low or 0)) / ((s.n or 0) // WINDOW_ROWS + 1) or 1.0
    d = d.withColumn("_block", F.floor((F.col(order) - F.lit(s.low or 0)) / width).cast("int"))
    back = lambda *k: Window.partitionBy(*k[:-1]).orderBy(F.col(k[-1]) * sign).rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("source", "_block").agg(most(value).alias("_v")).withColumn("_before", most("_v").over(back("source", "_block"))).drop("_v")
    d = d.withColumn("_own", most(value).over(back("source", "_block", order))).join(per, ["source", "_block"])
    both = F.array_max if most is F.max else F.array_min
    return d.withColumn(out, both(F.array("_own", "_before"))).drop("_own", "_before", "_block")


def with_root(df: DataFrame, path: str, roots: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the column ``value`` of the root its path begins with (the longest such root, ``root`` for itself), null if none.

    ``roots`` is joined by equality on the prefixes of the path that end at a separator, once for each depth that a root
    has, so a large list of roots would be a shuffled hash join; a list of checked size is broadcast. Root rows that repeat
    count once, with the least value. Trailing separators of a root do not matter.
    """
    plain = F.regexp_replace(F.replace("root", F.lit("\\"), F.lit("/")), "/+$", "")
    r = roots.where(F.col("root").isNotNull()).select(plain.alias("_root"), (plain if value == "root" else F.col(value)).alias("_value"))
    r = small(r.groupBy("_root").agg(F.min("_value").alias("_value")), 2_000)
    keyed = df.withColumn("_parts", F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/"))
    depths = sorted((row.n for row in r.select(F.size(F.split("_root", "/")).alias("n")).distinct().collect()), reverse=True)  # as many as the deepest root has at most
    found = []
    for n in depths:
        own = r.where(F.size(F.split("_root", "/")) == n).select(F.col("_root").alias(f"_root{n}"), F.col("_value").alias(f"_value{n}"))
        keyed = keyed.withColumn(f"_root{n}", F.array_join(F.slice("_parts", 1, n), "/")).join(own, f"_root{n}", "left")
        found.append(F.col(f"_value{n}"))
    keyed = keyed.withColumn(out, F.coalesce(*found) if found else F.lit(None).cast("string"))
    return keyed.drop("_parts", *[c for n in depths for c in (f"_root{n}", f"_value{n}")])


def missing_zones(df: DataFrame, roots: DataFrame, arrived: str, zones: list[str] | None = None) -> DataFrame:
    """``roots`` with the zones it lacks estimated from the times below each such root that name none, against ``arrived``.

    The candidates are ``zones``, else those that the other roots have. A root below which nothing can be aligned keeps null;
    a list in which every root has a zone is returned as it is, without reading a row of ``df``.
    """
    gone = roots.where(F.col("time_zone").isNull() & F.col("root").isNotNull())
    if gone.limit(1).count() == 0:
        return roots
    zones = zones or sorted(r.time_zone for r in roots.where(F.col("time_zone").isNotNull()).select("time_zone").distinct().limit(len(available_timezones())).collect())  # at most the zones there are
    if not zones:
        return roots
    d = with_root(df.select("file_path", arrived, F.col("date").alias("_d")), "file_path", gone, "root", "_root").where(F.col("_root").isNotNull())
    d = _with_parsed(held(d, _t=clean(F.col("_d"))), F.col("_t")).where(F.col("_h").isNotNull() & F.col("_zone").isNull() & F.col("_at").isNotNull())
    found = estimate_zones(d, "_root", "_at", arrived, zones).select("source", F.col("time_zone").alias("_found"))
    plain = F.regexp_replace(F.replace("root", F.lit("\\"), F.lit("/")), "/+$", "")
    d = roots.withColumn("_plain", plain).join(small(found), F.col("_plain") == F.col("source"), "left")
    return d.withColumn("time_zone", F.coalesce("time_zone", "_found")).drop("_plain", "source", "_found")


def date_cases(df: DataFrame, roots: DataFrame) -> DataFrame:
    """``(row_id, field_name, normal_value)`` of the ``date`` and ``year`` values that are not in normal form yet.

    A time without a zone is on the clock of its root; the zone of a root that has none is estimated (missing_zones).

    Values that denote no existing date, nulls and blanks are no case; repeated rows give their cases again.
    """
    roots = missing_zones(df, roots, "processed_at")
    date_normal = F.col("date").rlike(r"^\d{4}-(0[1-9]|1[0-2])(-(0[1-9]|1\d|2[0-8]))?$")
    year_normal = F.col("year").rlike(r"^[1-9]\d{3}$")
    d = df.select("row_id", "file_path", F.when(~date_normal, F.col("date")).alias("date"), F.when(~year_normal, F.col("year")).alias("year"))
    dated = d.where(F.trim("date") != "").select("row_id", "file_path", F.col("date").alias("was"))
    dated = normal_dates(with_root(dated, "file_path", roots, "time_zone", "_tz"), "was", "normal_value", "_tz").select("row_id", F.lit("date").alias("field_name"), "was", "normal_value")
    years = normal_years(d.where(F.trim("year") != "").select("row_id", F.col("year").alias("was")), "was", "normal_value")
    both = dated.unionByName(years.select("row_id", F.lit("year").alias("field_name"), "was", "normal_value"))
    return both.where(F.col("normal_value").isNotNull() & (F.col("was") != F.col("normal_value"))).select("row_id", "field_name", "normal_value")
