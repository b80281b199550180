"""Several values packed in one field: one row per value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiters; a slash counts only between blanks, so that ``sad/happy`` stays whole.
DELIMITER = r"[,;|·\t\n\r]|(?<=\s)/(?=\s)"
#: A quoted span: at the start of a part, its closing quote at the end of the part; inside, a doubled quote stands for one.
SPAN = (
    r"((?:^|[,;|·\t\n\r]|(?<=\s)/(?=\s))\s*)"
    r"""("(?:[^"]|"")*+"|'(?:[^']|''|'(?!\s*(?:$|[,;|·\t\n\r]|/\s)))*+')"""
    r"(?=\s*(?:$|[,;|·\t\n\r]|(?<=\s)/\s))"
)
#: Marks of a placeholder, from the private use area. Where the first stands in the data it is escaped, so no text can collide.
OPEN, CLOSE = "\ue000", "\ue001"
ESCAPED = OPEN + "x" + CLOSE
EDGE = r"(?U)^\s+|\s+$"


def _without_quotes(span: Column) -> Column:
    quote = F.substring(span, 1, 1)
    inner = span.substr(F.lit(2), F.length(span) - 2)
    return F.regexp_replace(F.replace(inner, F.concat(quote, quote), quote), EDGE, "")


def with_values(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out`` array<string>: the values in the string column ``value``, in order.

    Quoted spans are replaced by indexed placeholders, the rest is split at the delimiters, and the spans come back by
    array lookup. A JSON array of strings is read as quoted parts. Null gives null, an empty or blank text an empty array;
    parts that are empty, within quotes too, are skipped. The steps are projections of their own, so that the spans are
    found once a row and not once a part; texts without a quote mark skip the search for spans.
    """
    T = {n: f"_packed_{out}_{n}" for n in ("text", "spans", "leads", "masked", "parts")}  # names that no caller's column has
    if set(T.values()) & set(df.columns):
        raise ValueError(f"columns named like intermediate ones: {sorted(set(T.values()) & set(df.columns))}")
    raw = F.col(value)
    body = F.regexp_replace(F.regexp_replace(raw, r"^\s*\[|\]\s*$", ""), r'\\"', '""')
    body = F.regexp_replace(body, r"\\\\", r"\\")
    text = F.when(raw.rlike(r'^\s*\[\s*".*"\s*\]\s*$'), body).otherwise(raw)
    text = F.replace(text, F.lit(OPEN), F.lit(ESCAPED))
    quoted = F.col(T["text"]).rlike("[\"']")
    none = F.array().cast("array<string>")
    masked = F.array_join(
        F.transform(
            F.split(T["text"], SPAN, -1),
            lambda p, i: F.when(i < F.size(T["spans"]), F.concat(p, F.get(T["leads"], i), F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p),
        ),
        "",
    )

    def restored(part: Column) -> Column:
        index = F.regexp_extract(part, f"^{OPEN}([0-9]+){CLOSE}$", 1)
        return F.when(index != "", F.get(T["spans"], index.try_cast("int"))).otherwise(part)

    split = F.transform(F.split(T["masked"], DELIMITER, -1), lambda p: F.regexp_replace(p, EDGE, ""))
    return (
        df.withColumn(T["text"], text)
        .withColumn(T["spans"], F.when(quoted, F.regexp_extract_all(T["text"], F.lit(SPAN), F.lit(2))).otherwise(none))
        .withColumn(T["leads"], F.when(F.size(T["spans"]) > 0, F.regexp_extract_all(T["text"], F.lit(SPAN), F.lit(1))).otherwise(none))
        .withColumn(T["masked"], F.when(F.size(T["spans"]) > 0, masked).otherwise(F.col(T["text"])))
        .withColumn(T["spans"], F.transform(T["spans"], _without_quotes))
        .withColumn(T["parts"], split)
        .withColumn(out, F.filter(F.transform(T["parts"], lambda p: F.replace(restored(p), F.lit(ESCAPED), F.lit(OPEN))), lambda x: x != ""))
        .drop(T["text"], T["spans"], T["leads"], T["masked"], T["parts"])
    )


def unpack_fields(df: DataFrame, key: str, fields: list[str], least: int = 2) -> DataFrame:
    """``(key, field_name, pos, item_text)``: each value of each field that holds ``least`` or more, positions from 1.

    Repeated rows give their values again; null and empty fields give none; other columns, whatever their names, are
    dropped first. The plan is one scan with two narrow generates, without a shuffle.
    """
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])
    long = df.select(F.col(key).alias("_key"), F.explode(values).alias("f")).select("_key", "f.field_name", F.col("f.value").alias("_value"))
    long = with_values(long.where(F.col("_value") != ""), "_value", "_items")
    return long.where(F.size("_items") >= least).select(F.col("_key").alias(key), "field_name", F.posexplode("_items").alias("_p", "item_text")).select(
        key, "field_name", (F.col("_p") + 1).alias("pos"), "item_text"
    )
