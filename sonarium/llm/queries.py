"""Queries p1 to p9 of the optional problems, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.llm import garbled, names, packing, spans, survivors, tokens, vocabulary
from sonarium.schema import FINAL_COLUMNS
from sonarium.session import stored, table

#: Every column of the report; those that state something about a whole row have rules of their own in merged_records.
FIELDS = list(FINAL_COLUMNS)


def _recordings(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed")
    return stored(survivors.recordings(d, p5_entities(spark, sf_dir)), "recordings")


def p1_found(spark, sf_dir):
    scores = table(spark, sf_dir, "smoke_final_no_blanks")
    return survivors.best_rows(table(spark, sf_dir, "smoke_final_completed"), _recordings(spark, sf_dir), scores)


def p1_records(spark, sf_dir):
    """One merged record for each recording, field by field."""
    scores = table(spark, sf_dir, "smoke_final_no_blanks")
    return survivors.merged_records(table(spark, sf_dir, "smoke_final_completed"), _recordings(spark, sf_dir), scores, FIELDS)


def p2_values(spark, sf_dir):
    """Every case with its value and score."""
    return vocabulary.mapped_fields(table(spark, sf_dir, "smoke_final_completed"), table(spark, sf_dir, "genre_catalog"))


def p2_found(spark, sf_dir):
    return p2_values(spark, sf_dir).select("row_id", "field_name", "genre_id").distinct()


def p4_repairs(spark, sf_dir):
    """Every wrongly decoded value with what could be restored; statistics over both tables."""
    report, media = table(spark, sf_dir, "smoke_final_completed"), table(spark, sf_dir, "media_inventory")
    texts = report.select(F.explode(F.array("title", "artist", "album")).alias("t")).union(media.select("tags_json"))
    stats = garbled.gather(texts, ["t"])
    a = garbled.repaired(report, "row_id", ["title", "artist", "album"], stats).withColumnRenamed("row_id", "record_id")
    b = garbled.repaired(media, "scan_id", ["tags_json"], stats).withColumnRenamed("scan_id", "record_id")
    return a.select(F.lit("smoke_final_completed").alias("table_name"), "*").unionByName(b.select(F.lit("media_inventory").alias("table_name"), "*"))


def p4_found(spark, sf_dir):
    return p4_repairs(spark, sf_dir).select("table_name", "record_id", "field_name")


def p5_entities(spark, sf_dir):
    """Every spelling with the entity it names."""
    d = table(spark, sf_dir, "smoke_final_completed")
    return names.link(d.select(F.explode(F.array("artist", "album_artist", "composer")).alias("name")))


def p5_found(spark, sf_dir):
    return names.pairs(p5_entities(spark, sf_dir))


def p7_ids(spark, sf_dir):
    return tokens.encode_column(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_containers(spark, sf_dir):
    return packing.pack(tokens.count_column(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 2048)


def p8_report(spark, sf_dir):
    return packing.packing_report(p8_containers(spark, sf_dir), 2048)


def p8_budgeted(spark, sf_dir):
    """Containers of twice the tokens in which the number of texts and the attention cost bind as well."""
    return packing.pack(tokens.count_column(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", 4096, most_items=24, most_cost=2048**2)


def p8_budget_report(spark, sf_dir):
    return packing.packing_report(p8_budgeted(spark, sf_dir), 4096)


def p9_found(spark, sf_dir):
    return spans.shared_chars(spans.shared_spans(table(spark, sf_dir, "documents"), "doc_id", "text", 200)).where(F.col("shared_chars") > 0)


QUERIES = {
    "p1_found": p1_found, "p1_records": p1_records, "p2_found": p2_found, "p2_values": p2_values, "p4_found": p4_found, "p4_repairs": p4_repairs,
    "p5_found": p5_found, "p5_entities": p5_entities, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_report": p8_report, "p8_budgeted": p8_budgeted, "p8_budget_report": p8_budget_report, "p9_found": p9_found,
}
SQL: dict[str, str] = {}
