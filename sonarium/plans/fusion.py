"""Queries on votes, matching and the catalogue, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonarium.functions import text
from sonarium.operators import catalog, matching, votes
from sonarium.session import table


def _ballots(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    source = F.concat(F.lit("s"), (F.col("event_id") % 7).cast("string"))
    weight = ((F.col("event_id") % 7 + 1) * 0.1).cast("decimal(18,4)")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("field"), (k % 5).cast("string").alias("value"), source.alias("source"), weight.alias("weight"), F.col("event_id").alias("seq"))


_BALLOTS = """b AS (SELECT user_id AS entity, event_type AS field, CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS value, 's' || (event_id % 7) AS source,
  CAST((event_id % 7 + 1) * 0.1 AS DECIMAL(18,4)) AS weight, event_id AS seq FROM events),
t AS (SELECT entity, field, value, SUM(weight) AS score, MIN(seq) AS first_seq, list_sort(list(DISTINCT source)) AS sources FROM b GROUP BY ALL)"""


def vote_merge(spark, sf_dir):
    won = votes.winners(votes.tally(_ballots(spark, sf_dir), "entity"), "entity")
    return won.select("entity", "field", "value", F.col("score").cast("double").alias("score"), "sources")


def vote_conflicts(spark, sf_dir):
    return votes.conflicts(votes.tally(_ballots(spark, sf_dir), "entity"), "entity").select("entity", "field", F.col("n_keys").cast("int").alias("n_keys"))


def vote_report_sources(spark, sf_dir):
    """Provenance of the report's own fields: how often each provider backs each field."""
    d = table(spark, sf_dir, "smoke_final_completed").select("row_id", F.explode(F.from_json("sources", "map<string,string>")).alias("field", "s"))
    d = d.select("field", F.explode(F.split("s", ", ")).alias("provider"))
    return d.groupBy("field", "provider").agg(F.count(F.lit(1)).alias("n"))


def missing_required(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed").select("row_id", "title", "genre", "composer", "language", "has_cover_art")
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in ("title", "genre", "composer", "language")]), F.array(*[F.coalesce(c, F.lit("")) for c in ("title", "genre", "composer", "language")]))
    gone = votes.missing_required(["title", "genre", "composer", "language", "cover_art"], m, F.create_map().cast("map<string,string>"), F.col("has_cover_art") == "yes")
    return d.select("row_id", F.array_join(gone, "; ").alias("missing")).where(F.col("missing") != "")


def provider_overlay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    media = e.select(F.col("user_id").cast("string").alias("path")).distinct().withColumn("tags", F.create_map(F.lit("title"), F.lit("none"), F.lit("year"), F.lit("0")))
    evidence = e.select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), (F.col("event_id") % 10 / 10.0).alias("confidence"), F.create_map(F.lit("title"), F.col("event_type")).alias("fields"))
    return votes.provider_overlay(media, evidence, ["title"]).select("path", F.col("tags")["title"].alias("title"), F.col("tags")["year"].alias("year"))


def canonical_keys(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed")
    t = F.coalesce("title", F.lit(""))
    return d.select("row_id", text.key_plain(t).alias("plain"), text.key_match(t).alias("matched"), text.key_genre(F.coalesce("genre", F.lit(""))).alias("genre_key"))


def title_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed").select("row_id", text.split_pair(text.clean_track(F.col("filename"))).alias("p"))
    return d.select("row_id", "p.artist", "p.title").where(F.col("artist") != "")


def candidate_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed")
    pairs = matching.candidate_pairs(F.col("filename"), F.col("title"), F.col("artist"), F.col("album"))
    return d.select("row_id", F.posexplode(pairs).alias("pos", "p")).select("row_id", "pos", "p.artist", "p.title")


def candidate_top1(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", text.key_match("p_name").alias("k"))
    p = p.withColumn("block", F.element_at(F.split("k", " "), -1))
    names = p.groupBy("block", "k").agg(F.min("p_partkey").alias("seq"))
    one = names.select("block", F.col("k").alias("l_k"), F.col("seq").alias("l_id")).join(names.select("block", "k", "seq"), "block").where(F.col("k") != F.col("l_k"))
    near = 1 - F.levenshtein("l_k", "k") / F.greatest(F.length("l_k"), F.length("k"))
    scored = one.withColumn("title_score", F.coalesce(matching.containment(F.col("l_k"), F.col("k")), near)).withColumn("artist_score", F.lit(0.65))
    return matching.best_candidates(scored.select("l_id", "seq", "title_score", "artist_score"), "l_id").select("l_id", "seq", F.round("score", 6).alias("score"))


def match_reports(spark, sf_dir):
    """J-05, P-12, T-01: for each report row the most similar plausible row of the other report, by title and artist."""
    left, right = (table(spark, sf_dir, n).select("row_id", "title", "artist") for n in ("smoke_final_completed", "smoke_final_no_blanks"))
    m = matching.match_blocked(left, right, "row_id", "row_id", "title", "artist")
    return m.select(F.col("l_row_id").alias("row_id"), F.col("r_row_id").alias("match_id"), F.round("score", 6).alias("score"))


def similarity_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed").select("row_id", "artist", "album_artist")
    return matching.with_similarity(d, "artist", "album_artist", "s").select("row_id", F.round("s", 6).alias("s"))


def _catalog(spark, sf_dir):
    return catalog.dimension(table(spark, sf_dir, "genre_catalog").select(F.col("genre_id").alias("ord"), "name"))


def catalog_lookup(spark, sf_dir):
    values = table(spark, sf_dir, "smoke_final_completed").select(F.col("genre").alias("value")).where(F.col("value").isNotNull())
    return catalog.lookup(values, _catalog(spark, sf_dir))


def catalog_lists(spark, sf_dir):
    return catalog.normalise_lists(table(spark, sf_dir, "smoke_final_completed"), "row_id", "genre", _catalog(spark, sf_dir))


#: Rules for the tests and queries; the rules of a library are a parameter.
RULES = [("techno", {"mood": "driving", "energy": "very high"}), ("folk", {"mood": "earthy"}), ("metal", {"mood": "fierce", "energy": "very high"}), ("blues", {"mood": "wistful", "energy": "soft"}), ("choir", {"mood": "solemn", "weather": "snow"}), ("house", {"energy": "steady"})]


def keyword_rules(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed")
    return catalog.keyword_rules(d, "row_id", F.lower(F.concat_ws(" ", "genre", "subgenre")), RULES)


def completion_cascade(spark, sf_dir):
    d = table(spark, sf_dir, "smoke_final_completed").select("row_id", *[F.when(~F.lower(F.trim(c)).isin("needs_review", "unknown", "n/a", "-"), F.col(c)).alias(c) for c in ("artist", "album_artist", "composer", "label", "publisher")])
    filled = catalog.fill_rules(d, [("album_artist", F.col("artist")), ("label", F.col("publisher")), ("publisher", F.col("label")), ("label", F.col("album_artist")), ("composer", F.col("artist"))])
    return filled.select("row_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("album_artist", "composer", "label", "publisher")])


QUERIES = {
    "vote_merge": vote_merge, "vote_conflicts": vote_conflicts, "vote_report_sources": vote_report_sources, "missing_required": missing_required, "provider_overlay": provider_overlay,
    "canonical_keys": canonical_keys, "title_pairs": title_pairs, "candidate_pairs": candidate_pairs, "candidate_top1": candidate_top1, "similarity_pairs": similarity_pairs, "match_reports": match_reports,
    "catalog_lookup": catalog_lookup, "catalog_lists": catalog_lists, "keyword_rules": keyword_rules, "completion_cascade": completion_cascade,
}

_PLAIN = "trim(regexp_replace(replace({0}, '&', ' and '), '[^a-z0-9]+', ' ', 'g'))"
_GENRE_KEY = _PLAIN.format("replace(replace(lower({0}), 'hiphop', 'hip hop'), 'rnb', 'r and b')")
_MATCH = _PLAIN.format(r"regexp_replace(regexp_replace(lower({0}), '\[[^\]]+\]|\([^)]+\)', ' ', 'g'), '\b(official|video|audio|lyrics?|visualizer|remaster(ed)?|radio edit)\b', ' ', 'g')")
_CASES = "\nUNION ALL ".join(f"SELECT row_id, {i} AS ord, '{w}' AS keyword, '{f}' AS field, '{v}' AS value FROM g WHERE contains(t, '{w}')" for i, (w, s) in enumerate(RULES) for f, v in s.items())
_ABSENT = "lower(trim({0})) NOT IN ('needs_review', 'unknown', 'n/a', '-')"

SQL = {
    "vote_merge": f"WITH {_BALLOTS} SELECT entity, field, value, CAST(least(score, 1) AS DOUBLE) AS score, array_to_string(sources, ', ') AS sources FROM (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY score DESC, first_seq) AS rn FROM t) WHERE rn = 1",
    "vote_conflicts": f"WITH {_BALLOTS} SELECT entity, field, CAST(count(*) AS INTEGER) AS n_keys FROM t GROUP BY ALL HAVING count(*) > 1",
    "vote_report_sources": """WITH k AS (SELECT sources, unnest(json_keys(sources)) AS field FROM smoke_final_completed WHERE json_valid(sources) AND sources <> ''),
        p AS (SELECT field, unnest(string_split(json_extract_string(sources, '$."' || field || '"'), ', ')) AS provider FROM k) SELECT field, provider, count(*) AS n FROM p GROUP BY ALL""",
    "missing_required": """SELECT row_id, missing FROM (SELECT row_id, array_to_string(list_filter([CASE WHEN coalesce(title,'')='' THEN 'title' END, CASE WHEN coalesce(genre,'')='' THEN 'genre' END,
        CASE WHEN coalesce(composer,'')='' THEN 'composer' END, CASE WHEN coalesce(language,'')='' THEN 'language' END, CASE WHEN has_cover_art<>'yes' THEN 'cover_art' END], lambda x: x IS NOT NULL), '; ') AS missing FROM smoke_final_completed) WHERE missing <> ''""",
    "provider_overlay": "SELECT CAST(user_id AS VARCHAR) AS path, coalesce(arg_max(event_type, event_id) FILTER (WHERE event_id % 10 / 10.0 >= 0.6), 'none') AS title, '0' AS year FROM events GROUP BY user_id",
    "canonical_keys": f"SELECT row_id, {_PLAIN.format("lower(replace(coalesce(title, chr(32)), 'İ', 'i' || chr(775)))")} AS plain, {_MATCH.format("replace(coalesce(title, chr(32)), 'İ', 'i' || chr(775))")} AS matched, {_GENRE_KEY.format('coalesce(genre, chr(32))')} AS genre_key FROM smoke_final_completed",
    "catalog_lookup": f"""WITH v AS (SELECT DISTINCT genre AS value, {_GENRE_KEY.format('genre')} AS key FROM smoke_final_completed WHERE genre IS NOT NULL), c AS (SELECT genre_id AS ord, name, {_GENRE_KEY.format('name')} AS k FROM genre_catalog),
        s AS (SELECT value, name, ord, CASE WHEN key = k THEN 9 ELSE len(list_intersect(string_split(key, ' '), string_split(k, ' '))) / greatest(len(list_distinct(string_split(key, ' '))), len(list_distinct(string_split(k, ' '))))
          + CASE WHEN contains(key, k) OR contains(k, key) THEN 0.25 ELSE 0 END END AS score, len(list_intersect(string_split(key, ' '), string_split(k, ' '))) AS shared FROM v, c WHERE key <> ''),
        b AS (SELECT value, arg_min(name, {{'s': -score, 'o': ord}}) AS name FROM s WHERE shared > 0 AND score >= 0.80 GROUP BY value) SELECT v.value, b.name FROM v LEFT JOIN b USING (value)""",
    "keyword_rules": f"WITH g AS (SELECT row_id, lower(concat_ws(' ', genre, subgenre)) AS t FROM smoke_final_completed), h AS ({_CASES}) SELECT row_id, field, arg_min(value, ord) AS value, arg_min(keyword, ord) AS keyword FROM h GROUP BY row_id, field",
    "candidate_top1": """WITH n AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS k, min(p_partkey) AS seq FROM part GROUP BY 1), b AS (SELECT *, string_split(k, ' ')[-1] AS block FROM n),
        p AS (SELECT l.seq AS l_id, r.seq, CASE WHEN contains(l.k, r.k) OR contains(r.k, l.k) THEN greatest(0.7, least(length(l.k), length(r.k)) / greatest(length(l.k), length(r.k))) ELSE 1 - levenshtein(l.k, r.k) / greatest(length(l.k), length(r.k)) END AS t FROM b l JOIN b r ON l.block = r.block AND l.k <> r.k)
        SELECT l_id, arg_max(seq, {'t': t, 's': -seq}) AS seq, round(0.6 * max(t) + 0.4 * 0.65, 6) AS score FROM p WHERE t >= 0.55 GROUP BY l_id""",
    "completion_cascade": "WITH a AS (SELECT row_id, " + ", ".join(f"nullif(trim(CASE WHEN {_ABSENT.format(c)} THEN {c} END), '') AS {c}" for c in ("artist", "album_artist", "composer", "label", "publisher")) + " FROM smoke_final_completed) "
        "SELECT row_id, coalesce(album_artist, artist, '') AS album_artist, coalesce(composer, artist, '') AS composer, coalesce(label, publisher, album_artist, artist, '') AS label, coalesce(publisher, label, '') AS publisher FROM a",
    "title_pairs": rf"""WITH s AS (SELECT row_id, replace(regexp_replace(regexp_replace(filename, '^(?s:.*)/', ''), '(.)\.[^. /]*$', '\1'), '_', ' ') AS s FROM smoke_final_completed),
        t AS (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(s, '(?i)\[[^\]]+\]|\([^)]+\)|\b(?:{'|'.join(text.NOISE_WORDS)})\b|\b(?:{'|'.join(text.KINDS)})\b|\b\d{{3,}}\s*kbps\b', ' ', 'g'), '\s+', ' ', 'g'), '^[ \-_]+|[ \-_]+$', '', 'g') AS t FROM s),
        p AS (SELECT row_id, CASE WHEN regexp_matches(t, '^.*?\S.*?\s+-\s+.*\S') THEN ' - ' WHEN regexp_matches(t, '\s+--\s+') THEN ' -- ' WHEN regexp_matches(t, '\s+\|\s+') THEN ' | ' END AS sep, t FROM t)
        SELECT row_id, trim(split_part(t, sep, 1)) AS artist, trim(substr(t, strpos(t, sep) + length(sep))) AS title FROM p WHERE sep IS NOT NULL AND trim(split_part(t, sep, 1)) <> ''""",
}
