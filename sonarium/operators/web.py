"""Fields from pages and payloads, and their consensus over domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.text import html_text, key_evidence, squeeze
from sonarium.functions.validity import first_of

CELL = r"(?is)<tr[^>]*>\s*<t[hd][^>]*>(.*?)</t[hd]>\s*<t[hd][^>]*>(.*?)</t[hd]>"
TERM = r"(?is)<dt[^>]*>(.*?)</dt>\s*<dd[^>]*>(.*?)</dd>"
ITEM = r"""(?is)<\w+[^>]*itemprop=["']([^"']+)["'][^>]*>(.*?)</"""
LD = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
TAG = r"(?s)<[^>]+>"


def host(url: Column) -> Column:
    """The host of an address, lower case, without www; null for what is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://([^/:?#\s]+)", 1)), r"^www\.", "")


def allowed(url: Column, domains: list[str]) -> Column:
    """P-11: whether the host is an allowed domain or below one."""
    h = host(url)
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))


def redirect_target(url: Column, parameter: str = "uddg") -> Column:
    """S-16: the address that a search result's redirect carries, else the address itself."""
    inner = F.regexp_extract(url, rf"[?&]{parameter}=([^&#]+)", 1)
    return F.when(inner != "", F.try_url_decode(inner)).otherwise(url)


def distinct_urls(df: DataFrame, entity: str, most: int) -> DataFrame:
    """S-17: each entity's addresses without fragments, each once in the order seen, the first ``most``."""
    once = df.withColumn("url", F.substring_index("url", "#", 1)).groupBy(entity, "url").agg(F.min("seq").alias("seq"))
    lists = once.groupBy(entity).agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "url"))), 1, most).alias("l"))
    return lists.select(entity, F.posexplode("l").alias("pos", "u")).select(entity, (F.col("pos") + 1).alias("pos"), "u.url")


def meta_content(html: Column, *names: str) -> Column:
    """H-02: the content of the first of the named meta elements that has one."""
    def one(n):
        a = F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:name|property)=["']{n}["'][^>]*content=["']([^"']*)["']""", 1)
        b = F.regexp_extract(html, rf"""(?is)<meta[^>]*content=["']([^"']*)["'][^>]*(?:name|property)=["']{n}["']""", 1)
        return F.coalesce(F.nullif(a, F.lit("")), b)

    return html_text(first_of(*[one(n) for n in names]))


def label_pairs(html: Column) -> Column:
    """H-03: (label, value) structs of table rows, definition lists and item properties, in that order."""
    def pairs(p):
        return F.zip_with(F.regexp_extract_all(html, F.lit(p), F.lit(1)), F.regexp_extract_all(html, F.lit(p), F.lit(2)), lambda a, b: F.struct(html_text(F.regexp_replace(a, TAG, " ")).alias("label"), html_text(F.regexp_replace(b, TAG, " ")).alias("value")))

    return F.filter(F.concat(pairs(CELL), pairs(TERM), pairs(ITEM)), lambda x: (x["label"] != "") & (x["value"] != ""))


def page_label_field(label: Column, labels: dict[str, list[str]]) -> Column:
    """J-14: the field a page's label means: an exact label first, then one it ends with, in the order declared."""
    l = F.lower(F.regexp_replace(squeeze(label), r"\s*:$", ""))
    exact = [F.when(l == w, F.lit(f)) for f, words in labels.items() for w in words]
    ends = [F.when(F.endswith(l, F.lit(" " + w)), F.lit(f)) for f, words in labels.items() for w in words]
    return F.coalesce(*exact, *ends)


def json_ld(html: Column) -> Column:
    """H-01: the JSON-LD blocks of a page as variants; a list gives its elements' text whole, broken ones are left out."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(LD), F.lit(1)), lambda t: F.trim(t)), lambda t: F.try_parse_json(t).isNotNull())


def text_field(html: Column, label: str, stop: list[str]) -> Column:
    """H-04: what stands after ``label:`` in a page's text, up to the next label."""
    text = squeeze(F.regexp_replace(html, TAG, " "))
    return html_text(F.regexp_extract(text, rf"(?i)\b{label}\s*[:\-]\s*(.{{1,120}}?)(?=\s+(?:{'|'.join(stop)})\s*[:\-]|[.;|]|$)", 1))


def page_fields(df: DataFrame, html: str, labels: dict[str, list[str]]) -> DataFrame:
    """H-05: ``(url, field, value)``: pairs before JSON-LD before meta elements, the first that is not blank for each field."""
    h = F.col(html)
    pairs = df.select("url", F.posexplode(label_pairs(h)).alias("pos", "p")).select("url", F.lit(0).alias("prio"), "pos", page_label_field(F.col("p.label"), labels).alias("field"), "p.value")
    block = F.col("b")
    ld = df.select("url", F.posexplode(json_ld(h)).alias("pos", "b"))
    paths = {"title": "$.name", "artist": "$.byArtist.name", "album": "$.inAlbum.name", "genre": "$.genre", "date": "$.datePublished", "isrc": "$.isrcCode"}
    ld = ld.select("url", F.lit(1).alias("prio"), "pos", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.get_json_object(block, p).alias("value")) for f, p in paths.items()])).alias("x")).select("url", "prio", "pos", "x.field", "x.value")
    metas = {"title": ("og:title", "title"), "artist": ("music:musician", "artist"), "album": ("music:album", "album"), "genre": ("music:genre", "genre")}
    meta = df.select("url", F.lit(2).alias("prio"), F.lit(0).alias("pos"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), meta_content(h, *n).alias("value")) for f, n in metas.items()])).alias("x")).select("url", "prio", "pos", "x.field", "x.value")
    every = pairs.unionByName(ld).unionByName(meta).where(F.col("field").isNotNull() & (F.coalesce("value", F.lit("")) != ""))
    return every.groupBy("url", "field").agg(F.min(F.struct("prio", "pos", "value"))["value"].alias("value"))


def consensus(evidence: DataFrame, entity: str) -> DataFrame:
    """A-11: per entity and field the value with the highest summed weight, each distinct domain voting once, then most domains, then the first seen.

    ``evidence(entity, seq, domain, field, value, weight)``; values are compared by their evidence key.
    """
    d = evidence.withColumn("k", key_evidence(F.col("field"), F.col("value"))).where(F.col("k") != "")
    first = d.groupBy(entity, "field", "k", "domain").agg(F.min(F.struct("seq", "value", "weight")).alias("m"))
    votes = first.groupBy(entity, "field", "k").agg(F.sum("m.weight").alias("score"), F.count(F.lit(1)).alias("n"), F.min("m.seq").alias("seq"), F.min(F.struct("m.seq", "m.value"))["value"].alias("value"), F.array_sort(F.collect_set("domain")).alias("domains"))
    best = votes.groupBy(entity, "field").agg(F.max(F.struct("score", "n", (-F.col("seq")).alias("o"), "value", "domains")).alias("b"))
    return best.select(entity, "field", "b.value", "b.score", F.col("b.domains").alias("domains"))


def best_artist(names: DataFrame, entity: str) -> DataFrame:
    """A-15, A-17: of ``names(entity, ord, name, score)`` the best spelling of the best name, first on ties at both levels."""
    from sonarium.functions.text import key_value

    per = names.groupBy(entity, key_value(F.col("name")).alias("k")).agg(F.max(F.struct("score", (-F.col("ord")).alias("o"), "name")).alias("b")).where(F.col("k") != "")
    return per.groupBy(entity).agg(F.max("b").alias("b")).select(entity, "b.name", "b.score")


def artist_walk(payload: Column) -> Column:
    """H-06: every text under a key that names an artist, anywhere in a JSON text, in order of appearance."""
    plain = F.regexp_extract_all(payload, F.lit(r'"(?:artist|artist_name|byArtist|creator)"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    nested = F.regexp_extract_all(payload, F.lit(r'"(?:artist|byArtist|creator|artists)"\s*:\s*\[?\s*\{[^{}]*?"name"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_distinct(F.filter(F.concat(plain, nested), lambda x: F.trim(x) != ""))


def first_path(payload: Column, paths: list[str]) -> Column:
    """R-06, R-16: the first path that is not blank; a list of texts is joined by commas."""
    def one(p):
        raw = F.get_json_object(payload, p)
        return F.when(F.startswith(raw, F.lit("[")), F.array_join(F.from_json(raw, "array<string>"), ", ")).otherwise(raw)

    return first_of(*[one(p) for p in paths])


def release_position(release: Column, title: Column) -> Column:
    """R-07: (track, disc) of the first track, over all media in order, whose title's key is that of ``title``; null if none."""
    from sonarium.functions.text import key_match

    media = F.from_json(F.get_json_object(release, "$.media"), "array<struct<position:int,tracks:array<struct<number:string,title:string>>>>")
    tracks = F.flatten(F.transform(media, lambda m: F.transform(m["tracks"], lambda t: F.struct(t["number"].alias("track"), m["position"].alias("disc"), t["title"].alias("title")))))
    return F.get(F.filter(tracks, lambda t: key_match(t["title"]) == key_match(title)), F.lit(0))


def contributors(relations: Column, roles: list[str]) -> Column:
    """R-08, R-09: distinct names of ``array<struct<type, name>>`` relations whose type is or holds a role, number marks dropped."""
    wanted = F.filter(relations, lambda r: F.exists(F.array(*[F.lit(x) for x in roles]), lambda x: F.contains(F.lower(r["type"]), x)))
    return F.array_distinct(F.transform(wanted, lambda r: F.trim(F.regexp_replace(r["name"], r"\s*\(\d+\)$", ""))))


def front_cover(images: Column) -> Column:
    """R-12: the address of the front image, else of the first, of ``array<struct<front, url>>``."""
    return F.coalesce(F.get(F.filter(images, lambda i: i["front"]), F.lit(0)), F.get(images, F.lit(0)))["url"]
