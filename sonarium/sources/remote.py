"""Manners of a remote source: retries, pace, a breaker; fetched pages; and what is planned to be written back."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonarium.functions.validity import first_of
from sonarium.operators.matching import plausible, recording_score, with_similarity
from sonarium.operators.votes import writable

# Attempts, the longest wait, the failures in a row after which a source rests, and answers worth another attempt.
ATTEMPTS, LONGEST, FAILURES, AGAIN = 3, 15.0, 5, (429, 500, 502, 503, 504)


def waiting(attempt: int, retry_after: str = "", longest: float = LONGEST, jitter: Callable[[float, float], float] = random.uniform) -> float:
    """M-10: seconds before the next attempt: what the answer asks for in digits, else two to the power of the attempt, not above
    ``longest``; and up to two seconds more by chance, so that many workers do not return in lockstep."""
    base = min(float(retry_after) if retry_after.isdigit() else 2.0**attempt, longest)
    return base + jitter(0.0, min(base, 2.0))


class Manners:
    """S-12, S-13, X-06, X-07: calls to one source with a least delay, attempts and a breaker; one object a worker process.

    ``call(request) -> (status, body, headers)`` may raise. An answer of 404 is one without content; other answers that are no
    success are failures, as is a body that is no object or list. After ``failures`` of them in a row the source is not called any
    more. ``sleep`` and ``clock`` can be replaced in tests. State stays with the process: a pickled copy begins anew.
    """

    def __init__(self, call, delay: float = 0.0, attempts: int = ATTEMPTS, failures: int = FAILURES, sleep=time.sleep, clock=time.monotonic):
        self.call, self.delay, self.attempts, self.failures, self.sleep, self.clock = call, delay, attempts, failures, sleep, clock
        self.last, self.failed = None, 0

    def __getstate__(self):
        return self.__dict__ | {"last": None, "failed": 0}

    def open(self) -> bool:
        """Whether the breaker is open."""
        return self.failed >= self.failures

    def _paced(self) -> None:
        if self.delay > 0:
            if self.last is not None and self.delay > self.clock() - self.last:
                self.sleep(self.delay - (self.clock() - self.last))
            self.last = self.clock()

    def __call__(self, request: dict) -> dict | list | None:
        """The body of a success, an empty object for 404, None for a failure or an open breaker."""
        if self.open():
            return None
        for attempt in range(self.attempts):
            self._paced()
            try:
                status, body, headers = self.call(request)
            except Exception:  # noqa: BLE001  a connection that failed
                status, body, headers = 0, None, {}
            more = attempt + 1 < self.attempts
            if more and (status == 0 or status in AGAIN):
                self.sleep(waiting(attempt, str(headers.get("Retry-After", ""))))
                continue
            if status == 404 or (200 <= status < 300 and isinstance(body, (dict, list))):
                self.failed = 0
                return {} if status == 404 else body
            break
        self.failed += 1
        return None


def fetched_pages(urls: DataFrame, fetch: Callable[[str], tuple[int, str, str]], delay: float = 0.0) -> DataFrame:
    """S-18: ``(url, html)`` of the addresses in ``urls(url)`` that answer with a page; ``fetch(url) -> (status, content type, text)``.

    Each distinct address is fetched once, per Arrow batch, paced within a task; what fails or is no HTML is left out. Which addresses may
    be fetched, and how many, is a filter before (allowed, first_gated).
    """

    def run(batches: Iterable[pd.DataFrame]):
        last = None
        for pdf in batches:
            rows = []
            for url in pdf["url"]:
                if delay and last is not None:
                    time.sleep(max(0.0, delay - (time.monotonic() - last)))
                last = time.monotonic()
                try:
                    status, kind, text = fetch(url)
                except Exception:  # noqa: BLE001  a page that cannot be read is no evidence
                    continue
                if 200 <= status < 300 and "text/html" in kind:
                    rows.append((url, text))
            yield pd.DataFrame(rows, columns=["url", "html"])

    return urls.select("url").where(F.col("url").isNotNull()).distinct().mapInPandas(run, "url string, html string")


def identified_pages(pages: DataFrame, candidates: DataFrame, entity: str, least_title: float = 0.62, least_artist: float = 0.55) -> DataFrame:
    """P-13: ``(entity, url, identity)`` of the pages that name both the title and the artist of one of the entity's candidates well
    enough, with the highest weighted similarity; ``pages(entity, url, title, artist)``, ``candidates(entity, title, artist)``.

    A page without a title or an artist is no evidence. A candidate without an artist is held to its title.
    """
    there = pages.where((F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("artist", F.lit(""))) != ""))
    d = there.join(candidates.select(entity, F.col("title").alias("_ct"), F.col("artist").alias("_ca")).distinct(), entity)
    d = with_similarity(with_similarity(d, "_ct", "title", "title_score"), "_ca", "artist", "artist_score")
    d = d.withColumn("artist_score", F.when(F.trim(F.coalesce("_ca", F.lit(""))) == "", 0.65).otherwise(F.col("artist_score")))
    kept = d.where(plausible(F.col("title_score"), F.col("artist_score"), least_title, least_artist))
    return kept.groupBy(entity, "url").agg(F.max(0.60 * F.col("title_score") + 0.40 * F.col("artist_score")).alias("identity"))


def recording_chain(wanted: DataFrame, recordings: DataFrame, releases: DataFrame, works: DataFrame, entity: str, least: float = 0.45) -> DataFrame:
    """J-13: per entity of ``wanted(entity, title, artist)`` the best recording, its first release and the contributors of its work.

    ``recordings(entity, seq, recording_id, title, artist, api_score, release_id, work_id)``, ``releases(release_id, album, date, track, disc)``
    and ``works(work_id, composer)`` hold one row an id. Recordings whose title, or artist where one is wanted, is less than
    ``least`` alike are none; the rest rank by T-02, the first on ties. Releases and works are left joins: what they lack is null.
    """
    d = wanted.select(entity, F.col("title").alias("_wt"), F.coalesce("artist", F.lit("")).alias("_wa")).join(recordings, entity)
    d = with_similarity(with_similarity(d, "_wt", "title", "_ts"), "_wa", "artist", "_as")
    d = d.withColumn("_as", F.when(F.trim("_wa") == "", 0.65).otherwise(F.col("_as"))).where((F.col("_ts") >= least) & ((F.trim("_wa") == "") | (F.col("_as") >= least)))
    d = d.withColumn("score", recording_score(F.col("api_score"), F.col("_ts"), F.col("_as")))
    kept = ("recording_id", "title", "artist", "release_id", "work_id", "score")
    best = d.groupBy(entity).agg(F.max_by(F.struct(*kept), F.struct("score", -F.col("seq"))).alias("b")).select(entity, "b.*")
    return best.join(releases, "release_id", "left").join(works, "work_id", "left")


# The suffixes whose tags can be written, by the way they are.
WRITERS = {".mp3": "id3", ".mp4": "mp4", ".m4a": "mp4", ".aac": "mp4"}


def write_plan(merged: DataFrame, least: float) -> DataFrame:
    """K-14: ``(path, writer, field, value)``: what a writer has to set: the fields sure enough and different (P-06), a date rather than
    its year, of files whose kind has a writer. ``merged(path, fields, field_confidence, tags)``; the plan is executed outside, and read back by P-07."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    writer = F.coalesce(*[F.when(suffix == s, w) for s, w in WRITERS.items()])
    d = merged.select("path", writer.alias("writer"), writable(F.col("fields"), F.col("field_confidence"), F.coalesce("tags", F.create_map().cast("map<string,string>")), least).alias("w")).where(F.col("writer").isNotNull())
    d = d.withColumn("w", F.map_filter("w", lambda k, v: (k != "year") | ~F.map_contains_key("w", F.lit("date"))))
    return d.select("path", "writer", F.explode("w").alias("field", "value"))


def joined(payload: Column, *paths: str) -> Column:
    """R-05, R-16: the first of the paths that is not blank; one with ``[*]`` gives all its texts, joined by commas."""
    def one(p: str) -> Column:
        raw = F.get_json_object(payload, p)
        if "[*]" not in p:
            return raw
        # one match comes as the text itself, several as a list
        return F.when(F.startswith(raw, F.lit("[")), F.array_join(F.filter(F.from_json(raw, "array<string>"), lambda x: F.trim(x) != ""), ", ")).otherwise(F.regexp_replace(raw, '^"|"$', ""))

    return first_of(*[one(p) for p in paths])


# Where the payloads of public catalogues keep their fields; of several paths the first that is not blank.
PAYLOADS = {
    "itunes": {"title": "$.trackName", "artist": "$.artistName", "album": "$.collectionName", "album_artist": "$.collectionArtistName $.artistName", "genre": "$.primaryGenreName", "date": "$.releaseDate", "track_number": "$.trackNumber", "disc_number": "$.discNumber", "cover_art_url": "$.artworkUrl100"},
    "deezer": {"title": "$.title", "artist": "$.artist.name", "album": "$.album.title", "track_number": "$.track_position", "disc_number": "$.disk_number", "isrc": "$.isrc", "bpm": "$.bpm", "date": "$.release_date", "cover_art_url": "$.album.cover_xl $.album.cover_big"},
    "deezer_album": {"album_artist": "$.artist.name", "genre": "$.genres.data[0].name", "date": "$.release_date"},
    "lastfm": {"title": "$.name", "artist": "$.artist.name", "album": "$.album.title", "genre": "$.toptags.tag[0].name", "cover_art_url": "$.album.image[3].#text $.album.image[2].#text $.album.image[1].#text $.album.image[0].#text"},
    "genius": {"title": "$.title", "artist": "$.primary_artist.name", "cover_art_url": "$.song_art_image_url"},
    "spotify": {"title": "$.name", "artist": "$.artists[*].name", "album": "$.album.name", "album_artist": "$.album.artists[*].name", "date": "$.album.release_date", "track_number": "$.track_number", "disc_number": "$.disc_number", "isrc": "$.external_ids.isrc", "cover_art_url": "$.album.images[0].url"},
    "acoustid": {"title": "$.recordings[0].title", "artist": "$.recordings[0].artists[*].name", "album": "$.recordings[0].releases[0].title", "date": "$.recordings[0].releases[0].date.year"},
    "discogs": {"album": "$.title", "year": "$.year", "genre": "$.genre[*] $.style[*]", "label": "$.label[*]", "catalog_number": "$.catno[*] $.catno", "cover_art_url": "$.cover_image"},
    "discogs_release": {"album": "$.title", "year": "$.year", "date": "$.released", "genre": "$.genres[*]", "subgenre": "$.styles[*]", "label": "$.labels[*].name", "catalog_number": "$.labels[*].catno"},
    "wikidata": {"analysis_summary": "$.description"},
    "musicbrainz": {"title": "$.title", "artist": "$.artist-credit[*].name", "album": "$.releases[0].title", "date": "$.first-release-date $.releases[0].date", "isrc": "$.isrcs[0]", "genre": "$.tags[0].name"},
    "cover_art_archive": {"cover_art_url": "$.images[0].image"},
    "sonoteller": {"genre": "$.genres[*]", "subgenre": "$.subgenres[*]", "moods": "$.moods[*]", "instruments": "$.instruments[*]", "themes": "$.themes[*]", "language": "$.language", "bpm": "$.bpm", "key": "$.key"},
}


def projected(provider: str, payload: Column) -> Column:
    """G-02, R-05: a provider's payload as a map of tag fields, blanks dropped; the year of a date where none is given.

    Paths with a hyphen or a number sign are quoted for the JVM's path reader.
    """
    step = lambda x: re.sub(r"^([^\[]+)", r"['\1']", x) if ("-" in x or "#" in x) else f".{x}"
    quoted = lambda p: "$" + "".join(map(step, p[2:].split(".")))
    fields = {f: joined(payload, *map(quoted, paths.split())) for f, paths in PAYLOADS[provider].items()}
    if "date" in fields and "year" not in fields:
        fields["year"] = F.substring(fields["date"], 1, 4)
    return F.map_filter(F.create_map(*[x for f, v in fields.items() for x in (F.lit(f), v)]), lambda _, v: F.coalesce(F.trim(v), F.lit("")) != "")
