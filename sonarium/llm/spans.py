"""Long exact spans shared between records."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonarium.llm.parsing import CONTEXT, GAP, Windows, boundaries, flatten

#: Characters of text that one block of numpy work holds, which bounds a worker's memory.
BLOCK = 1_000_000
#: Entries a task gathers before it sends them, one row a bucket.
GATHER = 1_500_000
#: Entries that one bucket should hold on average; the number of buckets follows the corpus.
BUCKET = 200_000


def _planes(values: np.ndarray) -> bytes:
    """Byte planes of an array: constant bytes stand together, and the shuffle's compression removes them."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


_ENTRY = "bucket int, direct boolean, keys binary, docs binary, places binary, extras binary"
_NAMES = ["bucket", "direct", "keys", "docs", "places", "extras"]


class _Sender:
    """Gathers entries (bucket, key, document, place, extra) and turns them into rows, one a bucket.

    A key that stands in several documents here is shared, whatever others hold: one of its entries goes to the key's
    bucket, marked, and the rest go as they are to a bucket that depends on this row alone. So a bucket gets a hot key at
    most once from each row, however many documents have it.
    """

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n, self.sent = buckets, [], 0, 0

    def add(self, bucket, key, doc, place, extra):
        self.held.append((bucket.astype(np.int32), key, doc.astype(np.int64), place.astype(np.int32), extra.astype(np.uint8)))
        self.n += len(key)
        return self.rows() if self.n >= GATHER else []

    def rows(self):
        if not self.n:
            return []
        bucket, key, doc, place, extra = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        order = np.lexsort((doc, key, bucket))
        bucket, key, doc, place, extra = bucket[order], key[order], doc[order], place[order], extra[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(key)) - 1
        many = doc[head] != doc[tail]
        group = np.cumsum(new) - 1
        shared = many[group]
        extra[head[many]] |= 0x80
        own = ~shared | new
        out = []
        cut = np.flatnonzero(np.diff(bucket[own])) + 1
        for b, part in zip(np.split(bucket[own], cut), np.split(np.flatnonzero(own), cut)):
            out.append((int(b[0]), False, part))
        rest = np.flatnonzero(shared & ~new)
        if len(rest):
            self.sent += 1
            out.append((int((int(key[rest[0]]) + self.sent) % self.buckets), True, rest))
        rows = [
            (b, direct, b"" if direct else _planes(key[i]), _planes(doc[i]), _planes(place[i]), extra[i].tobytes())
            for b, direct, i in out
        ]
        return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), *[pa.binary()] * 4))], names=_NAMES)]


def _shared(entries: DataFrame, buckets: int, collapse) -> DataFrame:
    """``(doc_id, begin int, end int)`` of the entries whose key stands in several documents; ``collapse`` turns them into spans.

    There is a partition for each bucket on average, so that tasks stay as they are while the corpus grows.
    """

    def reduce(group: pa.Table) -> pa.Table:
        keys, docs, places, extras, direct = [], [], [], [], []
        for d, k, o, p, e in zip(*(group.column(n).to_pylist() for n in ("direct", "keys", "docs", "places", "extras"))):
            (direct if d else keys).append(_unplanes(o, np.int64) if d else _unplanes(k, np.uint64))
            if d:
                direct[-1] = (direct[-1], _unplanes(p, np.int32), np.frombuffer(e, np.uint8))
            else:
                docs.append(_unplanes(o, np.int64)), places.append(_unplanes(p, np.int32)), extras.append(np.frombuffer(e, np.uint8))
        found = list(direct)
        if keys:
            key, doc, place, extra = np.concatenate(keys), np.concatenate(docs), np.concatenate(places), np.concatenate(extras)
            order = np.lexsort((doc, key))
            key, doc, place, extra = key[order], doc[order], place[order], extra[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(key)) - 1
            many = (doc[head] != doc[tail]) | (np.maximum.reduceat(extra, head) >= 0x80)
            own = many[np.cumsum(new) - 1]
            found.append((doc[own], place[own], extra[own]))
        if not found:
            found = [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8))]
        doc, place, extra = (np.concatenate(x) for x in zip(*found))
        doc, begin, end = collapse(doc, place, (extra & 0x7F).astype(np.int32))
        return pa.table({"doc_id": pa.array(doc, pa.int64()), "begin": pa.array(begin, pa.int32()), "end": pa.array(end, pa.int32())})

    return entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(reduce, "doc_id bigint, begin int, end int")


def _blocks(docs: list, texts: list):
    """Runs of documents with together about BLOCK characters."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK:
            yield docs[begin : i + 1], texts[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(texts):
        yield docs[begin:], texts[begin:]


def _anchors(least: int, buckets: int):
    """Entries for the boundaries of the top-level symbols: the key names the text around, which every long enough window holds."""
    after = least - CONTEXT - GAP

    def run(batches):
        sender = _Sender(buckets)
        for batch in batches:
            for docs, texts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, starts = flatten(texts)
                at = boundaries(codes)
                gap = np.diff(at, prepend=at[:1])
                doc = np.searchsorted(starts, at, side="right") - 1
                ok = (at - CONTEXT >= starts[doc]) & (at + after <= starts[doc + 1] - 1)
                at, gap, doc = at[ok], gap[ok], doc[ok]
                key = Windows(codes, 1).hash(at - CONTEXT, at + after)
                bucket = (key >> np.uint64(40)) % np.uint64(buckets)
                yield from sender.add(bucket, key, np.array(docs, np.int64)[doc], at - starts[doc], gap)
        yield from sender.rows()

    return run


def _windows(least: int, buckets: int):
    """Entries for each window of ``least`` characters whose first boundary is a shared one."""
    after = least - CONTEXT - GAP

    def run(batches):
        sender = _Sender(buckets)
        for batch in batches:
            marks = dict(zip(batch.column(0).to_pylist(), zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())))
            for docs, texts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, starts = flatten(texts)
                places = [np.array(marks[d][0], np.int64) + s for d, s in zip(docs, starts)]
                gaps = [np.array(marks[d][1], np.int64) for d in docs]
                doc = np.repeat(np.arange(len(docs)), [len(p) for p in places])
                at, gap = np.concatenate(places), np.concatenate(gaps)
                bucket = (Windows(codes, 1).hash(at - CONTEXT, at + after) >> np.uint64(40)) % np.uint64(buckets)
                each = np.repeat(np.arange(len(at)), gap)
                step = np.arange(len(each)) - np.repeat(np.cumsum(gap) - gap, gap)
                begin = at[each] - CONTEXT - step
                doc = doc[each]
                ok = (begin >= starts[doc]) & (begin + least <= starts[doc + 1] - 1)
                begin, doc, bucket = begin[ok], doc[ok], bucket[each][ok]
                key = Windows(codes, 2).hash(begin, begin + least)
                yield from sender.add(bucket, key, np.array(docs, np.int64)[doc], begin - starts[doc], np.zeros(len(doc)))
        yield from sender.rows()

    return run


def _every(least: int, buckets: int):
    """Entries for every window of ``least`` characters, for spans too short to hold a boundary with its surrounding."""

    def run(batches):
        sender = _Sender(buckets)
        for batch in batches:
            for docs, texts in _blocks(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes, starts = flatten(texts)
                begin = np.arange(max(0, len(codes) - least))
                doc = np.searchsorted(starts, begin, side="right") - 1
                ok = begin + least <= starts[doc + 1] - 1
                begin, doc = begin[ok], doc[ok]
                bucket = (Windows(codes, 1).hash(begin, begin + least) >> np.uint64(40)) % np.uint64(buckets)
                yield from sender.add(bucket, Windows(codes, 2).hash(begin, begin + least), np.array(docs, np.int64)[doc], begin - starts[doc], np.zeros(len(doc)))
        yield from sender.rows()

    return run


def _runs(least: int):
    def collapse(doc, place, _):
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + 1)
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1 if len(head) else head
        return doc[head], place[head], place[tail] + least

    return collapse


def shared_spans(df: DataFrame, key: str, text: str, least: int = 200) -> DataFrame:
    """``(doc_id, begin, end)``: stretches of each document, none inside another, that consist of spans of at least ``least``
    characters which stand letter for letter in another document too. Adjoining stretches may come in several rows.

    Each document is parsed by rounds that name runs and pairs of symbols (restricted recompression): names are hashes of
    what they stand for, so equal substrings get equal symbols but near their ends, without a table of names and without a
    shuffle per round. Every window of ``least`` characters holds a boundary of top-level symbols with enough text around
    that depends on the window alone; boundaries whose surrounding stands in one document only go no further. For the
    rest every window belonging to such a boundary is compared by a hash of 64 bits, within the bucket that a hash in another
    base gives its surrounding; the texts themselves are not compared again.
    Boundaries of texts in at least two documents are what travels, as compact blocks; a surrounding that a third of all
    documents hold arrives once a block (see _Sender). Null, empty and short texts have no span; a repeated key counts as
    one document, copies under different keys as several. Spans shorter than 2 * CONTEXT + GAP need not hold such a
    boundary; for those every window is an entry, which is as exact and sends more.
    """
    docs = df.where(F.length(text) >= least).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    if least < 2 * CONTEXT + GAP:
        buckets = int(max(16, chars // BUCKET))
        return _shared(docs.mapInArrow(_every(least, buckets), _ENTRY), buckets, _runs(least))
    buckets = int(max(16, chars // 12 // BUCKET))
    anchors = _shared(docs.mapInArrow(_anchors(least, buckets), _ENTRY), buckets, lambda d, p, e: (d, p, e))
    marks = anchors.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("m")).select("doc_id", F.col("m.begin").alias("places"), F.col("m.end").alias("gaps"))
    candidates = docs.join(marks, "doc_id").select("doc_id", "text", "places", "gaps")
    return _shared(candidates.mapInArrow(_windows(least, buckets), _ENTRY), buckets, _runs(least))


def shared_chars(spans: DataFrame) -> DataFrame:
    """``(doc_id, shared_chars)``: the characters of each document inside any of its spans, each counted once."""
    listed = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("s"))
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("upto"))

    def step(acc, x):
        new = F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], acc["upto"]))
        return F.struct((acc["total"] + new).cast("bigint").alias("total"), F.greatest(acc["upto"], x["end"]).alias("upto"))

    return listed.select("doc_id", F.aggregate("s", start, step)["total"].alias("shared_chars"))
