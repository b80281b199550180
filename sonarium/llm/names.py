"""Variant spellings of names, linked to the person or group they mean."""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonarium.llm.garbled import LOST, Statistics, no_statistics, repair
from sonarium.session import discard, small, spread, stored

# What stands for no name.
NOBODY = ("", "needs_review", "unknown", "n/a", "-", "none", "null", "various artists")
# Words for kinds of groups, and their short forms.
GROUP_WORDS = ("band", "brothers", "choir", "collective", "duo", "ensemble", "experience", "orchestra", "project", "quartet", "quintet", "soundsystem", "trio")
SHORT_FORMS = {
    "bd": "band", "bros": "brothers", "chr": "choir", "coll": "collective", "ens": "ensemble", "exp": "experience", "orch": "orchestra", "ork": "orchestra",
    "proj": "project", "qrt": "quartet", "4tet": "quartet", "3o": "trio",
}
# Letters without a decomposition.
PLAIN = str.maketrans({"ø": "o", "đ": "d", "ð": "d", "ł": "l", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th", "ı": "i"})
SLOTS = 1 << 20
GRAM = 4
#: Added to document counts, so that an n-gram that only a typing error made weighs little more than the others of its name.
SMOOTH = 50
#: Least cosine of a link, and least average cosine within an entity.
JOIN_AT, LINK_AT = 0.4, 0.3
#: Postings of an n-gram that are compared in one group; a more frequent n-gram is split into blocks of that size, pairs of blocks being groups of their own.
BLOCK = 2_000
#: Pairs of postings looked at in one step, which bounds the memory of a task.
STEP = 1 << 20


def fold(text: str) -> str:
    """Lower case without accents."""
    t = unicodedata.normalize("NFKD", text.lower())
    return "".join(c for c in t if not unicodedata.combining(c)).translate(PLAIN)


def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (adjacent swaps count one), or ``most`` + 1 if larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _group_word(token: str) -> str | None:
    token = SHORT_FORMS.get(token, token)
    if token in GROUP_WORDS:
        return token
    if len(token) <= 6:
        for short, word in SHORT_FORMS.items():
            if len(short) >= 3 and token[:1] == short[:1] and set(token) == set(short) and edits(token, short, 1) == 1:
                return word
    near = [(edits(token, w, 2), w) for w in GROUP_WORDS if len(w) >= 4 and token[:1] == w[:1]]
    d, w = min(near, default=(9, ""))
    return w if d <= (1 if len(w) <= 5 else 2) and len(token) >= 3 else None


def normal_name(text: str, stats: Statistics | None = None) -> tuple[str, str, str, str] | None:
    """``(kind, first, middle, last)`` of a spelling; for groups the two words and the kind of group; None if it names nobody."""
    t = unicodedata.normalize("NFKC", repair(text, stats or no_statistics())[0]).strip()
    if fold(" ".join(t.split())) in NOBODY:
        return None
    if not re.search(r"[\s_,.\-]", t):
        t = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-ZÀ-ÖØ-Þ])", " ", t)
    t = fold(t)
    t = re.sub(r"(?<=\w )s\.\s*s\.$|\bs\w{2,5}d[\s_-]+sy\w*m\b", "soundsystem", t)
    if t.count(",") == 1:
        last, first = t.split(",")
        t = f"{first} {last}"
    tokens = [x for x in re.split(r"[\s_.,\-]+", t) if x]
    tokens = [x for x in tokens if x != "the"] or tokens
    for at in range(len(tokens) - 1):
        if tokens[at][0] == "s" == tokens[at + 1][0] and edits(tokens[at], "sound", 2) <= 2 and edits(tokens[at + 1], "system", 2) <= 2:
            tokens[at : at + 2] = ["soundsystem"]
            break
    if len(tokens) == 2 and LOST in t:  # a lost blank
        tokens = [y for x in tokens for y in (x.split(LOST) if re.fullmatch(rf"[^{LOST}]{{3,}}{LOST}+[^{LOST}]{{3,}}", x) else [x])]
    if len(tokens) >= 2:
        for at in (-1, 0):
            word = _group_word(tokens[at])
            if word and (len(tokens) >= 3 or at == -1):
                rest = tokens[:-1] if at == -1 else tokens[1:]
                if len(rest) > 2 and edits(rest[0], "the", 1) <= 1:
                    rest = rest[1:]
                return word, "", " ".join(rest[:-1]), rest[-1]
    if len(tokens) == 1:
        return "person", "", "", tokens[0]
    return "person", tokens[0], " ".join(tokens[1:-1]), tokens[-1]


def grams(kind: str, first: str, middle: str, last: str) -> list[str]:
    """Character n-grams of the padded tokens; a token shorter than that is one gram."""
    out = []
    for token in (*first.split(), *middle.split(), *last.split(), *([] if kind == "person" else [kind])):
        t = f"^{token}$"
        out += [t[i : i + GRAM] for i in range(max(1, len(t) - GRAM + 1))]
    return out


def letters(text: str) -> int:
    """The set of characters of a text as bits: texts within k edits differ in at most 2 k of them."""
    bits = 0
    for c in text:
        o = ord(c) - 97
        bits |= 1 << (o if 0 <= o < 26 else 26 + o % 6)
    return bits


def _slots(found: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(g.encode()) % SLOTS for g in found), np.int64, len(found))


class Weights:
    """Inverse document frequencies of hashed n-grams, in an array of fixed size."""

    def __init__(self, counts: np.ndarray, n: int):
        self.idf = (1 + np.log((n + SMOOTH) / (counts + SMOOTH))).astype(np.float32)

    def vector(self, *name) -> tuple[np.ndarray, np.ndarray]:
        """Slots in one order for all names, rarest first, and their share of a unit vector."""
        s, times = np.unique(_slots(grams(*name)), return_counts=True)
        w = self.idf[s] * times
        order = np.argsort(-self.idf[s], kind="stable")
        return s[order], w[order] / np.sqrt((w**2).sum())

    def rests(self, w: np.ndarray) -> np.ndarray:
        """The length of what follows each place of a unit vector."""
        return np.sqrt(np.maximum(0, 1 - np.cumsum(w.astype(float) ** 2)))

    def prefix(self, least: float, *name) -> np.ndarray:
        """The rarest slots such that what is left cannot reach a cosine of ``least``: vectors that near share one of them."""
        s, w = self.vector(*name)
        return s[: int(np.argmax(self.rests(w) < least)) + 1]


def average_linkage(vectors: list[dict[int, float]], links: list[tuple[int, int]], least: float) -> list[int]:
    """Cluster labels of linked vectors: the two linked clusters of highest average cosine join while that is at least ``least``.

    The average over all pairs of two clusters, linked or not, is the product of their summed vectors over the number of
    pairs, so memory and work follow the number of links and not the square of the items.
    """
    label, size, total = list(range(len(vectors))), [1] * len(vectors), [dict(v) for v in vectors]
    near: list[set[int]] = [set() for _ in vectors]
    members = [[i] for i in range(len(vectors))]

    def average(i: int, j: int) -> float:
        a, b = (total[i], total[j]) if len(total[i]) < len(total[j]) else (total[j], total[i])
        return sum(v * b.get(k, 0.0) for k, v in a.items()) / (size[i] * size[j])

    for i, j in links:
        near[i].add(j)
        near[j].add(i)
    heap = [(-average(i, j), i, j, 1, 1) for i in range(len(vectors)) for j in near[i] if i < j]
    heapify(heap)
    while heap:
        minus, i, j, m, n = heappop(heap)
        if -minus < least:
            break
        if label[i] != i or label[j] != j or (size[i], size[j]) != (m, n):
            continue
        for k, v in total[j].items():
            total[i][k] = total[i].get(k, 0.0) + v
        size[i] += size[j]
        members[i] += members[j]
        for x in members[j]:
            label[x] = i
        near[i] = (near[i] | near[j]) - {i, j}
        for x in near[j] - {i}:
            near[x].discard(j)
            near[x].add(i)
        near[j], total[j], members[j] = set(), {}, []
        for x in near[i]:
            heappush(heap, (-average(i, x), min(i, x), max(i, x), size[min(i, x)], size[max(i, x)]))
    return label


def spellings(names: DataFrame) -> DataFrame:
    """``(name, node, kind, first, middle, last)`` of the distinct strings in ``names(name)``; what names nobody is left out."""

    def run(batches):
        for pdf in batches:
            found = [normal_name(t) for t in pdf["name"]]
            on = [f is not None for f in found]
            out = pdf[on].reset_index(drop=True)
            parts = pd.DataFrame([f for f in found if f], columns=["kind", "first", "middle", "last"])
            yield pd.concat([out, parts], axis=1)

    d = spread(names.where(F.col("name").isNotNull()), "name").distinct().mapInPandas(run, "name string, kind string, first string, middle string, last string")
    return d.withColumn("node", F.xxhash64("kind", "first", "middle", "last"))


def _weights(nodes: DataFrame) -> Weights:
    def run(batches):
        counts, n = np.zeros(SLOTS, np.int64), 0
        for pdf in batches:
            for name in zip(pdf["kind"], pdf["first"], pdf["middle"], pdf["last"]):
                counts[np.unique(_slots(grams(*name)))] += 1
                n += 1
        on = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": np.append(on, -1).astype("int32"), "n": np.append(counts[on], n)})

    found = nodes.select("kind", "first", "middle", "last").mapInPandas(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SLOTS, np.int64)
    kept = found[found.slot >= 0]
    counts[kept.slot] = kept.n
    return Weights(counts, int(found[found.slot < 0].n.sum()))


def nicknames(nodes: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """``(first, root)``: the first name that another one is short for, learned from the names alone.

    In each group of persons with one last name and one initial of the middle name, every first name is paired with the
    most frequent of the group, so the pairs are no more than the persons. It is short for the one it meets most, if that is
    in ``least`` groups or more and in ``share`` of those in which it meets another name. Misspellings do not count.
    """
    p = nodes.where((F.col("kind") == "person") & (F.length("first") > 1) & (F.col("middle") != ""))
    p = p.select("first", F.substring("middle", 1, 1).alias("m"), "last").distinct()
    often = p.groupBy("first").agg(F.count(F.lit(1)).alias("n"))
    p = stored(p.join(often, "first"), "firsts")
    top = p.groupBy("m", "last").agg(F.max(F.struct("n", "first"))["first"].alias("root"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    met = p.join(top, ["m", "last"]).where((F.col("first") != F.col("root")) & (F.levenshtein("first", "root") > 2))
    seen = met.groupBy("first", "root").agg(F.count(F.lit(1)).alias("k"))
    best = seen.groupBy("first").agg(F.max(F.struct("k", "root")).alias("b"), F.sum("k").alias("all"))
    found = stored(best.where((F.col("b.k") >= least) & (F.col("b.k") >= share * F.col("all"))).select("first", F.col("b.root").alias("root")), "nicknames")
    for _ in range(2):  # short for a name that is short itself
        further = found.select(F.col("first").alias("root"), F.col("root").alias("far"))
        found = found.join(further, "root", "left").select("first", F.coalesce("far", "root").alias("root"))
    return found.where(F.col("first") != F.col("root"))


def same_name(a: str, b: str) -> Column:
    """Whether the name parts with the prefixes ``a`` and ``b`` can be one name: a condition of the join, all in the JVM.

    Persons: an initial stands for any name that begins with it, a lost one for any; a first name also for the one it is short for. With equal
    last names the middle names must agree as far as both are given. Where last names differ by a typing error, the middle
    names must be given in full and agree. Three full parts may stand in another order. Groups: the same kind, and both words agree, at most one of them mistyped.
    """
    col = lambda s, n: F.col(s + n)
    near = lambda n, k: (F.abs(F.length(col(a, n)) - F.length(col(b, n))) <= k) & (F.levenshtein(col(a, n), col(b, n)) <= k)
    lost = lambda n: (col(a, n) == LOST) | (col(b, n) == LOST)
    initial = lambda n: ((F.length(col(a, n)) == 1) | (F.length(col(b, n)) == 1)) & ((F.substring(col(a, n), 1, 1) == F.substring(col(b, n), 1, 1)) | lost(n))
    full = lambda n: (F.length(col(a, n)) > 1) & (F.length(col(b, n)) > 1)
    same_last = col(a, "last") == col(b, "last")
    near_last = near("last", 2) & (F.length(col(a, "last")) >= 4)
    no_middle = (col(a, "middle") == "") | (col(b, "middle") == "")
    middle = near("middle", 2) & full("middle") & (F.length(col(a, "middle")) >= 3)
    root_initial = ((F.length(col(a, "first")) == 1) | (F.length(col(b, "first")) == 1)) & (F.substring(col(a, "root"), 1, 1) == F.substring(col(b, "root"), 1, 1))
    first = (col(a, "first") == col(b, "first")) | (col(a, "root") == col(b, "root")) | initial("first") | root_initial | (near("first", 2) & full("first") & (F.length(col(a, "first")) >= 3))
    person = (same_last & (middle | ((initial("middle") | no_middle) & first))) | (near_last & ~same_last & middle & first & (near("middle", 1) | (col(a, "first") == col(b, "first"))))
    bag = (F.size(col(a, "bag")) == 3) & (F.size(col(b, "bag")) == 3) & (F.levenshtein(F.array_join(col(a, "bag"), " "), F.array_join(col(b, "bag"), " ")) <= 1)
    person = person | bag
    words = (same_last & (near("middle", 2) | initial("middle"))) | (near_last & (col(a, "middle") == col(b, "middle")) & full("middle"))
    return (col(a, "kind") == col(b, "kind")) & F.when(col(a, "kind") == "person", person).otherwise(words)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges(a, b)``: connected components, by passing on the least label and halving paths.

    Each round is a join and an aggregate with partial sums on both sides; rounds are written to the shared folder.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = stored(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    before = label
    while True:
        least = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("least"))
        new = label.join(least.withColumnRenamed("a", "node"), "node", "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("least"))
        jump = label.select(F.col("node").alias("least"), F.col("component").alias("far"))
        new = new.join(jump, "least", "left").select("node", "component", F.least("least", F.coalesce("far", "least")).alias("next"))
        new = stored(new, "labels")
        moved = new.where(F.col("next") != F.col("component")).limit(1).count()
        discard(before)
        before, label = new, new.select("node", F.col("next").alias("component"))
        if not moved:
            discard(both)
            return label


POSTING = "slot int, node bigint, kind bigint, mask bigint, whole bigint, w float, rest float, slots array<int>, weights array<float>"


def postings(nodes: DataFrame, weights, least: float) -> DataFrame:
    """The inverted index: a row for each of a name's rarest n-grams (Weights.prefix), with the weight there, the length of
    the vector after it, the letters of the name as bits, and the whole vector."""

    def run(batches):
        w = weights.value
        for batch in batches:
            d = batch.to_pandas()
            found = [w.vector(*n) for n in zip(d["kind"], d["first"], d["middle"], d["last"])]
            if not found:
                continue
            rests = [w.rests(v) for _, v in found]
            cut = np.array([int(np.argmax(r < least)) + 1 for r in rests])
            long = np.array([len(s) for s, _ in found])
            row = np.repeat(np.arange(len(d)), cut)
            first = lambda arrays: np.concatenate([a[:c] for a, c in zip(arrays, cut)])
            column = lambda values: pa.array(np.asarray(values, np.int64)[row])
            offsets = np.concatenate([[0], np.cumsum(long[row])]).astype(np.int32)
            whole = lambda arrays, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([arrays[i] for i in row]).astype(kind)))
            slots, values = [s for s, _ in found], [v for _, v in found]
            kinds = [zlib.crc32(k.encode()) for k in d["kind"]]
            masks = [letters(x) for x in d["last"]], [letters(x) for x in d["first"] + d["middle"] + d["last"]]
            columns = [
                pa.array(first(slots).astype(np.int32)), column(d["node"]), column(kinds), column(masks[0]), column(masks[1]), pa.array(first(values).astype(np.float32)),
                pa.array(first(rests).astype(np.float32)), whole(slots, np.int32), whole(values, np.float32),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTING.split(", ")])

    return nodes.select("node", "kind", "first", "middle", "last").mapInArrow(run, POSTING)


def _similar(rows: pa.Table, begin: np.ndarray, end: np.ndarray, least: float, edits_of_parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and cosine of the pairs of ``rows`` within the groups ``[begin, end)`` of each row that have a cosine of ``least`` or more."""
    node, kind, mask, whole, w, rest, part = (rows.column(c).to_numpy() for c in ("node", "kind", "mask", "whole", "w", "rest", "part"))
    lists, values = rows.column("slots").combine_chunks(), rows.column("weights").combine_chunks().flatten().to_numpy()
    slots, start = lists.flatten().to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    start -= start[0]
    length = np.diff(start)
    keys = np.repeat(np.arange(len(node)), length) * SLOTS + slots
    order = np.argsort(keys)
    sorted_keys, sorted_values = keys[order], values[order]
    partners = end - np.arange(len(node)) - 1
    found, at = [], 0
    while at < len(node):
        to = max(at + 1, int(np.searchsorted(np.cumsum(partners[at:]), STEP)) + at)
        n = partners[at:to]
        a = np.repeat(np.arange(at, to), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = to
        # what follows the first n-gram that two names share cannot add more than the product of the two lengths
        ok = (w[a] * w[b] + rest[a] * rest[b] >= least - 1e-6) & (kind[a] == kind[b]) & (node[a] != node[b]) & ((part[a] != part[b]) | (part[a] < 0))
        a, b = a[ok], b[ok]
        # letters in which no two names that same_name accepts can differ
        ok = (np.bitwise_count(mask[a] ^ mask[b]) <= 2 * edits_of_parts) | (np.bitwise_count(whole[a] ^ whole[b]) <= edits_of_parts)
        a, b = a[ok], b[ok]
        n = length[a]
        pair = np.repeat(np.arange(len(a)), n)
        entry = np.repeat(start[a] - np.cumsum(n) + n, n) + np.arange(len(pair))
        wanted = b[pair] * SLOTS + slots[entry]
        place = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        product = np.where(sorted_keys[place] == wanted, values[entry].astype(float) * sorted_values[place], 0.0)
        cosine = np.bincount(pair, product, len(a)).astype(float)
        ok = cosine >= least - 1e-6
        found.append((np.minimum(node[a], node[b])[ok], np.maximum(node[a], node[b])[ok], cosine[ok]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def cosine_pairs(posted: DataFrame, least: float, block: int = BLOCK, top_n: int | None = None) -> DataFrame:
    """``(a, b, cosine)``, a < b, of the nodes of one kind with a cosine of ``least`` or more whose letters do not rule each other out.

    ``posted`` is what postings gives for that threshold. Postings of an n-gram meet in one group; an n-gram with more than
    ``block`` of them is split into blocks, and each pair of blocks is a group, so that no task holds more than two blocks.
    ``top_n`` keeps the pairs that are among the most similar ones of either node; None, the exact setting, keeps all.
    """
    posted = stored(posted, "postings")
    hot = posted.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("slot", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    d = posted.join(small(stored(hot, "hot"), SLOTS), "slot", "left")  # no more slots than SLOTS
    d = d.withColumn("part", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("node"), "parts")).cast("int"))
    d = d.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    d = d.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    d = d.withColumn("part", F.when(F.col("low") == F.col("high"), -1).otherwise(F.col("part"))).drop("parts", "other")
    d = spread(d, "slot", "low", "high").sortWithinPartitions("slot", "low", "high")

    def run(batches):
        kept = None
        for batch in itertools.chain(batches, [None]):
            rows = kept if batch is None else pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            if rows is None or not rows.num_rows:
                continue
            group = np.stack([rows.column(c).to_numpy() for c in ("slot", "low", "high")])
            first = np.flatnonzero(np.concatenate([[True], (group[:, 1:] != group[:, :-1]).any(axis=0)]))
            whole = rows.num_rows if batch is None else int(first[-1])  # the last group may go on
            kept = rows.slice(whole)
            if not whole:
                continue
            first = first[first < whole]
            sizes = np.diff(np.append(first, whole))
            a, b, c = _similar(rows.slice(0, whole).combine_chunks(), np.repeat(first, sizes), np.repeat(first + sizes, sizes), least, 2)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["a", "b", "cosine"])

    found = d.select("slot", "low", "high", "part", "node", "kind", "mask", "whole", "w", "rest", "slots", "weights").mapInArrow(run, "a bigint, b bigint, cosine double")
    found = found.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    if top_n is None:
        return found
    both = found.withColumn("node", F.explode(F.array("a", "b"))).withColumn("other", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cosine"), "other"))).where(F.col("r") <= top_n)
    return best.select("a", "b", "cosine").distinct()


def link(names: DataFrame, join_at: float = JOIN_AT, link_at: float = LINK_AT, top_n: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(name, entity)`` for every distinct string of ``names(name)`` that names somebody.

    Spellings are brought to name parts and weighted vectors of character n-grams. A sparse cosine join over an inverted
    index gives all pairs with a cosine of ``join_at`` or more (the ``top_n`` nearest of each, if that is given); those whose
    parts contradict each other (same_name) are dropped, the rest are links. Linked spellings are grouped by average linkage
    of their cosines. Null, blank and placeholder strings and ``Various Artists`` are left out, repeated strings count once,
    an empty table gives an empty one. Only the n-gram frequencies, hashed to an array of fixed size, come to the driver.
    """
    spelled = stored(spellings(names), "spellings")
    nodes = spelled.groupBy("node").agg(*[F.min(c).alias(c) for c in ("kind", "first", "middle", "last")])
    nodes = stored(nodes, "nodes")
    shared = nodes.sparkSession.sparkContext.broadcast(_weights(nodes))
    near = cosine_pairs(postings(spread(nodes, "node"), shared, join_at), join_at, block, top_n)
    rooted = nodes.join(small(stored(nicknames(nodes), "roots")), "first", "left").withColumn("root", F.coalesce("root", "first"))
    rooted = rooted.withColumn("bag", F.filter(F.array_sort(F.array("first", "middle", "last")), lambda x: F.length(x) > 1))
    rooted = stored(rooted, "rooted")
    side = lambda p: rooted.select(*[F.col(c).alias(p + c) for c in rooted.columns])
    met = near.join(side("a_"), F.col("a") == F.col("a_node")).join(side("b_"), F.col("b") == F.col("b_node")).where(same_name("a_", "b_"))
    named = [p + c for p in ("a_", "b_") for c in ("kind", "first", "middle", "last")]
    edges = stored(met.select("a", "b", "cosine", *named), "links")
    parts = components(edges)
    linked = edges.join(parts.withColumnRenamed("node", "a"), "a")

    def cluster(batches):
        w, kept = shared.value, None
        for d in itertools.chain(batches, [None]):
            rows = kept if d is None else d if kept is None else pd.concat([kept, d], ignore_index=True)
            if rows is None or rows.empty:
                continue
            last = None if d is None else rows["component"].iloc[-1]  # may go on in the next batch
            kept = rows[rows["component"] == last]
            out = []
            for _, g in rows[rows["component"] != last].groupby("component", sort=False):
                who = {n: x for p in ("a", "b") for n, *x in zip(g[p], *[g[f"{p}_{c}"] for c in ("kind", "first", "middle", "last")])}
                ids = sorted(who)
                at = {n: i for i, n in enumerate(ids)}
                label = average_linkage([dict(zip(*w.vector(*who[n]))) for n in ids], [(at[a], at[b]) for a, b in zip(g["a"], g["b"])], link_at)
                least = {}
                for n, x in zip(ids, label):
                    least.setdefault(x, n)
                out += [(n, least[x]) for n, x in zip(ids, label)]
            yield pd.DataFrame(out, columns=["node", "entity"]).astype("int64")

    grouped = spread(linked, "component").sortWithinPartitions("component").mapInPandas(cluster, "node bigint, entity bigint")
    return spelled.select("name", "node").join(grouped, "node", "left").select("name", F.coalesce("entity", "node").alias("entity"))


def pairs(linked: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: all pairs of different strings of an entity, smaller first."""
    a, b = linked.select("entity", F.col("name").alias("name_a")), linked.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b")
