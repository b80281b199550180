"""Similarity of many pairs of keys: a bound for all of them, the matching-blocks ratio for those that it leaves.

Keys are those of ``key_match``: small letters, digits and single blanks.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

#: Places of a key that fit one word of bits; scores a task remembers of its left keys, only to leave out pairs that cannot win.
PLACES, REMEMBERED = 64, 200_000

#: What rounding may take from a score.
SLACK = 1e-6

_CODE = np.zeros(256, np.uint8)
_CODE[np.frombuffer(b" abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = np.arange(1, 38)


def similarity(a: str, b: str) -> float:
    """F-14 of two keys: 0 if either is blank, max(0.7, shorter/longer) if one holds the other, else the matching-blocks ratio."""
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return max(0.70, min(len(a), len(b)) / max(len(a), len(b)))
    return SequenceMatcher(None, a, b).ratio()


def _codes(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of sign numbers for each key, 0 beyond its end, and the lengths."""
    raw = np.array([k[:PLACES].encode() for k in keys], "S")
    return _CODE[raw.view(np.uint8).reshape(len(keys), -1)], np.array([len(k) for k in keys])


def bounds(a: list[str], ai: np.ndarray, b: list[str], bi: np.ndarray) -> np.ndarray:
    """Upper bounds of the similarities of pairs, each given by its places in two lists of keys.

    Matching blocks are a common subsequence, so the longest one bounds them; its length comes from one word of bits a pair, a
    sign of the right key at a time. Keys longer than the word have the bound of their lengths.
    """
    (ac, an), (bc, bn) = _codes(a), _codes(b)
    masks = np.zeros((len(a), 38), np.uint64)
    for i, column in enumerate(ac.T):
        masks[np.arange(len(a)), column] |= np.uint64(1 << i)
    masks[:, 0] = 0
    masks, base, v = masks.ravel(), ai.astype(np.int64) * 38, np.full(len(ai), 2**64 - 1, np.uint64)
    for column in np.ascontiguousarray(bc.T):
        u = v & masks[base + column[bi]]
        v = (v + u) | (v - u)
    an, bn = an[ai], bn[bi]
    least = np.minimum(an, bn)
    common = np.where(np.maximum(an, bn) > PLACES, least, np.bitwise_count(~v))
    ratio = 2.0 * common / np.maximum(1, an + bn)
    return np.where(least == 0, 0.0, np.where(common == least, np.maximum(0.70, ratio), ratio))


def _distinct(x: pa.RecordBatch, name: str) -> tuple[list[str], np.ndarray]:
    d = x.column(name).dictionary_encode()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


def best_of_batches(weights: tuple[float, float], floors: tuple[float, float], flat: float):
    """The plausible pairs (``_t``, ``_a``, ``rt``, ``ra``) with their scores, without those that another pair of the same left key
    beats here or that cannot reach ``_least``, from which ``SLACK`` is taken already.

    A blank left artist has the artist score ``flat``. The pairs of a batch go in the order of their bounds, so that most are left
    out by a better one before they are compared.
    """

    def run(batches):
        best: dict[tuple[str, str], float] = {}
        for x in batches:
            if not x.num_rows:
                continue
            if len(best) > REMEMBERED:
                best.clear()
            (t, ti), (u, ui), (a, ai), (b, bi) = (_distinct(x, c) for c in ("_t", "rt", "_a", "ra"))
            least = x.column("_least").to_numpy(zero_copy_only=False)
            artists = np.where(np.array([k == "" for k in a])[ai], flat, bounds(a, ai, b, bi))
            order = np.flatnonzero((artists >= floors[1]) & (weights[0] + weights[1] * artists >= least))
            titles = bounds(t, ti[order], u, ui[order])
            most = weights[0] * titles + weights[1] * artists[order]
            able = (titles >= floors[0]) & (most >= least[order])
            order, most = order[able], most[able]
            by = np.argsort(-most, kind="stable")
            title_of, artist_of, kept = {}, {}, []
            for i, top in zip(order[by].tolist(), most[by].tolist()):
                key = t[ti[i]], a[ai[i]]
                reached = best.get(key, 0.0) - SLACK
                if top < reached:
                    continue
                if (title := title_of.get(p := (ti[i], ui[i]))) is None:
                    title = title_of[p] = similarity(key[0], u[ui[i]])
                if title < floors[0] or weights[0] * title + weights[1] * artists[i] < reached:
                    continue
                if not key[1]:
                    artist = flat
                elif (artist := artist_of.get(p := (ai[i], bi[i]))) is None:
                    artist = artist_of[p] = similarity(key[1], b[bi[i]])
                score = weights[0] * title + weights[1] * artist
                if artist >= floors[1] and score >= reached:
                    best[key] = max(best.get(key, 0.0), score)
                    kept.append((i, title, artist))
            rows, *scores = (list(c) for c in zip(*kept)) if kept else ([], [], [])
            yield pa.RecordBatch.from_arrays([*x.take(pa.array(rows, pa.int64())).columns, *(pa.array(s, pa.float64()) for s in scores)], [*x.schema.names, "title_score", "artist_score"])

    return run


def best_pairs(df: DataFrame, weights: tuple[float, float], floors: tuple[float, float], flat: float) -> DataFrame:
    """``best_of_batches`` of a table of pairs."""
    return df.mapInArrow(best_of_batches(weights, floors, flat), StructType(df.schema.fields + [StructField(n, DoubleType()) for n in ("title_score", "artist_score")]))
