"""Text decoded with a wrong character encoding: found among correct foreign text, and restored where it can be."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings under which UTF-8 bytes may have been read, and the bits by which the text must gain; bytes an encoding leaves
#: open pass as the same code point. Rarer mistakes need more.
ENCODINGS = {"cp1252": 2.0, "cp437": 4.0, "mac_roman": 4.0, "cp1251": 4.0, "cp850": 5.0, "cp1250": 6.0, "cp1254": 6.0, "iso8859_15": 6.0, "cp1253": 6.0, "koi8_r": 6.0}
#: Other wrong readings, (written in, read as): tried on runs of SINGLE characters or more; the text must gain SINGLE_BITS.
SINGLES = (
    ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp1253", "cp1252"), ("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp866", "cp1251"),
    ("cp1251", "mac_roman"), ("shift_jis", "cp1252"), ("euc_kr", "cp1252"), ("gbk", "cp1252"),
)
SINGLE, SINGLE_BITS = 3, 8.0
#: Pseudo-counts that hold the estimate of a pair to that of its classes, and of a pair of classes to the prior.
PAIR_WEIGHT, CLASS_WEIGHT = 2.0, 20.0
#: What a pair of ASCII characters, which no wrong reading makes, takes from a segment, in bits.
NEUTRAL = 8.0
LOST = "�"
#: Stands before and after a text.
EDGE = "\x00"
_HIGH = "À-ÿ¨¸"


@lru_cache(maxsize=None)
def _table(encoding: str) -> dict[str, int]:
    found = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        found.setdefault(c, b)
    if encoding == "cp1252":  # read as latin-1 the same bytes are C1 controls
        for b in range(0x80, 0xA0):
            found.setdefault(chr(b), b)
    return found


@lru_cache(maxsize=None)
def _sequences(encoding: str) -> re.Pattern:
    """What UTF-8 sequences of two to four bytes look like when read under ``encoding``."""
    t = _table(encoding)
    some = lambda low, high: "[" + "".join(re.escape(c) for c, b in t.items() if low <= b <= high) + "]"
    go = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{go}|{some(0xE0, 0xEF)}{go}{{2}}|{some(0xF0, 0xF4)}{go}{{3}}")


@lru_cache(maxsize=None)
def _runs(encoding: str, least: int) -> re.Pattern:
    """Runs of ``least`` characters or more that ``encoding`` has above ASCII."""
    return re.compile("[" + "".join(re.escape(c) for c in _table(encoding)) + f"]{{{least},}}")


@lru_cache(maxsize=1)
def _shapes() -> re.Pattern:
    """What UTF-8 sequences look like under any of the encodings."""
    return re.compile("|".join(_sequences(e).pattern for e in ENCODINGS))


@lru_cache(maxsize=1)
def _ambiguous() -> re.Pattern:
    """Text that some wrong reading could have made; whether it was made so is left to the statistics."""
    return re.compile(_shapes().pattern + f"|[{_HIGH}]{{{SINGLE},}}|" + LOST)


_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})")


def unescape(text: str) -> str:
    """``text`` with its \\uXXXX escapes read, so that broken JSON can be searched as well."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if not 0xD800 <= int(m[1], 16) < 0xE000 else m[0], text)


# The alphabet of the statistics: every character of these ranges (alphabets, punctuation and box drawing, which all wrong
# readings fall into) for itself, other characters by block of 256 or, beyond the first plane, by plane.
OWN = ((0x0, 0x52F), (0x1E00, 0x1EFF), (0x2000, 0x23FF), (0x2500, 0x25FF), (0xF8FF, 0xF8FF), (0xFB01, 0xFB02), (0xFFFD, 0xFFFD))


#: Where the characters of most texts lie; until a text shows others, they count as rarer.
USUAL = ((0x0, 0x17F), (0x386, 0x3CE), (0x401, 0x45F), (0x1EA0, 0x1EF9), (0x2010, 0x203A), (0x20AC, 0x20AC), (0x2122, 0x2122))


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, list[str]]:
    """The place of each code point in the alphabet, and a character of each place; their number does not depend on the data."""
    codes = np.arange(0x110000)
    place = np.where(codes < 0x10000, codes >> 8, 255 + (codes >> 16)).astype(np.int64)
    chars = [chr((b << 8) + 0x80) for b in range(256)] + [chr(p << 16) for p in range(1, 17)]
    for low, high in OWN:
        place[low : high + 1] = np.arange(len(chars), len(chars) + high - low + 1)
        chars += [chr(c) for c in range(low, high + 1)]
    for c in range(0x370, 0x530):  # Greek and Cyrillic capitals count as their small letters
        place[c] = place[ord(chr(c).lower()[0])]
    return place, chars


def _class(char: str) -> str:
    """The class of a character: script and case of a letter, else the kind of sign."""
    o, kind = ord(char), unicodedata.category(char)
    if char == EDGE or kind[0] == "Z" or char in "\t\n\r":
        return " "
    if kind[0] == "M":
        return "m" if o < 0x370 else f"B{o >> 8:x}l"
    if kind[0] == "N":
        return "n" if o < 0x80 else "s"
    if kind[0] == "L" and char not in "ªº":
        script = "L" if o < 0x250 or 0x1E00 <= o < 0x1F00 else "G" if 0x370 <= o < 0x400 else "C" if 0x400 <= o < 0x530 else "E" if 0x2E80 <= o < 0xD7B0 or 0xF900 <= o < 0xFB00 or 0xFF00 <= o else f"B{o >> 8:x}"
        return script + ("u" if kind in ("Lu", "Lt") else "l") + ("+" if script == "L" and o >= 0x80 else "")
    return "c" if kind[0] == "C" else "p" if o < 0x80 else "q" if kind in ("Pi", "Pf", "Pd", "Po") else "s"


def _prior(a: str, b: str) -> float:
    """Mutual information of two classes before any text is seen, in bits: words are letters of one script, capitals begin them, signs and controls stand outside."""
    if "c" in (a, b):
        return -6.0
    if b == "m":
        return -4.0
    both = len(a) > 1 and len(b) > 1
    if both and a.split("u")[0].split("l")[0] != b.split("u")[0].split("l")[0]:
        return -6.0
    if both and "l" in a and "u" in b:
        return -3.0
    if both and a[-1] == b[-1] == "+":
        return -2.0
    if "s" in (a, b) and (a == b or len(a) > 1 or len(b) > 1):
        return -3.0
    if "q" in (a, b):
        return -1.5
    return 0.5


class Statistics:
    """Counts of adjacent pairs of the alphabet in correct text, and the mutual information of a pair.

    A pair's estimate shrinks to that of its two classes, and theirs to a prior, so that pairs no text showed have one too.
    """

    def __init__(self, pairs=None, counts=None):
        self.pairs = np.array([], np.int64) if pairs is None else np.asarray(pairs, np.int64)
        self.counts = np.array([], np.int64) if counts is None else np.asarray(counts, np.int64)
        _, chars = _alphabet()
        names = [_class(c) for c in chars]
        self.classes = sorted(set(names))
        self.of = np.array([self.classes.index(n) for n in names])
        m, k = len(chars), len(self.classes)
        a, b = self.pairs // m, self.pairs % m
        self.left, self.right = np.bincount(a, self.counts, m), np.bincount(b, self.counts, m)
        self.n = max(1.0, float(self.counts.sum()))
        both = np.bincount(self.of[a] * k + self.of[b], self.counts, k * k).reshape(k, k)
        expected = np.outer(both.sum(axis=1), both.sum(axis=0)) / self.n
        prior = np.array([[2.0 ** _prior(x, y) for y in self.classes] for x in self.classes])
        self.ratio = (both + CLASS_WEIGHT * prior) / (expected + CLASS_WEIGHT)
        share = np.array([1 / 256] * 256 + [1 / 65536] * 16 + [1.0] * (m - 272))  # a character's part of its block
        usual = np.array([0.5 if any(low <= ord(c) <= high for low, high in USUAL) else 0.02 for c in chars])
        self.single = np.log2((self.right + usual) * share / (self.n + usual.sum()))
        self.memory: dict[str, float] = {}
        self.steps: dict[str, float] = {}
        self.choices: dict[tuple[str, str, str], tuple[float, float, str] | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"memory": {}, "steps": {}, "choices": {}}

    def bits(self, pair: str) -> float:
        """The mutual information of a pair of characters, in bits."""
        found = self.memory.get(pair)
        if found is None:
            place, chars = _alphabet()
            a, b = int(place[ord(pair[0])]), int(place[ord(pair[1])])
            code = a * len(chars) + b
            i = int(np.searchsorted(self.pairs, code))
            n = float(self.counts[i]) if i < len(self.pairs) and self.pairs[i] == code else 0.0
            # the class of the character itself: blocks hold several kinds
            one, two = (self.classes.index(x) if x in self.classes else self.of[p] for x, p in ((_class(pair[0]), a), (_class(pair[1]), b)))
            found = float(np.log2((n + PAIR_WEIGHT * self.ratio[one, two]) / (self.left[a] * self.right[b] / self.n + PAIR_WEIGHT)))
            if len(self.memory) > 500_000:
                self.memory.clear()
            self.memory[pair] = found
        return found

    def _step(self, pair: str) -> float:
        place, _ = _alphabet()
        if len(self.steps) > 500_000:
            self.steps.clear()
        self.steps[pair] = found = self.bits(pair) + float(self.single[place[ord(pair[1])]])
        return found

    def likelihood(self, text: str) -> float:
        """The log-likelihood of a text in bits: that of its characters after the first and the mutual information of its pairs."""
        get, total = self.steps.get, 0.0
        for i in range(len(text) - 1):
            pair = text[i : i + 2]
            v = get(pair)
            total += self._step(pair) if v is None else v
        return total


@lru_cache(maxsize=1)
def no_statistics() -> Statistics:
    """Statistics of no text, made once a process: the prior alone."""
    return Statistics()


def segments(scores) -> list[tuple[int, int]]:
    """All maximal scoring segments ``[begin, end)`` of a sequence of scores, disjoint, in order."""
    found: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum at end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        new = (i, i + 1, before, total)
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = (found[j][0], new[1], found[j][2], new[3])
            del found[j:]
    return [(a, b) for a, b, _, _ in found]


_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


def improbable(text: str, stats: Statistics) -> list[tuple[int, int]]:
    """The improbable runs ``[begin, end)`` of a text: maximal scoring segments of minus the mutual information of its adjacent
    pairs, widened to what is not ASCII around them, so that no sequence is cut; disjoint, in order."""
    runs: list[tuple[int, int]] = []
    framed, at, scores, places = EDGE + text + EDGE, 0, [], []
    for m in _NON_ASCII.finditer(framed):
        if m.start() - 1 > at:  # the ASCII text in between
            scores.append(-NEUTRAL * (m.start() - 1 - at))
            places.append(at)
        for i in range(max(at, m.start() - 1), m.end()):
            scores.append(-stats.bits(framed[i : i + 2]))
            places.append(i)
        at = m.end()
    for a, b in segments(scores):
        begin, end = places[a], places[b - 1] + 2
        while begin and ord(framed[begin - 1]) > 127:
            begin -= 1
        while end < len(framed) and ord(framed[end]) > 127:
            end += 1
        begin, end = max(begin - 1, 0), min(end - 1, len(text))  # without the frame
        if runs and begin <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
        else:
            runs.append((begin, end))
    return runs


def _undo(run: str, encoding: str) -> str:
    """``run`` with what one reading of UTF-8 under ``encoding`` made undone."""
    table = _table(encoding)

    def restore(m: re.Match) -> str:
        try:
            c = bytes(table[x] for x in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        return m[0] if unicodedata.category(c) in ("Cn", "Co", "Cs") else c

    return _sequences(encoding).sub(restore, run)


def _undo_single(run: str, written: str, read: str) -> str:
    """``run`` with its runs of non-ASCII characters read in the encoding they were written in."""
    table = _table(read)

    def restore(m: re.Match) -> str:
        try:
            return bytes(table[x] for x in m[0]).decode(written)
        except UnicodeDecodeError:
            return m[0]

    return _runs(read, 1).sub(restore, run) if _runs(read, SINGLE).search(run) else run


_LONG = re.compile(rf"[^\x00-\x7f]{{{SINGLE},}}")


def _readings(run: str) -> dict[str, float]:
    """What a run may have been: the results of undoing any of the wrong readings, again and again until nothing new comes, and
    the bits each must gain. A reading of UTF-8 gets shorter with each step and others are tried once, so the search ends."""
    found, fresh = {run: 0.0}, [run]
    while fresh:
        now = fresh.pop()
        made = [(_undo(now, e), bits) for e, bits in ENCODINGS.items()] if _shapes().search(now) else []
        if found[now] < SINGLE_BITS and _LONG.search(now):
            made += [(_undo_single(now, w, r), SINGLE_BITS) for w, r in SINGLES]
        for new, bits in made:
            least = found[now] + bits
            if new != now and least < found.get(new, np.inf):
                found[new] = least
                fresh.append(new)
    return {r: bits for r, bits in found.items() if r != run}


def _best(left: str, run: str, right: str, stats: Statistics) -> tuple[float, float, str] | None:
    """The most probable reading of a run between two characters: the bits gained, those that must be, and the text; None if none gains."""
    key = (left, run, right)
    if key in stats.choices:
        return stats.choices[key]
    found = None
    readings = _readings(run)
    if readings:
        as_is = stats.likelihood(left + run + right)
        more, new = max((stats.likelihood(left + r + right) - as_is - least, r) for r, least in readings.items())
        if more + readings[new] > 0:
            found = (more + readings[new], readings[new], new)
    if len(stats.choices) > 100_000:
        stats.choices.clear()
    if len(run) < 1000:
        stats.choices[key] = found
    return found


def repair(text: str, stats: Statistics) -> tuple[str, bool]:
    """``text`` as originally written as far as that can be recovered, and whether any of it had been decoded wrongly.

    Adjacent pairs are scored by their mutual information, improbable runs are isolated as maximal scoring segments, and only
    inside those the inverse readings are tried. In each run the reading wins that is most probable, as a chain of pairs, if
    it is more so than the run as it is; the text is taken for garbled if its runs gain as many bits together as their
    readings must. A replacement mark is evidence of a loss that nothing restores.
    """
    found = LOST in text
    if text.isascii():
        return text, found
    gain, needed, pieces, at = 0.0, 0.0, [], 0
    for a, b in improbable(text, stats):
        choice = _best(text[a - 1] if a else EDGE, text[a:b], text[b] if b < len(text) else EDGE, stats)
        if choice:
            gain, needed = gain + choice[0], max(needed, choice[1])
            pieces += [text[at:a], choice[2]]
            at = b
    return ("".join(pieces) + text[at:], True) if pieces and gain >= needed else (text, found)


def _suspect(column):
    """Whether a value can be garbled at all: it holds something that is not ASCII, or an escape."""
    return column.rlike(r"[^\x00-\x7F]|\\u[0-9a-fA-F]{4}")


def _counted(df: DataFrame, columns: list[str], kept) -> DataFrame:
    """``(pair, n)``: the adjacent pairs of the alphabet in the values of the columns that ``kept`` keeps, escapes read."""

    def run(batches):
        place, chars = _alphabet()
        pairs, counts = np.array([], np.int64), np.array([], np.int64)
        for pdf in batches:
            for c in columns:
                found = kept([unescape(x) if "\\u" in x else x for x in pdf[c].dropna()])
                if found:
                    codes = place[np.frombuffer((EDGE + EDGE.join(found) + EDGE).encode("utf-32-le", "surrogatepass"), np.uint32)]
                    p, n = np.unique(codes[:-1] * len(chars) + codes[1:], return_counts=True)
                    pairs, where = np.unique(np.concatenate([pairs, p]), return_inverse=True)
                    counts = np.bincount(where, np.concatenate([counts, n]), len(pairs)).astype(np.int64)
        yield pd.DataFrame({"pair": pairs, "n": counts})

    return df.select(*columns).mapInPandas(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def gather(df: DataFrame, columns: list[str]) -> Statistics:
    """Statistics of the correct text in the columns: pairs of the alphabet in the values that no wrong reading could have made,
    and, in a second pass, in those that one could have made but that these statistics take for correct as they are.

    Every task counts its values; the counts are summed per pair, and what reaches the driver has at most the alphabet's
    size squared rows, whatever the corpus (ten million; some ten thousand in practice). Each pair has a count of its own.
    """
    first = _counted(df, columns, lambda texts: [t for t in texts if t and (t.isascii() or not _ambiguous().search(t))]).toPandas().sort_values("pair")
    stats = Statistics(first["pair"].to_numpy(), first["n"].to_numpy())

    def correct(texts: list[str]) -> list[str]:
        judged = {t: not repair(t, stats)[1] for t in set(texts) if not t.isascii() and _ambiguous().search(t)}
        return [t for t in texts if judged.get(t)]

    cells = df.select(F.explode(F.array(*columns)).alias("t")).where(_suspect(F.col("t")))
    second = _counted(cells, ["t"], correct).toPandas()
    both = pd.concat([first, second]).groupby("pair")["n"].sum().sort_index()
    return Statistics(both.index.to_numpy(), both.to_numpy())


def repaired(df: DataFrame, key: str, columns: list[str], stats: Statistics) -> DataFrame:
    """``(key, field_name, was, restored)`` of every value that was decoded wrongly, wholly or in part.

    ``restored`` is the text as far as it can be recovered; in it, escapes are read. Null and ASCII values are no case and
    never leave the JVM; repeated rows give their cases again; other columns are dropped first.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("was")) for c in columns])
    long = df.select(F.col(key).alias("_key"), F.explode(cells).alias("c")).select("_key", "c.field_name", "c.was").where(_suspect(F.col("was")))

    def run(batches):
        memory: dict[str, tuple[str, bool]] = {}
        for pdf in batches:
            out = []
            for t in pdf["was"]:
                if t not in memory:
                    if len(memory) > 50_000:
                        memory.clear()
                    memory[t] = repair(unescape(t) if "\\u" in t else t, stats)
                out.append(memory[t])
            pdf["restored"] = [r for r, _ in out]
            yield pdf[np.array([f for _, f in out], bool)] if len(pdf) else pdf

    kind = dict(df.dtypes)[key]
    return long.mapInPandas(run, f"_key {kind}, field_name string, was string, restored string").withColumnRenamed("_key", key)


def repair_column(df: DataFrame, column: str, out: str, stats: Statistics) -> DataFrame:
    """``df`` with ``out``: the column with wrong decodings undone; ASCII values pass through a branch without Python."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def undo(values: pd.Series) -> pd.Series:
        memory: dict[str, str] = {}
        return values.map(lambda t: t if t is None else memory.setdefault(t, None) or memory.__setitem__(t, repair(t, stats)[0]) or memory[t])

    hit = F.coalesce(_suspect(F.col(column)), F.lit(False))
    plain = df.where(~hit).withColumn(out, F.col(column))
    return plain.unionByName(df.where(hit).withColumn(out, undo(F.col(column))))
