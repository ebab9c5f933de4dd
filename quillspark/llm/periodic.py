"""Periodic runs of words: a harmonic grid of (period, grid point) pairs, prefix hashes and binary-searched extensions.

A run is a stretch of words with smallest period q that repeats it LEAST_TIMES times or more, has LEAST_WORDS
words or more and can't be made longer at either end. For each period p up to a fourth of a text's words the grid
points are 0, 2p, 4p, ...: a run of 4p words holds a whole block of p words, from some grid point, together with the
p words after it. So only pairs whose two blocks are equal are looked at (first words, then hashes of the blocks),
and of them the longest common extension forwards and backwards is searched for all pairs at once, by halving with
prefix hashes. The pairs of all texts of a part of a batch are worked on together, in slices of SLICE pairs.

Hashes are pairs of polynomials modulo 2 ** 31 - 1; equal words have equal hashes, so a chance collision can only
make a run too long. Each found (start, end, period) is therefore verified word by word; where one fails, the runs of
that text are found by comparing all words at each distance. Of equal (start, end) the least period is the smallest:
by Fine and Wilf's theorem the others are its multiples.

Defined cases: a null or empty text, or one of blanks only, has no words and no runs; its collapsed text is empty.
Every text is read whole; a very long one is a part of its own, in memory proportional to its words. Repeated rows
and rows of null or equal doc_ids are each treated alone, one result a row. An empty table gives an empty result.
Columns of docs other than the two named are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_TIMES = 6, 4
SLICE = 1 << 18  # pairs worked on at once
PART = 1 << 18  # words worked on at once, or one text
_MOD = (1 << 31) - 1
_BASES = (1_103_515_245, 741_103_597)


class PrefixHashes:
    """Prefix sums of word * base ** place, so that equality of two stretches p apart needs one product for each base."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.powers, self.sums = [], []
        for base in _BASES:
            power = np.ones(n, np.int64)
            have, step = 1, base % _MOD
            while have < n:  # power[have:2 * have] = power[:have] * base ** have
                power[have : 2 * have] = power[: min(have, n - have)] * step % _MOD
                have, step = 2 * have, step * step % _MOD
            total = np.zeros(n, np.int64)
            np.cumsum((words + 1) % _MOD * power[: n - 1] % _MOD, out=total[1:])
            self.powers.append(power)
            self.sums.append(total)

    def same(self, at: np.ndarray, length: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether words[at:at + length] equals words[at + p:at + p + length]."""
        out = np.ones(len(at), bool)
        for power, total in zip(self.powers, self.sums):
            out &= (total[at + length] - total[at]) % _MOD * power[p] % _MOD == (total[at + p + length] - total[at + p]) % _MOD
        return out


def _extend(h: PrefixHashes, at: np.ndarray, p: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
    """The longest common extension of at and at + p, at most most words, by halving all at once."""
    low, high = np.zeros(len(at), np.int64), most.copy()
    while (open_ := low < high).any():
        half = np.where(open_, (low + high + 1) >> 1, low)
        good = h.same(at if forward else at - half, half, p)
        low, high = np.where(open_ & good, half, low), np.where(open_ & ~good, half - 1, high)
    return low


def _grid(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, period, grid point) of texts of n words, in slices of about SLICE pairs."""
    periods = n // LEAST_TIMES
    text = np.repeat(np.arange(len(n)), periods)
    p = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    count = n[text] // (2 * p)
    first = np.cumsum(count) - count
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(first, first[a] + SLICE)))
        c = count[a:b]
        k = np.arange(int(c.sum())) - np.repeat(first[a:b] - first[a], c)
        yield np.repeat(text[a:b], c), (q := np.repeat(p[a:b], c)), 2 * q * k
        a = b


def _by_distance(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) by comparing all words at each distance: exact, for texts whose hashes collide."""
    found: dict[tuple[int, int], int] = {}
    for p in range(1, len(words) // LEAST_TIMES + 1):
        edge = np.diff(np.concatenate([[0], (words[:-p] == words[p:]).astype(np.int8), [0]]))
        for s, e in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + p).tolist()):
            if e - s >= max(LEAST_WORDS, LEAST_TIMES * p):
                found.setdefault((s, e), p)
    return [(s, e, p) for (s, e), p in found.items()]


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period), sorted, of each text; text k is words[bounds[k]:bounds[k + 1]]."""
    n, out = np.diff(bounds), [[] for _ in bounds[1:]]
    h = PrefixHashes(words)
    found = []
    for text, p, at in _grid(n):
        first = bounds[text]
        near = np.flatnonzero(words[first + at] == words[first + at + p])
        near = near[h.same((first + at)[near], p[near], p[near])]
        text, p, at = text[near], p[near], at[near]
        first = bounds[text]
        right = _extend(h, first + at + p, p, n[text] - at - 2 * p, True) + p
        left = _extend(h, first + at, p, at, False)
        s, e = at - left, at + p + right
        long = e - s >= np.maximum(LEAST_WORDS, LEAST_TIMES * p)
        found.append(np.stack([text, s, e, p], 1)[long])
    if not found or not sum(map(len, found)):
        return out
    rows = np.unique(np.concatenate(found), axis=0)
    new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])
    least = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0)), 3]
    wrong = set(rows[rows[:, 3] % least != 0, 0].tolist())
    for text, s, e, p in rows[new].tolist():
        a = int(bounds[text])
        if text not in wrong and (words[a + s : a + e - p] != words[a + s + p : a + e]).any():
            wrong.add(text)
        out[text].append((s, e - s, p))
    for text in wrong:
        out[text] = [(s, e - s, p) for s, e, p in _by_distance(words[bounds[text] : bounds[text + 1]])]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by blanks."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def part(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        coded = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        runs = runs_of(coded, np.cumsum([0, *map(len, texts)]))
        flat = np.array([x for r in runs for x in r], np.int64).reshape(-1, 3)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUN)))
        collapsed = pa.array([_collapsed(*x) for x in zip(texts, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), lists, collapsed], schema=_SCHEMA)

    for batch in batches:
        ids, texts, size = [], [], 0
        for k in range(batch.num_rows):
            text = batch["text"][k].as_py()
            ids.append(batch["doc_id"][k].as_py())
            texts.append(text.encode().split() if text else [])  # of bytes: blanks are 0x20 and 0x09-0x0D alone
            size += len(texts[-1])
            if size >= PART:
                yield part(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield part(ids, texts)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the text without repetitions) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_found, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): documents whose h = crc32(doc_id) ends in 0 repeat p words from word a on, to the end; others stay.

    With g = floor(h / 10) and n words, a = g % n and p = 1 + floor((n - a) / (3 + g % 8)). A null doc_id has no h: its text stays.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.floor(h / 10).cast("long").alias("g"), (h % 10 == 0).alias("hit"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    w = F.when(F.col("hit"), words)
    n = F.size("w").cast("long")
    a = F.col("g") % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)).cast("long")
    named = chosen.withColumn("w", w).withColumn("a", a).withColumn("p", p)

    def part(x: Column, start: Column, length: Column) -> Column:
        return F.slice(x, start.cast("int"), length.cast("int"))

    unit, rest = part(F.col("w"), F.col("a") + 1, F.col("p")), n - F.col("a")
    cycle = part(F.flatten(F.array_repeat(unit, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    text = F.when(F.col("hit") & (n > 0), F.concat_ws(" ", F.concat(part(F.col("w"), F.lit(1), F.col("a")), cycle))).otherwise(F.col("text"))
    return named.select("doc_id", text.alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run and sha256 of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    named = found.withColumn("best", best)
    return named.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        "n_words",
    )
