"""Near copies of embedding vectors: an inverted multi-index, multi-sequence traversal, exact verification.

1. Equal vectors are one class throughout, with a weight. A codebook of each half of the vectors is fitted on a sample
   of about SAMPLE classes (chosen by hash; every class is indexed); the two centroids nearest to a vector's halves
   name its cell in the product grid.
2. A vector visits cells in the order of the sum of its halves' distances to their centroids, less those of its own
   cell, by the multi-sequence algorithm, up to a cutoff. The cutoff is what finds the share RECALL of pairs exactly
   at the threshold, made from sampled vectors, half of them moved towards other vectors and half in random directions;
   closer pairs are found more often. A pair is found if either vector visits the other's cell.
3. Found pairs are verified in double precision: a cell is cut into blocks of BLOCK vectors, and a block's residents
   are multiplied with those who visit them. Links are counted where they are found and only those that connect
   something new are kept, so that no pairs are written.
4. A crowded cell has balls: vectors within half of the threshold's angle of one of some HUBS of its vectors. By
   the triangle inequality all of a ball are linked with each other; one product with the hub tells a visitor whether
   it is linked with the whole ball or with nothing in it, and only if neither is certain is it compared with the ball's
   blocks. So a group of many near copies isn't compared pair by pair.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Shorter
vectors count as filled with zeros to the longest length. Repeated rows are vectors of their own, linked with each
other; so are rows of one vec_id. A null vec_id never names a component; one of null ids alone has a null component_id,
and kept compares null-safely. An empty table gives an empty result. Other columns are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import written

SAMPLE = 20_000
RECALL = 0.99
MOST_CENTROIDS = 1024
BLOCK = 512  # residents multiplied at once
CROWDED = 8  # a cell of so many times the mean, and of more than a block, has balls
SLICE = 32 * BLOCK  # a cell of more residents deals its visitors to several tasks
HUBS, LEAST_BALL = 16, 16
APART = 0.2  # centroids nearer than this to another are dropped: they would cut groups of near copies
BROADCAST_CELLS, BROADCAST_CROWDED = 200_000, 1_000  # rows of two numbers; rows of HUBS vectors: some MB each
MARGIN = 1e-6  # radians by which the triangle inequality must hold


class Index(NamedTuple):
    first: np.ndarray  # centroids of the first half
    second: np.ndarray
    cutoff: float


def _unit_rows(width: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["embedding"]
            n, valid = len(lists), lists.is_valid().to_numpy(zero_copy_only=False)
            length = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            values = lists.flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False)
            x = np.zeros((n, width))
            row = np.repeat(np.arange(n), length)
            x[row, np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = values
            peak = np.abs(x).max(axis=1, initial=0.0)
            good = np.isfinite(peak) & (peak > 0)
            x[good] /= peak[good, None]
            keys = [hashlib.blake2b((v + 0.0).tobytes() + p.tobytes(), digest_size=16).digest() if g else None for v, p, g in zip(x, peak, good)]
            x[good] /= np.sqrt((x[good] ** 2).sum(1))[:, None]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(keys, pa.binary()), pa.array([v.tobytes() if g else None for v, g in zip(x, good)], pa.binary())], names=["vec_id", "key", "unit"])

    return units


def centroids(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centroids of x by k-means from spread starts; of two that are near each other one is dropped."""
    rng = np.random.default_rng(12)
    chosen, gap = [x[0]], np.full(len(x), np.inf)
    for _ in range(k - 1):
        gap = np.minimum(gap, ((x - chosen[-1]) ** 2).sum(1))
        if gap.sum() <= 0:
            break
        chosen.append(x[rng.choice(len(x), p=gap / gap.sum())])
    c = np.array(chosen)
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    kept: list[np.ndarray] = []
    for v in c[np.argsort(-np.bincount(_distances(x, c).argmin(1), minlength=len(c)), kind="stable")]:
        if all(((v - o) ** 2).sum() >= APART**2 for o in kept):
            kept.append(v)
    return np.array(kept)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, less each vector's own square."""
    return (c * c).sum(1) - 2 * x @ c.T


def _gaps(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's distances to the centroids beyond that to its nearest, and the nearest."""
    d = _distances(x, c)
    near = d.argmin(1)
    return d - d[np.arange(len(x)), near][:, None], near


def fit(sample: np.ndarray, n: int, least: float, recall: float) -> Index:
    """Codebooks and cutoff from a sample of unit vectors, for an index of n vectors and pairs of cosine least or more."""
    half = sample.shape[1] // 2
    k = min(MOST_CENTROIDS, 1 << max(0, int(np.log2(max(1.0, (n / 8) ** 0.5)))))
    first, second = centroids(sample[:, :half], k), centroids(sample[:, half:], k)
    rng = np.random.default_rng(7)
    u = sample[rng.permutation(len(sample))[:4000]]
    cut = 0.0
    for towards in (rng.normal(size=u.shape), np.roll(u, 1, axis=0)):
        w = towards - (towards * u).sum(1, keepdims=True) * u
        size = np.sqrt((w * w).sum(1, keepdims=True))
        v = least * u + np.sqrt(1 - least * least) * w / np.where(size > 1e-9, size, 1)
        (a, ha), (b, hb) = _gaps(u[:, :half], first), _gaps(u[:, half:], second)
        (c, hc), (d, hd) = _gaps(v[:, :half], first), _gaps(v[:, half:], second)
        row = np.arange(len(u))
        cut = max(cut, float(np.quantile(np.minimum(a[row, hc] + b[row, hd], c[row, ha] + d[row, hb]), recall)))
    return Index(first, second, cut)


def traverse(a: np.ndarray, b: np.ndarray, cutoff: float) -> Iterator[tuple[float, int, int]]:
    """(sum, place in a, place in b) of the pairs of two sequences, by ascending sums up to cutoff: the multi-sequence algorithm."""
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, done = [(float(a[i[0]] + b[j[0]]), 0, 0)], set()
    while heap:
        total, x, y = heapq.heappop(heap)
        if total > cutoff:
            return
        yield total, int(i[x]), int(j[y])
        done.add((x, y))
        if x + 1 < len(i) and (y == 0 or (x + 1, y - 1) in done):
            heapq.heappush(heap, (float(a[i[x + 1]] + b[j[y]]), x + 1, y))
        if y + 1 < len(j) and (x == 0 or (x - 1, y + 1) in done):
            heapq.heappush(heap, (float(a[i[x]] + b[j[y + 1]]), x, y + 1))


def _matrix(units: pa.Array | list) -> np.ndarray:
    values = units.to_pylist() if isinstance(units, pa.Array) else units
    return np.frombuffer(b"".join(values)).reshape(len(values), -1)


def _placer(index: Index):
    """(c, w, unit) with its cell and the other cells that it visits."""
    grid = len(index.second)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["unit"])
            half = x.shape[1] // 2
            (a, i), (b, j) = _gaps(x[:, :half], index.first), _gaps(x[:, half:], index.second)
            home = i.astype(np.int64) * grid + j
            alone = (np.sort(a, 1)[:, 1:2].min(1, initial=np.inf) > index.cutoff) & (np.sort(b, 1)[:, 1:2].min(1, initial=np.inf) > index.cutoff)
            visits = [[] if one else [v for v in (p * grid + q for _, p, q in traverse(a[k], b[k], index.cutoff)) if v != home[k]] for k, one in enumerate(alone)]
            yield pa.RecordBatch.from_arrays([batch["c"], batch["w"], pa.array(home), pa.array(visits, pa.list_(pa.int64())), batch["unit"]], names=["c", "w", "home", "visits", "unit"])

    return placed


def _ball_finder(within: float):
    """Rows with their crowded cell's hubs: the first hub within the angle, and the angle."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c, w, home, visits, unit, hubs in zip(*[batch[k].to_pylist() for k in ("c", "w", "home", "visits", "unit", "hubs")]):
                ball, angle = None, None
                if hubs:
                    angles = np.arccos(np.clip(_matrix([h["unit"] for h in hubs]) @ np.frombuffer(unit), -1, 1))
                    near = np.flatnonzero(angles <= within)
                    if len(near):
                        ball, angle = hubs[near[0]]["c"], float(angles[near[0]])
                out.append((c, w, home, visits, unit, ball, angle))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), _PLACED.types)], schema=_PLACED)

    return found


_PLACED = pa.schema([("c", pa.int64()), ("w", pa.int64()), ("home", pa.int64()), ("visits", pa.list_(pa.int64())), ("unit", pa.binary()), ("ball", pa.int64()), ("angle", pa.float64())])
_ROUTE = pa.schema([("cell", pa.int64()), ("g", pa.int64()), ("block", pa.int64()), ("slice", pa.int64()), ("c", pa.int64()), ("w", pa.int64()), ("home", pa.int64()), ("unit", pa.binary()), ("links", pa.int64()), ("back", pa.int64())])
_COUNTED = pa.schema([("c", pa.int64()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _router(angle: float):
    """A visit of a cell with balls -> the blocks to be compared with (links null), or a ball linked as a whole (links, and back for its own)."""

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell, c, w, home, unit, own, blocks, balls, slices in zip(*[batch[k].to_pylist() for k in ("cell", "c", "w", "home", "unit", "ball", "blocks", "balls", "slices")]):
                out += [(cell, -1, k, c % slices, c, w, home, unit, None, None) for k in range(blocks or 0)]
                angles = np.arccos(np.clip(_matrix([b["unit"] for b in balls]) @ np.frombuffer(unit), -1, 1)).tolist() if balls else ()
                for b, far in zip(balls or (), angles):
                    if far + b["radius"] <= angle - MARGIN or own == b["ball"]:
                        mutual = home == cell or home in b["visits"]
                        out.append((cell, b["ball"], None, None, c, w, home, None, b["weight"] - (w if own == b["ball"] else 0), 0 if mutual else w))
                    elif far - b["radius"] <= angle + MARGIN:
                        out += [(cell, b["ball"], k, c % slices, c, w, home, unit, None, None) for k in range(b["blocks"])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), _ROUTE.types)], schema=_ROUTE)

    return routed


class _Block:
    """A block's residents, and what its visitors found so far."""

    def __init__(self, cell: int, ball: int, rows: list[tuple], least: float):
        self.cell, self.least = cell, least
        self.c, self.w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        self.x = _matrix([r[3] for r in rows])
        self.back = np.zeros(len(rows), np.int64)
        self.part = np.arange(len(rows)) if ball < 0 else np.zeros(len(rows), np.int64)
        self.visits = np.unique(np.array([k * (1 << 22) + v for k, r in enumerate(rows) for v in r[4] or ()], np.int64))

    def ask(self, rows: list[tuple]) -> list[tuple]:
        """(c, links, None, None) of the visitors, and (None, None, c, c) of links that connect something new."""
        out = []
        c, w, home = (np.array([r[k] for r in rows]) for k in range(3))
        i, j = np.nonzero(_matrix([r[3] for r in rows]) @ self.x.T >= self.least)
        other = c[i] != self.c[j]
        i, j = i[other], j[other]
        if not len(i):
            return out
        links = np.bincount(i, self.w[j], len(rows)).astype(np.int64)
        out += [(int(c[k]), int(links[k]), None, None) for k in np.flatnonzero(links)]
        code = j * (1 << 22) + home[i]
        seen = np.isin(code, self.visits) if len(self.visits) else np.zeros(len(code), bool)
        one_way = (home[i] != self.cell) & ~seen
        self.back += np.bincount(j[one_way], w[i[one_way]], len(self.back)).astype(np.int64)
        edge = np.flatnonzero(np.diff(np.append(-1, i)))
        for a, b in zip(edge, [*edge[1:], len(i)]):
            parts, at = np.unique(self.part[j[a:b]], return_index=True)
            out += [(None, None, int(c[i[a]]), int(self.c[j[a + k]])) for k in at]
            if len(parts) > 1:
                self.part[np.isin(self.part, parts)] = parts[0]
        return out

    def owed(self) -> list[tuple]:
        return [(int(self.c[k]), int(self.back[k]), None, None) for k in np.flatnonzero(self.back)]


def _comparer(least: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, residents, asking, block = None, [], [], None
        out: list[tuple] = []

        def ask() -> None:
            nonlocal block
            if asking and residents:
                block = block or _Block(now[0], now[1], residents, least)
                out.extend(block.ask(asking))
            asking.clear()

        for batch in batches:
            for cell, ball, k, part, side, c, w, home, unit, visits in zip(*[batch[x].to_pylist() for x in ("cell", "g", "block", "slice", "side", "c", "w", "home", "unit", "visits")]):
                if now != (cell, ball, k, part):
                    ask()
                    out += block.owed() if block else []
                    now, residents, block = (cell, ball, k, part), [], None
                (asking if side else residents).append((c, w, home, unit, visits))
                if len(asking) >= BLOCK:
                    ask()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), _COUNTED.types)], schema=_COUNTED)
                out.clear()
        ask()
        out += block.owed() if block else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out), _COUNTED.types)], schema=_COUNTED)

    return compared


def _links(placed: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """placed (c, w, home, visits, unit) -> (c, links) with those inside classes left out, and (a, b) links that connect all that is linked."""
    angle = float(np.arccos(least))
    counts = written(placed.groupBy("home").agg(F.count("*").alias("residents")), "cells")
    mean = counts.agg(F.avg("residents")).first()[0]
    crowded = counts.where(F.col("residents") > max(BLOCK, CROWDED * mean)).withColumnRenamed("home", "hot")
    chance = F.xxhash64(F.lit("hub"), "c") / F.lit(float(1 << 64)) + 0.5
    hubs = placed.join(crowded, F.col("home") == F.col("hot")).where(chance < HUBS / F.col("residents"))
    hubs = written(hubs.groupBy("hot").agg(F.array_sort(F.collect_list(F.struct("c", "unit", "visits"))).alias("hubs")), "hubs")
    few = hubs.limit(BROADCAST_CROWDED + 1).count() <= BROADCAST_CROWDED
    small = F.broadcast if few else lambda df: df
    given = placed.join(small(hubs), F.col("home") == F.col("hot"), "left")
    found = written(given.mapInArrow(_ball_finder(angle / 2 - MARGIN), "c long, w long, home long, visits array<long>, unit binary, ball long, angle double"), "balled")

    size = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    members = found.where("ball IS NOT NULL").groupBy("ball", "home").agg(F.sum("w").alias("weight"), F.count("*").alias("m"), F.max("angle").alias("radius")).where(F.col("m") >= LEAST_BALL)
    heart = hubs.select(F.explode("hubs").alias("h")).select(F.col("h.c").alias("hub"), F.col("h.unit").alias("unit"), F.col("h.visits").alias("visits"))
    balls = written(members.join(heart, F.col("ball") == F.col("hub")).select("ball", "home", "weight", "radius", "unit", "visits", size("m").alias("blocks")), "balls")
    # A ball's vectors visit what its hub visits, so that whether it visits a cell is known of all alike.
    kept = balls.select(F.col("ball").alias("kept"), F.col("visits").alias("hub_visits"), F.col("blocks").alias("ball_blocks"))
    balled = found.join(small(kept), F.col("ball") == F.col("kept"), "left")
    balled = balled.select("c", "w", "home", F.when(F.col("kept").isNull(), F.col("visits")).otherwise(F.col("hub_visits")).alias("visits"), "unit", F.col("kept").alias("ball"), "ball_blocks")
    regular = balled.where("ball IS NULL").groupBy("home").agg(F.count("*").alias("n")).select(F.col("home").alias("cell"), size("n").alias("blocks"))
    of_cell = balls.groupBy(F.col("home").alias("cell")).agg(F.collect_list(F.struct("ball", "weight", "radius", "unit", "visits", "blocks")).alias("balls"))
    cells = counts.select(F.col("home").alias("cell"), F.ceil(F.col("residents") / SLICE).cast("long").alias("slices")).join(regular, "cell", "left").join(of_cell, "cell", "left")
    cells = written(cells, "cells")
    if few and cells.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        cells = F.broadcast(cells)

    asked = balled.select("c", "w", "home", "unit", "ball", F.explode(F.concat(F.array("home"), F.coalesce("visits", F.array().cast("array<long>")))).alias("cell")).join(cells, "cell")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    none = [F.lit(None).cast("long").alias(x) for x in ("links", "back")]
    plain = asked.where("balls IS NULL").select("cell", F.lit(-1).cast("long").alias("g"), upto(F.col("blocks")).alias("block"), F.pmod("c", "slices").alias("slice"), "c", "w", "home", "unit", *none)
    route = "cell long, g long, block long, slice long, c long, w long, home long, unit binary, links long, back long"
    routed = written(asked.where("balls IS NOT NULL").mapInArrow(_router(angle), route), "routes")
    whole = routed.where("links IS NOT NULL")

    place = F.pmod(F.xxhash64("c"), F.coalesce("ball_blocks", "blocks"))
    residents = balled.join(cells, F.col("home") == F.col("cell")).select("cell", F.coalesce("ball", F.lit(-1).cast("long")).alias("g"), place.alias("block"), upto(F.col("slices")).alias("slice"), F.lit(0).alias("side"), "c", "w", "home", "unit", "visits")
    visitors = plain.unionByName(routed.where("links IS NULL")).select("cell", "g", "block", "slice", F.lit(1).alias("side"), "c", "w", "home", "unit", F.lit(None).cast("array<long>").alias("visits"))
    key = ("cell", "g", "block", "slice")
    dealt = residents.unionByName(visitors).repartition(*key).sortWithinPartitions(*key, "side")
    found = written(dealt.mapInArrow(_comparer(least), "c long, links long, a long, b long"), "found")

    back = whole.groupBy("g").agg(F.sum("back").alias("links")).where("links > 0")
    credit = found.where("c IS NOT NULL").select("c", "links").unionByName(whole.select("c", "links"))
    credit = credit.unionByName(balled.where("ball IS NOT NULL").select("c", "ball").join(back.withColumnRenamed("g", "ball"), "ball").select("c", "links"))
    edges = found.where("a IS NOT NULL").select("a", "b").unionByName(whole.select(F.col("c").alias("a"), F.col("g").alias("b"))).unionByName(balled.where("ball IS NOT NULL").select(F.col("c").alias("a"), F.col("ball").alias("b")))
    return credit.groupBy("c").agg(F.sum("links").alias("links")), edges


def near_vectors(vectors: DataFrame, least: float = 0.95, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding); links are pairs of cosine least or more.

    least lies between 0 and 1; recall is the share of pairs at exactly that cosine that the visits are made to find.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    width = own.agg(F.max(F.size("embedding"))).first()[0]
    width = max(2, width or 0)
    rows = written(own.mapInArrow(_unit_rows(width), "vec_id long, key binary, unit binary"), "units")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.first("unit").alias("unit"))
    classes = written(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    out = rows.select("vec_id", "key")
    if n == 0:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = F.xxhash64(F.lit("sample"), "key") / F.lit(float(1 << 64)) + 0.5
    sample = [bytes(r["unit"]) for r in classes.where(share < min(1.0, SAMPLE / n) * 1.0000001).select("unit").collect()]
    sample = sample or [bytes(classes.select("unit").first()["unit"])]
    index = fit(_matrix(sample), n, least, recall)
    placed = written(classes.select("c", "w", "unit").mapInArrow(_placer(index), "c long, w long, home long, visits array<long>, unit binary"), "placed")
    credit, edges = _links(placed, least)
    roots = written(components(edges), "roots")
    known = classes.select("key", "c", "least", "w")
    of_root = roots.join(known, roots["node"] == known["c"]).groupBy("root").agg(F.min("least").alias("component"))
    named = roots.join(of_root, "root").select(F.col("node").alias("c"), "component")
    full = known.join(credit, "c", "left").join(named, "c", "left")
    full = full.select("key", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.when(F.col("component").isNull() & F.col("c").isNotNull(), F.col("least")).otherwise(F.col("component")).alias("component_id"), F.lit(True).alias("known"))
    joined = out.join(written(full, "linked"), "key", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
