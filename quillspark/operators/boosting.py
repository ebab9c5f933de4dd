"""Gradient-boosted trees grown from histograms that the tasks count.

Rows are coded once: each feature by the quantile bin that it falls into, in blocks of some thousand rows. A tree
grows level by level; for each level every task sums the gradients of its rows by (node, feature, bin) and sends these
arrays only, whose size doesn't depend on the rows; a few tasks add them by feature and choose the best splits, and only
these come to the driver. There are no more tasks than cores, so that what is sent doesn't grow with the rows. Validation
rows have tasks of their own, which send counts of the AUC only, and other rows none; a task that has all training rows
chooses the splits itself and sends no sums.
Sums are of whole numbers (gradients in units of 2 ** -20), so a forest is the same however the rows are dealt.

A task's scores of its rows are a cache in the Python worker, with the number of trees in it: trees that are missing
there, or all of them after an executor was lost, are applied again. Each round's ROC-AUC on the validation rows comes
with the counts of the next tree's first level, from scores in 2 ** 12 steps; growth stops when it has not risen for
patience rounds, and the trees after the best round are dropped (one tree stays at least). Several models of the same rows grow in the same jobs.
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.stage import staged

UNIT, STEPS = float(1 << 20), 1 << 12
BLOCK_ROWS = 1 << 14
TASK_ROWS = 1 << 17  # a task has about so many rows
CHOOSERS = 4  # so many tasks add the sums of a level and choose its splits
TRAIN, VAL, REST = 0, 1, 2


@dataclass(frozen=True)
class Spec:
    """How one model grows: symmetric trees share one split in a level; others split their best nodes, up to leaves."""

    name: str
    features: tuple[str, ...]
    rounds: int = 1000
    step: float = 0.04
    depth: int = 6
    l2: float = 3.0
    patience: int | None = 80
    symmetric: bool = True
    leaves: int = 64
    least_rows: int = 1


@dataclass
class Tree:
    """Nodes as arrays; feature -1 marks a leaf, else codes above border go right."""

    feature: list[int] = field(default_factory=lambda: [-1])
    border: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: dict[int, float] = field(default_factory=dict)  # by place of the feature

    def split(self, node: int, feature: int, border: int, values: tuple[float, float]) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.border[node], self.left[node], self.right[node] = feature, border, a, a + 1
        for v in values:
            for column, x in ((self.feature, -1), (self.border, 0), (self.left, 0), (self.right, 0), (self.value, v)):
                column.append(x)
        return a, a + 1

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The node of each row; codes has a row for each feature."""
        feature, border, left, right = (np.array(x) for x in (self.feature, self.border, self.left, self.right))
        at, row = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        while True:
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, np.where(codes[f, row] > border[at], right[at], left[at]), at)


@dataclass
class Forest:
    spec: Spec
    base: float
    borders: list[list[float]]
    trees: list[Tree]
    auc: list[float]  # on the validation rows after 0, 1, ... trees

    def best_round(self) -> int:
        """The number of trees, from 1, of the first highest validation AUC."""
        return 1 + int(np.argmax(self.auc[1:])) if len(self.auc) > 1 else len(self.trees)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores before the logistic function of rows of features."""
        codes = np.stack([code(x[:, k], b) for k, b in enumerate(self.borders)]) if len(self.borders) else np.zeros((0, len(x)), np.uint8)
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += np.array(t.value)[t.place(codes)]
        return out


def code(values: np.ndarray, borders: list[float]) -> np.ndarray:
    """0 for a missing value, else 1 and the number of borders below it."""
    values = np.asarray(values, float)
    return np.where(np.isnan(values), 0, 1 + np.searchsorted(np.array(borders, float), values, side="left")).astype(np.uint8)


def quantile_borders(rows: DataFrame, features: list[str], bins: int, error: float = 1e-3) -> dict[str, list[float]]:
    """Up to bins - 2 distinct borders of each feature: midpoints are not needed, as codes compare with the values themselves."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    found = rows.select(*[F.col(f).cast("double") for f in features]).approxQuantile(features, shares, error)
    return {f: sorted(set(q)) for f, q in zip(features, found)}


def coded_blocks(rows: DataFrame, borders: dict[str, list[float]], label: str, part: str) -> DataFrame:
    """(n, codes, y, part): blocks of rows; codes has a byte for each feature and row, features outermost."""
    features = list(borders)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), BLOCK_ROWS):
                s = b.iloc[k : k + BLOCK_ROWS]
                codes = np.stack([code(s[f].to_numpy(), borders[f]) for f in features])
                yield pd.DataFrame({"n": [len(s)], "codes": [codes.tobytes()], "y": [s["_y"].to_numpy(np.uint8).tobytes()], "part": [s["_part"].to_numpy(np.uint8).tobytes()]})

    typed = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.coalesce(F.col(label).cast("int"), F.lit(0)).alias("_y"), F.col(part).cast("int").alias("_part"))
    return typed.mapInPandas(blocks, "n long, codes binary, y binary, part binary")


_HELD: dict = {}  # scores of blocks, in this worker: (number of trees, scores), by (run, block, model)


def _scores(run: str, block: tuple, model: str, trees: list[Tree], base: float, codes: np.ndarray) -> np.ndarray:
    have, score = _HELD.get((run, block, model), (0, None))
    if score is None or have > len(trees):
        have, score = 0, np.full(codes.shape[1], base)
    for t in trees[have:]:
        score = score + np.array(t.value)[t.place(codes)]
    _HELD[run, block, model] = (len(trees), score)
    return score


def _counts(run: str, names: list[str], models: list[tuple], alone: bool = False):
    """Blocks -> ((model, feature), sums by node and bin of gradients, curvatures and, for unsymmetric trees, rows) and ((model, -1), counts of the AUC).

    Of sums that are whole, as one task has all training rows (alone), only the best splits go on: ((model, 0), _best's result)."""

    def work(blocks: Iterator) -> Iterator[tuple]:
        for key in [k for k in _HELD if k[0] != run]:
            del _HELD[key]
        total: dict = {}
        for block, (n, raw, y, part) in blocks:
            codes = np.frombuffer(raw, np.uint8).reshape(len(names), n)
            y, part = np.frombuffer(y, np.uint8), np.frombuffer(part, np.uint8)
            train = part == TRAIN
            fit, judged = train.any(), (part == VAL).any()
            for m, (name, pick, bins, spec, base, old, new, tree, open_, first) in enumerate(models):
                if not fit and not (first and judged):
                    continue
                mine = codes[pick]
                score = _scores(run, block, name, [*old.value, *new] if old else new, base, mine)
                p = 1 / (1 + np.exp(-score))
                if fit:
                    at = tree.place(mine)
                    slot = np.full(len(tree.feature), -1)
                    slot[open_] = np.arange(len(open_))
                    rows = np.flatnonzero(train & (slot[at] >= 0))
                    g, h = np.rint((p - y)[rows] * UNIT), np.rint((p * (1 - p))[rows] * UNIT)
                    weights = (g, h) if spec.symmetric else (g, h, None)
                    for f, width in enumerate(bins):
                        key = slot[at[rows]] * width + mine[f, rows]
                        sums = np.stack([np.bincount(key, w, len(open_) * width).reshape(len(open_), width) for w in weights], axis=2).astype(float)
                        total[m, f] = total[m, f] + sums if (m, f) in total else sums
                if first and judged:
                    place = np.minimum((p * STEPS).astype(np.int64), STEPS - 1)
                    auc = np.stack([np.bincount(place[(part == VAL) & (y == k)], minlength=STEPS) for k in (0, 1)])
                    total[m, -1] = total[m, -1] + auc if (m, -1) in total else auc
        if alone:
            best: dict = {}
            for m, f in sorted(k for k in total if k[1] >= 0):
                best[m] = _better(best.get(m), _best(total[m, f], f, models[m][3]), models[m][3])
            total = {(m, 0): b for m, b in best.items()} | {k: c for k, c in total.items() if k[1] < 0}
        yield from total.items()

    return work


def auc_of(counts: np.ndarray) -> float:
    """ROC-AUC from counts (negatives, positives) by ascending score; ties count half; 0.5 if a class is absent."""
    neg, pos = counts
    if not neg.sum() or not pos.sum():
        return 0.5
    return float((pos * (np.cumsum(neg) - neg / 2)).sum() / (neg.sum() * pos.sum()))


def _best(sums: np.ndarray, feature: int, spec: Spec) -> tuple:
    """Of one feature's sums (node, bin): for each node the gain of its best split, feature, border and the left side's sums; the node's sums; the gain of all (of symmetric trees: by one border)."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums.sum(axis=1)[:, None]
    quality = lambda s: s[..., 0] ** 2 / (s[..., 1] + spec.l2 * UNIT)
    right = whole - left
    gain = (quality(left) + quality(right) - quality(whole)) / UNIT
    node = np.arange(len(sums))
    if spec.symmetric:
        total = gain.sum(axis=0)
        border = np.full(len(sums), int(total.argmax()))
    else:
        allowed = (left[..., 2] >= spec.least_rows) & (right[..., 2] >= spec.least_rows)
        gain = np.where(allowed, gain, -np.inf)
        border = gain.argmax(axis=1)
    found = gain[node, border]
    return found, np.full(len(sums), feature), border, left[node, border, :2], whole[:, 0, :2], float(total.max()) if spec.symmetric else 0.0


def _better(a: tuple | None, b: tuple, spec: Spec) -> tuple:
    """The better splits of two of _best's results; the first feature of equal ones."""
    if a is None:
        return b
    if spec.symmetric:
        return max(a, b, key=lambda x: (x[5], -x[1][0]))
    take = (b[0] > a[0]) | ((b[0] == a[0]) & (b[1] < a[1]))
    return (*[np.where(take.reshape(-1, *[1] * (x.ndim - 1)), y, x) for x, y in zip(a[:4], b[:4])], a[4], 0.0)


def _chosen(specs: list[Spec]):
    """Whole sums, or best splits, by (model, feature) -> (model, AUC or None, best splits or None), a row for each model."""

    def work(entries: Iterator) -> Iterator[tuple]:
        auc, best = {}, {}
        for (m, f), sums in entries:
            if f < 0:
                auc[m] = auc_of(sums)
            else:
                best[m] = _better(best.get(m), sums if isinstance(sums, tuple) else _best(sums, f, specs[m]), specs[m])
        for m in sorted({*auc, *best}):
            yield m, auc.get(m), best.get(m)

    return work


def _leaf(s: np.ndarray, spec: Spec) -> float:
    return float(-spec.step * s[0] / (s[1] + spec.l2 * UNIT))


def _grow(tree: Tree, open_: list[int], best: tuple, spec: Spec, level: int) -> list[int]:
    """Splits the open nodes by their best splits; the nodes to be opened next."""
    gain, feature, border, left, whole, total = best
    opened: list[int] = []

    def split(k: int) -> None:
        f = int(feature[k])
        opened.extend(tree.split(open_[k], f, int(border[k]), (_leaf(left[k], spec), _leaf(whole[k] - left[k], spec))))
        tree.gain[f] = tree.gain.get(f, 0.0) + float(gain[k])

    if spec.symmetric:
        if total > 1e-9:
            for k in range(len(open_)):
                split(k)
    else:
        room = spec.leaves - sum(f < 0 for f in tree.feature)
        for k in sorted(range(len(open_)), key=lambda k: -gain[k])[: max(0, room)]:
            if gain[k] > 1e-9:
                split(k)
    return opened if level + 1 < spec.depth else []


def _dealt(rows: DataFrame, borders: dict[str, list[float]], label: str, part: str, tag: int):
    """The coded blocks of the rows with keys, (tag, number), kept, in a task for each TASK_ROWS rows, but in no more than there are cores."""
    blocks = staged(coded_blocks(rows, borders, label, part), "coded-rows")
    size = blocks.agg(F.sum("n")).first()[0] or 0
    dealt = blocks.coalesce(max(1, min(size // TASK_ROWS, rows.sparkSession.sparkContext.defaultParallelism))).rdd
    return dealt.zipWithUniqueId().map(lambda r: ((tag, r[1]), (r[0][0], bytes(r[0][1]), bytes(r[0][2]), bytes(r[0][3])))).persist()


def boost(rows: DataFrame, specs: list[Spec], label: str = "label", part: str = "part", bins: int = 64, borders: dict[str, list[float]] | None = None) -> dict[str, Forest]:
    """A forest for each spec, grown on the rows whose part is TRAIN; VAL rows say when to stop."""
    names = list(dict.fromkeys(f for s in specs for f in s.features))
    borders = borders or quantile_borders(rows.where(F.col(part) == TRAIN), names, bins)
    context = rows.sparkSession.sparkContext
    train, val = (_dealt(rows.where(F.col(part) == p), borders, label, part, p) for p in (TRAIN, VAL))
    alone = train.getNumPartitions() == 1
    run = uuid.uuid4().hex
    ones = rows.where(F.col(part) == TRAIN).agg(F.avg(F.col(label).cast("int"))).first()[0]
    share = min(max(ones if ones is not None else 0.5, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    forests = {s.name: Forest(s, base, [borders[f] for f in s.features], [], []) for s in specs}
    sent: dict = {s.name: (None, 0) for s in specs}  # trees that a broadcast holds, and how many
    growing = {s.name: (Tree(), [0], 0) for s in specs}
    while growing:
        models = []
        for name, (tree, open_, level) in growing.items():
            f = forests[name]
            if len(f.trees) - sent[name][1] >= 50:
                sent[name] = (context.broadcast(list(f.trees)), len(f.trees))
            old, n = sent[name]
            models.append((name, [names.index(x) for x in f.spec.features], [len(b) + 2 for b in f.borders], f.spec, base, old, f.trees[n:], tree, open_, level == 0))
        judged = any(m[-1] for m in models)
        sums = (context.union([train, val]) if judged else train).mapPartitions(_counts(run, names, models, alone))
        sums = sums.reduceByKey(operator.add, CHOOSERS) if judged or not alone else sums
        asked = [m[3] for m in models]
        auc, best = {}, {}
        for m, a, b in sums.mapPartitions(_chosen(asked)).collect():  # a row for each model and chooser
            auc |= {m: a} if a is not None else {}
            best |= {m: _better(best.get(m), b, asked[m])} if b is not None else {}
        for m, name in enumerate(list(growing)):
            f, (tree, open_, level) = forests[name], growing[name]
            if level == 0:
                f.auc.append(auc.get(m, 0.5))
                late = f.spec.patience is not None and len(f.trees) - f.best_round() >= f.spec.patience
                if late or len(f.trees) >= f.spec.rounds:
                    del growing[name]
                    continue
            if m in best and (opened := _grow(tree, open_, best[m], f.spec, level)):
                growing[name] = (tree, opened, level + 1)
            elif len(tree.feature) > 1:
                f.trees.append(tree)
                growing[name] = (Tree(), [0], 0)
            else:  # nothing is left to gain
                del growing[name]
    train.unpersist()
    val.unpersist()
    for f in forests.values():
        if f.spec.patience is not None:
            f.trees = f.trees[: f.best_round()]
    return forests


def predict(rows: DataFrame, forests: dict[str, Forest], keep: list[str], each: str = "variant") -> DataFrame:
    """keep, each (the model's name), trees and score of every row and model, in Arrow batches; the forests are sent once to each executor."""
    names = list(dict.fromkeys(x for f in forests.values() for x in f.spec.features))
    sent = rows.sparkSession.sparkContext.broadcast(forests)
    inputs = rows.select(*keep, *[F.col(x).cast("double").alias(f"_f_{x}") for x in names])
    types = dict(rows.dtypes)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, f in sent.value.items():
                x = b[[f"_f_{c}" for c in f.spec.features]].to_numpy(float)
                yield b[keep].assign(**{each: name, "trees": len(f.trees), "score": 1 / (1 + np.exp(-f.raw(x)))})

    return inputs.mapInPandas(score, ", ".join([*[f"`{c}` {types[c]}" for c in keep], f"{each} string", "trees long", "score double"]))


def importances(spark, forests: dict[str, Forest], each: str = "variant") -> DataFrame:
    """(model, feature, importance): the share of all gain that a feature's splits made."""
    rows = []
    for name, f in forests.items():
        gain = [sum(t.gain.get(k, 0.0) for t in f.trees) for k in range(len(f.spec.features))]
        rows += [(name, x, g / (sum(gain) or 1.0)) for x, g in zip(f.spec.features, gain)]
    return spark.createDataFrame(rows, f"{each} string, feature string, importance double")
