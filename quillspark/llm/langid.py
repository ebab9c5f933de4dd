"""Language identification by error-correcting output codes.

Each language gets a binary codeword; one linear classifier of hashed byte n-grams is fitted for each
bit (ridge regression on +-1 targets), and a text takes the language whose codeword has the least
loss, each bit weighted by its training accuracy. Text whose two best codewords are close is flagged.

The fit uses a sample of about per_language different labelled texts of each language, whatever their number of
languages (the documented bound): a text is in it, once however often it is repeated, if a hash of it is under the
share that the number of its language's different texts asks for, or if it is the least of its language; so no
language is gathered in one task, and none is left out. Whole texts are read.
The tasks sum the normal equations of the weighted ridge regression, (DIMS + 1) squared numbers
however many languages and rows there are; the driver solves them.

Defined cases: text null, empty or without a letter: 'und', score 0. Null lang: not learned from. Null
doc_id: not held out. No labelled row at all, or an empty table: every text is 'und'. Repeated rows are
predicted each. Very long texts are read in pieces, whole. Extra columns are ignored. Ties take the
alphabetically first language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import written

DIMS = 2048
_SHIFT = np.uint32(32 - DIMS.bit_length() + 1)
#: Sampled rows in a task that sums, and rows of the sums in a message.
TASK_ROWS, SLAB = 4096, 64
BROADCAST_LANGUAGES = 100_000  # rows of a name and two numbers: some MB
_LETTER = r"\p{L}"


def held_out(doc_id) -> F.Column:
    """Whether a document is only for testing; a null doc_id isn't."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def codewords(k: int) -> np.ndarray:
    """k codewords of +-1, far from each other: all dichotomies up to four languages, else seeded random ones."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 4:
        cols = [[1] + [1 if (c >> i) & 1 else -1 for i in range(k - 1)] for c in range(2 ** (k - 1) - 1)]
        return np.array(cols, np.int8).T
    bits, rng = 4 * int(np.ceil(np.log2(k))) + 7, np.random.default_rng(7)
    best, far = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        gram = code.astype(int) @ code.T
        least = (bits - (gram - 10 * bits * np.eye(k, dtype=int)).max()) // 2
        if least > far and np.all(np.abs(code.sum(0)) < k):
            best, far = code, least
    return best


_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[list(b"0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\r\x0b\x0c")] = 32  # no letters: all alike


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed lower-cased byte bigrams, trigrams and 4-grams."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for k, t in enumerate(texts):
        total = np.zeros(DIMS, np.int64)
        for at in range(0, len(t), 1 << 20):  # a long text in pieces, which overlap so that no n-gram is lost
            b = _LOWER[np.frombuffer(b" " + t[at : at + (1 << 20) + 3] + b" ", np.uint8)]
            two = b[:-1] * 257 + b[1:]
            three = two[:-1] * 263 + b[2:]
            four = three[:-1] * 269 + b[3:]
            for x in (two, three, four):
                total += np.bincount((x * np.uint32(2654435761)) >> _SHIFT, minlength=DIMS)
        out[k] = np.sqrt(total / max(1, total.sum()))
    return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # DIMS + 1 by bits; the last row is the intercept
    trust: np.ndarray  # of each bit, from its training accuracy

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, and ambiguity of each text."""
        margin = features(texts) @ self.weights[:-1] + self.weights[-1]
        loss = (np.exp(-np.clip(margin[:, None, :] * self.code[None], -2, 2)) * self.trust).sum(2)  # texts by languages
        best = loss.argmin(1)
        z = -loss / self.trust.sum()
        p = np.exp(4 * (z - z.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        ranked = np.sort(p, 1)
        close = ranked[:, -1] - ranked[:, -2] < 0.1 if p.shape[1] > 1 else np.zeros(len(p), bool)
        return best, p[np.arange(len(p)), best], close


def sample(labelled: DataFrame, per_language: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """(lang, x) of the sampled texts, and how many there are of each language."""
    chance = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    texts = labelled.select("lang", "text", chance.alias("chance"))
    share = texts.select("lang", "chance").distinct().groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share"), F.min("chance").alias("least"))
    share = written(share, "shares")
    share = F.broadcast(share) if share.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else share

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                x = features([t.encode("utf-8", "surrogatepass") for t in part["text"].to_pylist()])
                yield pa.RecordBatch.from_arrays([part["lang"], pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    few = texts.join(share, "lang").where("chance < share OR chance = least").select("lang", "text").distinct()
    drawn = written(few.mapInArrow(shares, "lang string, x binary"), "sample")
    counts = sorted((r["lang"], r["count"]) for r in drawn.groupBy("lang").count().collect())  # a row for each language
    return drawn.repartition(max(1, -(-sum(n for _, n in counts) // TASK_ROWS))), counts


def _rows_of(batch: pa.RecordBatch, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Features with a last 1, and numbers of the languages."""
    x = np.frombuffer(b"".join(batch["x"].to_pylist()), np.float32).reshape(-1, DIMS).astype(np.float64)
    return np.hstack([x, np.ones((len(x), 1))]), np.array([place[n] for n in batch["lang"].to_pylist()])


def fit(docs: DataFrame, per_language: int = 300, ridge: float = 0.02) -> Model | None:
    """Learn from labelled rows of docs (columns doc_id, text, lang)."""
    drawn, counts = sample(docs.where(F.col("lang").isNotNull() & F.col("text").rlike(_LETTER)), per_language)
    if not counts:
        return None
    names = [n for n, _ in counts]
    place, code = {n: k for k, n in enumerate(names)}, codewords(len(names))
    each = 1 / np.array([n for _, n in counts])  # each language counts alike
    width = DIMS + 1 + code.shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((DIMS + 1, width))
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                x, y = _rows_of(batch.slice(a, 512), place)
                total += (x * each[y, None]).T @ np.hstack([x, code[y]])
        slabs = [total[k : k + SLAB].tobytes() for k in range(0, DIMS + 1, SLAB)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(slabs)), pa.int32()), pa.array(slabs, pa.binary())], names=["slab", "data"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(d) for d in pdf["data"]], axis=0)
        return pd.DataFrame({"slab": pdf["slab"].iloc[:1], "data": [data.tobytes()]})

    slabs = drawn.mapInArrow(sums, "slab int, data binary").groupBy("slab").applyInPandas(add, "slab int, data binary").orderBy("slab").toLocalIterator()
    total = np.vstack([np.frombuffer(r["data"]).reshape(-1, width) for r in slabs])  # of fixed size
    gram, aim = total[:, : DIMS + 1], total[:, DIMS + 1 :]
    mean, n = gram[-1, :DIMS] / gram[-1, -1], len(names)
    centred = gram[:DIMS, :DIMS] - n * np.outer(mean, mean)
    level = aim[-1] / n
    w = np.linalg.solve(centred + ridge * np.trace(centred) / DIMS * np.eye(DIMS), aim[:DIMS] - n * np.outer(mean, level))
    weights = np.vstack([w, level - mean @ w]).astype(np.float32)

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _rows_of(batch, place)
            hits = ((x @ weights) * code[y] > 0).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(hits)), pa.int32()), pa.array(hits, pa.int64())], names=["bit", "n"])

    hits = {r["bit"]: r["n"] for r in drawn.mapInArrow(right, "bit int, n long").groupBy("bit").agg(F.sum("n").alias("n")).collect()}
    share = np.array([hits[k] for k in range(code.shape[1])]) / sum(n for _, n in counts)
    return Model(names, code, weights, np.clip(2 * share - 1, 0.05, 1).astype(np.float32))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs; only its text is read."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts, lettered = part["text"].to_pylist(), part["lettered"].to_pylist()
                n = len(texts)
                if model is None:
                    names, score, close = ["und"] * n, [0.0] * n, [False] * n
                else:
                    best, p, close = model.predict([(t or "").encode("utf-8", "surrogatepass") for t in texts])
                    names = [model.languages[b] if ok else "und" for b, ok in zip(best, lettered)]
                    score = [float(s) if ok else 0.0 for s, ok in zip(p, lettered)]
                    close = [bool(c) and bool(ok) for c, ok in zip(close, lettered)]
                yield pa.RecordBatch.from_arrays([part["doc_id"].cast(pa.int64()), pa.array(names), pa.array(score, pa.float64()), pa.array(close)], schema=schema)

    lettered = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), "text", lettered.alias("lettered")).mapInArrow(rows, "doc_id long, lang_pred string, score double, ambiguous boolean")
