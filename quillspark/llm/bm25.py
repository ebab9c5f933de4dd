"""Exact top-k search: BM25 over an inverted index with block-max WAND pruning, per shard, merged exactly.

A word is a run of bytes other than white space, A-Z in lower case.

Index: one pass over the documents writes shards of at most SHARD_DOCS documents: for each term its
postings (document, frequency) in document order and for each block of BLOCK postings its largest BM25
factor; a block's last document and a list's largest factor are read off these. Factors are without idf, so that the shards
don't depend on the queries; documents of a shard are ordered by length, as those of one length have alike
factors. The index is written once; document frequencies are summed from it. A row of it has megabytes, so
it is written in row groups of ROW_GROUP_BYTES and every step sends batches of BATCH_BYTES to Python: what
an executor holds is a few shards a core, whatever the input.

Search: queries become term lists with their weights (idf times how often the query has the term),
written in groups of QUERY_GROUP. Groups and shards meet in blocks, a stated query set against all
rows: the groups are broadcast if their bytes, counted first, are at most BROADCAST_BYTES; else Spark
pairs partitions of both. For one query and shard, WAND looks at the bounds of whole lists first: if
they don't add up to the bar, the query's k-th best score so far, nothing more is read. Lists of low bounds
that don't reach the bar together are idle: only documents of the other lists can be pivots, all of which
are found at once. The cursors of the idle lists, the strongest first, jump to the pivots: a pivot whose
score so far and block maxima don't reach the bar is dropped before a posting of it is read. The bar of a
first shard comes from documents of its strongest lists. A task keeps the best scores of the queries of
BAR_GROUPS groups at most, so that the bar of one shard serves the next. What a shard returns are its
documents of a score not below the bar, k at most, under the global statistics; so they merge exactly.

Defined cases: null or empty text: a document (or query) of no words, never found (finding nothing). A
document is found if it has a query word. Scores are rounded to 9 decimals; ties go to the least
doc_id, nulls first, rows of equal doc_id in any order. Repeated documents are documents of their own.
Query rows of one query_id (null is one too) are one query: their words are taken together. A word that a
query repeats counts as often. Very long texts are indexed and searched whole. Empty tables give an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written
from quillspark.llm.words import text_parts, word_hashes

K1, B = 1.2, 0.75
BLOCK, PRIMING, AHEAD = 32, 4, 16
SHARD_DOCS, SHARD_POSTINGS = 8_192, 300_000
QUERY_GROUP = 1000
BROADCAST_BYTES, BAR_GROUPS = 64 << 20, 32
ROW_GROUP_BYTES, BATCH_BYTES = 8 << 20, 8 << 20
_ROUND = 9

_ARRAYS = ("doc_ids", "known", "lengths", "terms", "sizes", "most", "doc", "tf")
_SHARD = pa.schema([("shard", pa.int64())] + [(c, pa.binary()) for c in _ARRAYS])
_QUERY = ("query_ids", "query_known", "bounds", "query_terms", "weights")
_SHARD_DDL = ", ".join(["shard long", *(f"{c} binary" for c in _ARRAYS)])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The jobs that run within send batches of BATCH_BYTES, and a row at most beyond, to Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written in row groups of ROW_GROUP_BYTES, looked at from the first row on: by default Parquet's writer gathers 100 rows before it
    looks, and its reader takes a row group at a time."""
    return written(df, name, options={"parquet.enable.dictionary": "false", "parquet.block.size": ROW_GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.slice(r, 1).to_pylist()[0]


def statistics(docs: DataFrame) -> tuple[int, float]:
    """Number of documents and their mean length in words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in batches:
            for _, _, data, bounds in text_parts(batch["text"]):
                words += int(word_hashes(data, bounds)[1][-1])
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([words])], names=["n", "words"])

    n, words = docs.select("text").mapInArrow(count, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    return n or 0, (words / n if words else 1.0)


def factors(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """What BM25 multiplies the idf by."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _ranges(first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    size = stop - first
    which = np.repeat(np.arange(len(size)), size)
    return np.arange(int(size.sum())) + (first - (np.cumsum(size) - size))[which], which


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first posting and the first block of each list of so many postings, one more at the end, and the first posting of each block."""
    first_posting, first_block = (np.concatenate([[0], np.cumsum(x)]).astype(np.int64) for x in (sizes, -(-sizes // BLOCK)))
    block, of = _ranges(first_block[:-1], first_block[1:])
    return first_posting, first_block, first_posting[of] + BLOCK * (block - first_block[of])


def _shard(number: int, ids: list[int | None], parts: list[tuple], mean: float) -> tuple:
    """parts: (term, document, frequency, length of that document) of postings. Documents are put in order of
    length, as those of one length have alike factors, so that a block's largest is near the others."""
    term, doc, tf, length = (np.concatenate(x) for x in zip(*parts))
    lengths = np.zeros(len(ids), np.int64)
    lengths[doc] = length
    order = np.argsort(lengths, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    lengths = lengths[order]
    doc, ids = place[doc], [ids[k] for k in order.tolist()]
    order = np.lexsort((doc, term))
    term, doc, tf, length = term[order], doc[order], tf[order], length[order]
    new_term = np.concatenate([[True], term[1:] != term[:-1]]) if len(term) else np.empty(0, bool)
    lists = np.flatnonzero(new_term)
    sizes = np.diff(np.append(lists, len(term)))
    at = _blocks(sizes)[2]
    top = np.maximum.reduceat(factors(tf, length, mean), at) if len(at) else np.empty(0)
    return (
        number, np.array([i or 0 for i in ids], "<i8").tobytes(), np.array([i is not None for i in ids], np.uint8).tobytes(), lengths.astype("<i4").tobytes(), term[lists].tobytes(), sizes.astype("<u2").tobytes(),
        np.nextafter(top.astype("<f4"), np.float32(np.inf)).tobytes(),  # never below
        doc.astype("<u2").tobytes(), tf.astype("<u2" if len(tf) == 0 or tf.max() < 1 << 16 else "<i4").tobytes(),
    )


def build_index(docs: DataFrame, mean: float) -> DataFrame:
    """The written shards of docs (doc_id, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, parts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(_shard(number, ids, parts, mean), _SHARD)], schema=_SHARD)

        for batch in batches:
            doc_ids = batch["doc_id"].to_pylist()
            for a, _, data, bounds in text_parts(batch["text"]):
                words, first = word_hashes(data, bounds)
                for k, (x, y) in enumerate(zip(first.tolist(), first[1:].tolist()), a):
                    term, tf = np.unique(words[x:y], return_counts=True)
                    parts.append((term, np.full(len(term), len(ids)), tf, np.full(len(term), y - x)))
                    ids.append(doc_ids[k])
                    held += len(term)
                    if len(ids) == SHARD_DOCS or held >= SHARD_POSTINGS:
                        yield out()
                        number, ids, parts, held = number + 1, [], [], 0
        if ids:
            yield out()

    return _written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, _SHARD_DDL), "bm25-index")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df) of every term of the index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, sizes in zip(batch["terms"].to_pylist(), batch["sizes"].to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(terms, np.int64)), pa.array(np.frombuffer(sizes, "<u2").astype(np.int64))], names=["term", "n"])

    return index.select("terms", "sizes").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def query_groups(queries: DataFrame, index: DataFrame, n_docs: int) -> DataFrame:
    """Written groups of queries: (group, query_ids, query_known, bounds, query_terms, weights), each query's terms one after another."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["query_id"]
            for a, b, data, bounds in text_parts(batch["text"]):
                words, first = word_hashes(data, bounds)
                row = np.repeat(np.arange(a, b), np.diff(first))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(words.view(np.int64))], names=["query_id", "term"])

    asked = queries.select(F.col("query_id").cast("long"), F.col("text").cast("string")).mapInArrow(words_of, "query_id long, term long")
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("n"))
    idf = F.log1p((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(document_frequencies(index), "term").select("query_id", "term", (F.col("n") * idf).alias("weight"))
    lists = weighed.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_GROUP):
                part = batch.slice(a, QUERY_GROUP)
                ids, t = part["query_id"].to_pylist(), part["t"]
                flat, bounds = t.flatten(), np.concatenate([[0], np.cumsum(t.value_lengths().to_numpy())])
                terms, weights = flat.field("term").to_numpy(), flat.field("weight").to_numpy()
                row = (np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], np.uint8), bounds.astype("<i8"), terms, weights)
                yield pa.RecordBatch.from_arrays([pa.array([group])] + [pa.array([x.tobytes()], pa.binary()) for x in row], names=["group", *_QUERY])
                group += 1

    return _written(lists.mapInArrow(pack, ", ".join(["group long", *(f"{c} binary" for c in _QUERY)])), "bm25-queries")


class Shard:
    """A shard's inverted index, as read from its row; `touched` counts the postings and `maxima` the block maxima
    that searches have read."""

    def __init__(self, row: dict, mean: float):
        self.mean, self.lengths = mean, np.frombuffer(row["lengths"], "<i4")
        self.doc_ids, self.known = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["known"], np.uint8).astype(bool)
        self.terms, self.most, self.doc = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["most"], "<f4"), np.frombuffer(row["doc"], "<u2")
        self.tf = np.frombuffer(row["tf"], "<u2" if len(row["tf"]) == len(row["doc"]) else "<i4")
        self.first_posting, self.first_block, at = _blocks(np.frombuffer(row["sizes"], "<u2").astype(np.int64))
        self.list_most = np.maximum.reduceat(self.most, self.first_block[:-1]) if len(self.terms) else self.most
        self.sorted = np.argsort(self.terms)
        number = np.arange(len(self.terms)) << 16  # (list, document) as one ascending key, for cursors of many lists
        self.keys = np.repeat(number, np.diff(self.first_posting)) + self.doc
        self.block_keys = np.repeat(number, np.diff(self.first_block)) + self.doc[np.append(at[1:], len(self.doc))[: len(at)] - 1]
        self.touched = self.maxima = 0

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of those of the terms that are here, and their weights."""
        if not len(self.terms) or not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        k = self.sorted[np.minimum(np.searchsorted(self.terms, terms, sorter=self.sorted), len(self.terms) - 1)]
        here = self.terms[k] == terms
        return k[here], weights[here]


    def sums(self, lists: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What whole lists give to the score of each document."""
        posting, of = _ranges(self.first_posting[lists], self.first_posting[lists + 1])
        self.touched += len(posting)
        doc = self.doc[posting]
        return np.bincount(doc, weights[of] * factors(self.tf[posting], self.lengths[doc], self.mean), len(self.lengths))

    def block_maxima(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For each list and ascending document, the maximum of the block where the list's cursor lands; 0 past its end."""
        at = np.searchsorted(self.block_keys, (lists[:, None] << 16) + docs)
        there = at < self.first_block[lists + 1][:, None]
        self.maxima += int(there[:, :1].sum()) + int(np.count_nonzero(np.diff(at, axis=1) * there[:, 1:]))
        return np.where(there, self.most[np.minimum(at, len(self.most) - 1)], 0.0)

    def probe(self, lists: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """For pairs of a list and a document the factor, 0 where the list lacks the document."""
        key = (lists << 16) + docs
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        self.touched += len(docs)
        return np.where(self.keys[at] == key, factors(self.tf[at], self.lengths[docs], self.mean), 0.0)


_NEAR = 1e-8  # bounds and rounded scores that are this near to the bar may still reach it


def _finished(shard: Shard, docs: np.ndarray, scores: np.ndarray, lists: np.ndarray, weights: np.ndarray, k: int, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """The pivots, and their scores, that still reach the bar after the postings of the idle lists (ascending bounds) are added.

    Block maxima are read for more and more lists at a time, AHEAD at most; the lists after these count with their bounds. Lists that are
    together shorter than their cursors would have to jump are read whole instead.
    """
    below = np.concatenate([[0.0], np.cumsum(weights * shard.list_most[lists])])
    stop = len(lists)
    while stop:
        start = max(0, stop - min(AHEAD, 1 + (len(lists) - stop) // 2))
        if len(scores) >= k:
            bar = max(bar, float(np.partition(scores, -k)[-k]))
        good = scores + below[stop] >= bar - _NEAR
        docs, scores = docs[good], scores[good]
        if (shard.first_posting[lists[start:stop] + 1] - shard.first_posting[lists[start:stop]]).sum() <= len(docs) * (stop - start) // 4:
            scores += shard.sums(lists[start:stop], weights[start:stop])[docs]
            stop = start
            continue
        bounds = weights[start:stop, None] * shard.block_maxima(lists[start:stop], docs)
        good = scores + bounds.sum(axis=0) + below[start] >= bar - _NEAR
        docs, scores = docs[good], scores[good]
        of, d = np.nonzero(bounds[:, good])
        scores += np.bincount(d, weights[start + of] * shard.probe(lists[start + of], docs[d]), len(docs))
        stop = start
    return docs, np.round(scores, _ROUND)


def search(shard: Shard, terms: np.ndarray, weights: np.ndarray, k: int, bar: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a shard's k best for a query among those whose score is not below bar; ties at the end are all kept."""
    lists, weights = shard.lists(terms, weights)
    whole = weights * shard.list_most[lists]
    if not len(lists) or whole.sum() < bar - _NEAR:
        return np.empty(0, np.int64), np.empty(0)
    order = np.argsort(whole, kind="stable")
    lists, weights, bounds = lists[order], weights[order], np.cumsum(whole[order])

    if not bar:  # from documents of the strongest lists, that are few in postings
        size = np.cumsum((shard.first_posting[lists + 1] - shard.first_posting[lists])[::-1])
        most = max(int(np.searchsorted(size, max(PRIMING * k, int(size[-1]) // 16), side="right")), int(np.searchsorted(size, k)) + 1)
        strong = max(0, len(lists) - most)
        part = shard.sums(lists[strong:], weights[strong:])
        docs = np.flatnonzero(part)
        docs = np.sort(docs[np.argsort(-part[docs], kind="stable")[: PRIMING * k]])
        _, scores = _finished(shard, docs, part[docs], lists[:strong], weights[:strong], k, 0.0)
        bar = float(np.partition(scores, -k)[-k]) if len(scores) >= k else 0.0

    idle = int(np.searchsorted(bounds, bar - _NEAR))  # these lists alone don't reach the bar: no pivots of theirs
    part = shard.sums(lists[idle:], weights[idle:])
    docs = np.flatnonzero((part > 0) & (part + (bounds[idle - 1] if idle else 0.0) >= bar - _NEAR))
    docs, scores = _finished(shard, docs, part[docs], lists[:idle], weights[:idle], k, bar)
    if len(scores) >= k:
        bar = max(bar, float(np.partition(scores, -k)[-k]))
    good = scores >= bar  # equal scores may win by doc_id
    return docs[good], scores[good]


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents (doc_id, text) of each query (query_id, text), searched now and written."""
    with small_batches(docs.sparkSession):
        return written(_top_k(docs, queries, k), "bm25-found")


def _top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    n_docs, mean = statistics(docs)
    index = build_index(docs, mean)
    groups = query_groups(queries, index, n_docs)
    schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shard = None
        bars: dict[int, list[np.ndarray]] = {}  # of each group, the best scores of its queries that this task has seen
        for row in _rows(batches):
            if shard is None or row["shard"] != number:
                number, shard = row["shard"], Shard(row, mean)
            ids, known = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["query_known"], np.uint8)
            bounds, terms, weights = np.frombuffer(row["bounds"], "<i8"), np.frombuffer(row["query_terms"], np.int64), np.frombuffer(row["weights"])
            best = bars.pop(row["group"], None) or [np.empty(0)] * len(ids)
            out: list[list] = [[], [], []]
            for q, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                found, scores = search(shard, terms[a:b], weights[a:b], k, float(best[q][-1]) if len(best[q]) == k else 0.0)
                order = np.lexsort((shard.doc_ids[found], shard.known[found], -scores))[:k]
                out[0] += [int(ids[q]) if known[q] else None] * len(order)
                out[1] += [int(shard.doc_ids[d]) if shard.known[d] else None for d in found[order]]
                out[2] += scores[order].tolist()
                best[q] = -np.sort(-np.concatenate([best[q], scores[order]]))[:k]
            bars[row["group"]] = best
            if len(bars) > BAR_GROUPS:
                del bars[next(iter(bars))]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, schema)], schema=schema)

    # Groups of the stated queries, in blocks, against all shards.
    size = groups.agg(F.sum(reduce(lambda x, y: x + y, [F.length(c) for c in _QUERY]))).first()[0] or 0
    pairs = index.crossJoin(F.broadcast(groups) if size <= BROADCAST_BYTES else groups)
    found = pairs.mapInArrow(find, "query_id long, doc_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
