"""N-gram Jaccard join: T-occurrence search with DivideSkip inside groups made by prefix filtering.

1. Each document becomes the set of its word shingles' hashes. Hashes go by their top bits to buckets,
   where each bucket counts in how many different sets a hash occurs. A hash of one set alone can't
   link anything, and a set needs at least threshold * size shared hashes to have a partner; only the
   sets that do go on, with just their shared hashes. Copies (equal sets) are one set throughout. A hash
   that a great many documents share (found in a sample) isn't gathered in one bucket: it is shared for
   certain, so it stays with its sets, whose rows are spread, as the last in the order.
2. Two sets at the threshold share a hash among the first size - ceil(threshold * size) + 1 of each, in
   any common order; rare hashes come first. Sets that share such a hash form a group; of groups with
   the same members one is kept.
3. In a group sets query an inverted index of the others: of the lists of the query's hashes the short
   ones are merged, the longest are probed by binary search (DivideSkip), and sets reaching the
   required overlap are links. Only links between sets not yet connected are kept, so a group of n near
   copies yields n - 1.
4. First each set is searched in its largest group only. Then all groups are searched that still hold
   different components and sets that weren't together before. A group of more than BLOCK hashes is
   split into blocks that share one pivot set, and later into pairs of blocks with different
   components. No pair is lost: sets of one component need no further link.

Hashes keep 40 bits below the bucket's; equality of two different shingles by chance adds 1 to one
overlap in about 10 ** 9 pairs of ordinary documents.

Two different sets of one 64-bit id count as one; among n sets that happens n * n / 2 ** 65 times.

Very long texts are read whole: one set. Defined cases: text null, empty or without words: empty set, linked with nothing, its own component
(component_id = doc_id). Repeated rows give one row each. Null doc_id: kept; a component of only such
rows has a null id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.components import components
from quillspark.llm.shared import written
from quillspark.llm.words import mix, shingle_sets, text_parts, word_hashes

#: Hashes of all sets in a block together.
BLOCK = 500_000
#: Buckets: at least so many, and one for so many characters of text (a few MB of hashes each).
LEAST_BUCKETS, BUCKET_CHARS = 64, 24_000_000
_LOW = np.uint64((1 << 40) - 1)

#: A hash in so many of so many sampled documents is hot; its rank is above all counted ones.
HOT_SAMPLE, HOT_COUNT, HOT_RANK = 10_000, 10, 99
#: The hottest so many are looked for: what else is hot stays in the buckets, which changes no result.
HOT_MOST = 200_000

_PACKED = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in ("meta", "sets", "counts", "low", "hot_sets", "hot_counts", "hot")])


def _set_id(h: np.ndarray) -> int:
    """A signed 64-bit hash of a set of hashes."""
    return (int(np.bitwise_xor.reduce(mix(h ^ np.uint64(len(h))))) if len(h) else 0) - (1 << 63)


def _packer(bits: int, size: int, hot: np.ndarray):
    """Batches of documents -> for each bucket the set ids, how many hashes of each, and the hashes. Hot hashes
    go with their sets, spread by set id, instead of to their bucket; with one bucket go (doc_id, known, set
    id, size, row key) of all rows."""

    def blobs(values: np.ndarray, place: np.ndarray, buckets: np.ndarray) -> pa.Array:
        """One binary for each bucket, of the values (rows of bytes, sorted by place) of that bucket."""
        width = values.itemsize * (values.shape[1] if values.ndim > 1 else 1)
        bounds = np.append(np.searchsorted(place, buckets), np.searchsorted(place, buckets[-1:], side="right"))
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(buckets), [None, pa.py_buffer((bounds * width).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())

    def runs(bucket: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, set id, number) of the runs of one set in one bucket."""
        new = np.ones(len(owner), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        return bucket[at], ids[owner[at]], np.diff(np.append(at, len(owner))).astype(np.uint32)

    def flush(docs: list[tuple], sets: dict[int, np.ndarray], turn: int) -> pa.RecordBatch:
        ids = np.array(list(sets), np.int64)
        hashes = np.concatenate(list(sets.values())) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(ids)), [len(h) for h in sets.values()]) if sets else np.empty(0, np.int64)
        warm = np.zeros(len(hashes), bool)
        if len(hot) and len(hashes):
            warm = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
        hot_hashes, hot_owner = hashes[warm], owner[warm]
        hashes, owner = hashes[~warm], owner[~warm]
        bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, owner, low = bucket[order], owner[order], (hashes[order] >> np.uint64(24 - bits)) & _LOW
        records = low.view(np.uint8).reshape(-1, 8)[:, :5]
        spread = ids[hot_owner] & ((1 << bits) - 1)
        order = np.argsort(spread, kind="stable")
        spread, hot_hashes, hot_owner = spread[order], hot_hashes[order], hot_owner[order]
        mine = turn % (1 << bits)
        buckets = np.unique(np.concatenate([bucket, spread, [mine]]))
        meta = np.array([np.array(docs, np.int64).tobytes() if k == mine else None for k in buckets.tolist()], object)
        columns = [pa.array(buckets.astype(np.int32)), pa.array(meta, pa.binary())]
        for place, who, data in ((bucket, owner, records), (spread, hot_owner, hot_hashes)):
            of, names, count = runs(place, who, ids)
            columns += [blobs(names, of, buckets), blobs(count, of, buckets), blobs(data, place, buckets)]
        return pa.RecordBatch.from_arrays(columns, schema=_PACKED)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sets, held, turn = [], {}, 0, 0
        for batch in batches:
            ids, rows = batch["doc_id"].to_pylist(), batch["row"].to_pylist()
            for a, _, data, bounds in text_parts(batch["text"]):
                words, first = word_hashes(data, bounds)
                for k, h in enumerate(shingle_sets(words, first, size), a):
                    turn = turn or int(h[0] if len(h) else 0)
                    key = _set_id(h)
                    docs.append((ids[k] or 0, ids[k] is not None, key, len(h), rows[k]))
                    if len(h) and key not in sets:
                        sets[key] = h
                        held += len(h)
                    if held > 2_000_000 or len(docs) > 20_000:
                        yield flush(docs, sets, turn)
                        docs, sets, held, turn = [], {}, 0, turn + 1
        if docs:
            yield flush(docs, sets, turn)

    return pack


def hot_hashes(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes, ascending, that so many documents share that their bucket would be much larger than others: those
    in HOT_COUNT or more of about HOT_SAMPLE documents, taken by a hash of the text; of them the HOT_MOST in
    most documents. What is missed only makes a bucket larger."""
    n = docs.count()
    some = docs.select(F.col("text").cast("string")).where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // HOT_SAMPLE))) == 0)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in text_parts(batch["text"]):
                words, first = word_hashes(data, bounds)
                h, count = np.unique(np.concatenate(list(shingle_sets(words, first, size))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "n"])

    often = some.dropDuplicates().mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_COUNT)
    return np.sort(np.array([r["h"] for r in often.orderBy(F.desc("n"), "h").limit(HOT_MOST).select("h").collect()], np.int64).view(np.uint64))


_REDUCED = "is_doc boolean, doc_id long, row long, set long, n long, hits binary, ranks binary"


def _once(ids: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without the copies of a set that other batches sent."""
    _, first = np.unique(ids, return_index=True)
    keep = np.zeros(len(ids), bool)
    keep[first] = True
    return ids[keep], counts[keep], hashes[np.repeat(keep, counts)]


def _shared_hashes(pdf: pd.DataFrame, bits: int) -> pd.DataFrame:
    """One bucket: the rows of its documents, and for each set the hashes that another set has too, with log2 of how many have them."""
    bucket = int(pdf["bucket"].iloc[0])
    out = []
    meta = [np.frombuffer(m, np.int64).reshape(-1, 5) for m in pdf["meta"] if m]
    if meta:
        m = np.concatenate(meta)
        out.append(pd.DataFrame({"is_doc": True, "doc_id": pd.array(m[:, 0], "Int64").copy(), "row": m[:, 4], "set": m[:, 2], "n": m[:, 3], "hits": None, "ranks": None}))
        out[-1].loc[m[:, 1] == 0, "doc_id"] = pd.NA
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["sets"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)
    low = np.zeros((int(counts.sum()), 8), np.uint8)
    low[:, :5] = np.frombuffer(b"".join(pdf["low"]), np.uint8).reshape(-1, 5)
    ids, counts, low = _once(ids, counts, low.reshape(-1).view(np.uint64))
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
    order = np.argsort(low, kind="stable")
    low, owner = low[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.empty(0, np.int64)
    many = np.diff(np.append(new, len(low)))
    shared = np.repeat(many, many) > 1
    low, owner, many = low[shared], owner[shared], np.repeat(many, many)[shared]
    order = np.argsort(owner, kind="stable")
    low, owner, many = low[order] | np.uint64(bucket << 40), owner[order], np.log2(many[order]).astype(np.uint8)
    who, start = np.unique(owner, return_index=True)
    stop = np.append(start[1:], len(owner))
    if len(who):
        out.append(pd.DataFrame({"is_doc": False, "doc_id": pd.array([pd.NA] * len(who), "Int64"), "row": 0, "set": ids[who], "n": 0, "hits": [low[a:b].tobytes() for a, b in zip(start, stop)], "ranks": [many[a:b].tobytes() for a, b in zip(start, stop)]}))
    ids, counts = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["hot_sets"]]), np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["hot_counts"]]).astype(np.int64)
    ids, counts, hot = _once(ids, counts, np.frombuffer(b"".join(pdf["hot"]), np.uint64))
    if len(ids):
        stop = np.cumsum(counts)
        full = ((hot >> np.uint64(24 - bits)) & _LOW) | (hot >> np.uint64(64 - bits)) << np.uint64(40)  # as in the buckets
        out.append(pd.DataFrame({"is_doc": False, "doc_id": pd.array([pd.NA] * len(ids), "Int64"), "row": 0, "set": ids, "n": 0, "hits": [full[a:b].tobytes() for a, b in zip(stop - counts, stop)], "ranks": [bytes([HOT_RANK]) * n for n in counts.tolist()]}))
    return pd.concat(out) if out else pd.DataFrame({"is_doc": [], "doc_id": [], "row": [], "set": [], "n": [], "hits": [], "ranks": []})


def _prefixes(percent: int):
    schema = pa.schema([("key", pa.int64()), ("set", pa.int64()), ("k", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sets, sizes = [], [], []
            for s, n, hits, ranks in zip(batch["set"].to_pylist(), batch["n"].to_pylist(), batch["hits"].to_pylist(), batch["ranks"].to_pylist()):
                hits, ranks = np.frombuffer(b"".join(hits), np.int64), np.frombuffer(b"".join(ranks), np.uint8)
                most = n - -(-percent * n // 100) + 1 - (n - len(hits))  # hashes of one set alone come first
                if most > 0:
                    first = hits[np.lexsort((hits, ranks))[:most]]
                    keys.append(first)
                    sets.append(np.full(len(first), s))
                    sizes.append(np.full(len(first), len(hits), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sets)), pa.array(np.concatenate(sizes))], schema=schema)

    return rows


class Index:
    """Inverted index of the sets of one block: for each hash the ascending numbers of the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        keys = np.concatenate(sets)
        order = np.argsort(keys, kind="stable")
        self.n = len(sets)
        self.who = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
        self.keys, self.start, size = np.unique(keys[order], return_index=True, return_counts=True)
        self.size = size
        self.placed = np.repeat(np.arange(len(self.keys)) * self.n, size) + self.who  # list and number as one ascending key


def divide_skip(index: Index, query: np.ndarray, least: int, mu: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, overlaps) of the indexed sets that have at least least of query's hashes.

    The longest lists, as many as DivideSkip's rule gives, are set apart. The others, which are sorted, are
    merged, and only sets in enough of them are looked up in the long lists, by binary search.
    """
    at = np.minimum(np.searchsorted(index.keys, query), len(index.keys) - 1)
    at = at[index.keys[at] == query]
    if len(at) < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = at[np.argsort(index.size[at], kind="stable")]
    size = index.size[at]
    apart = min(least - 1, int(least / (mu * log2(max(2, int(size[-1]))) + 1)))
    short, long, size = at[: len(at) - apart], at[len(at) - apart :], size[: len(at) - apart]
    first = np.cumsum(size) - size
    merged = np.sort(index.who[np.arange(int(size.sum())) + np.repeat(index.start[short] - first, size)], kind="stable")  # a merge of sorted runs
    new = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
    count = np.diff(np.append(new, len(merged)))
    enough = count >= least - apart
    found, overlap = merged[new[enough]], count[enough]
    if len(found) and apart:
        probe = (long[:, None] * index.n + found).ravel()
        hit = index.placed[np.minimum(np.searchsorted(index.placed, probe), len(index.placed) - 1)] == probe
        overlap = overlap + hit.reshape(apart, -1).sum(0)
    good = overlap >= least
    return found[good], overlap[good]


def links_within(names: np.ndarray, labels: np.ndarray, components_: np.ndarray, n: np.ndarray, sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect components of one block. Sets of equal labels were compared before; so the most
    common label's sets are only searched, and the others search."""
    _, label = np.unique(labels, return_inverse=True)
    if label.max() == 0:
        return
    _, c = np.unique(components_, return_inverse=True)
    usual = np.bincount(label).argmax()
    index = None
    for x in np.flatnonzero(label != usual).tolist():
        other = (c != c[x]) & (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if not other.any():
            continue
        index = index or Index(sets)
        found, overlap = divide_skip(index, sets[x], -(-percent * int(n[x]) // 100))
        for y in found[other[found] & (100 * overlap >= percent * (n[x] + n[found] - overlap))].tolist():
            if c[y] != c[x]:
                yield int(names[x]), int(names[y])
                c[c == c[y]] = c[x]


def _linker(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        names, labels, comps, n = (np.array(x, np.int64) for x in list(zip(*rows))[:4])
        return list(links_within(names, labels, comps, n, [r[4] for r in rows], percent))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            columns = [batch[c].to_pylist() for c in ("g1", "g2", "g3", "set", "label", "component", "n", "hits")]
            for g1, g2, g3, name, label, component, n, hits in zip(*columns):
                if (g1, g2, g3) != now:
                    out += links(held) if len(held) > 1 else []
                    now, held = (g1, g2, g3), []
                held.append((name, label, component, n, np.sort(np.frombuffer(b"".join(hits), np.int64))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
        out = links(held) if len(held) > 1 else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return rows


def _links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members: (g1, g2, g3, set, label, component) -> links (a, b) within each (g1, g2, g3)."""
    full = members.join(sets.select("set", "n", "hits"), "set")
    return full.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3").mapInArrow(_linker(percent), "a long, b long")


def _linked(docs: DataFrame, percent: int, size: int) -> tuple[DataFrame, DataFrame]:
    """docs: (doc_id, text, row) -> (doc_id, row, set, n) of every row, and (node, root) of the sets that are linked."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(LEAST_BUCKETS.bit_length() - 1, ceil(log2(max(1, chars / BUCKET_CHARS))))
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), "row").mapInArrow(_packer(bits, size, hot_hashes(docs, size)), "bucket int, meta binary, sets binary, counts binary, low binary, hot_sets binary, hot_counts binary, hot binary")
    reduced = written(packed.groupBy("bucket").applyInPandas(lambda pdf: _shared_hashes(pdf, bits), _REDUCED), "hashes")

    rows = reduced.where("is_doc").select("doc_id", "row", "set", "n")
    known = rows.where("n > 0").groupBy("set").agg(F.max("n").alias("n"))
    hits = reduced.where("NOT is_doc").groupBy("set").agg(F.collect_list("hits").alias("hits"), F.collect_list("ranks").alias("ranks"))
    shared = F.aggregate("ranks", F.lit(0), lambda acc, h: acc + F.octet_length(h))
    sets = written(hits.where(shared > 0).join(known, "set").where(100 * shared >= percent * F.col("n")), "sets")

    entries = written(sets.mapInArrow(_prefixes(percent), "key long, set long, k int"), "prefixes")
    groups = entries.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("set")).alias("who"), F.min("set").alias("pivot"), F.sum("k").alias("weight")).where("c > 1")
    groups = groups.groupBy("c", "who", "pivot").agg(F.min("key").alias("key"), F.max("weight").alias("weight"))
    # Twice as many blocks as full ones would take, so that none is much too full.
    groups = groups.withColumn("blocks", F.when(F.col("weight") <= BLOCK, 1).otherwise(F.ceil(F.col("weight") * 2 / BLOCK)).cast("int"))
    groups = written(groups, "groups")
    members = written(entries.join(groups, "key").select("key", "set", "c", "blocks", "pivot", "k"), "members")

    # Each set in its largest group, in blocks that share a pivot: near copies are connected from here on.
    zero = F.lit(0).cast("long")
    own = members.groupBy("set").agg(F.max(F.struct("c", "key", "blocks")).alias("g")).select("set", "g.*")
    own = own.withColumn("block", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("long")).withColumn("label", F.xxhash64("key", "block"))
    own = written(own, "first")
    first = own.select(F.col("key").alias("g1"), F.col("block").alias("g2"), zero.alias("g3"), "set")
    pivots = groups.where("blocks > 1").select(F.col("key").alias("g1"), F.explode(F.sequence(zero, F.col("blocks").cast("long") - 1)).alias("g2"), zero.alias("g3"), F.col("pivot").alias("set"))
    first = first.unionByName(pivots).distinct().withColumn("component", F.col("set")).withColumn("label", F.col("set"))
    links = written(_links(first, sets, percent), "found")
    roots = written(components(links), "roots")

    # Every group that still holds different components, and sets that were not compared yet.
    m = members.join(own.select("set", "label"), "set").join(roots.withColumnRenamed("node", "set"), "set", "left")
    m = m.select("key", "set", "blocks", "k", "label", F.coalesce("root", "set").alias("component"))
    open_ = m.groupBy("key").agg(*[f(x).alias(f"{name}_{x}") for name, f in (("a", F.min), ("b", F.max)) for x in ("component", "label")])
    m = written(m.join(open_.where("a_component < b_component AND a_label < b_label").select("key"), "key"), "open")
    if not m.isEmpty():
        rest = m.where("blocks = 1").select(F.col("key").alias("g1"), zero.alias("g2"), zero.alias("g3"), "set", "label", "component")
        rest = rest.unionByName(_across(m.where("blocks > 1").select("key", "set", "k", "label", "component")))
        links = links.unionByName(written(_links(rest, sets, percent), "found"))
        roots = written(components(links), "roots")
    return rows, roots


def similar_documents(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs; sets link at a Jaccard similarity of percent / 100 or more."""
    rows, roots = _linked(docs.select("doc_id", "text", F.lit(0).cast("long").alias("row")), percent, size)
    known = rows.where("n > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    of_root = roots.join(known, roots["node"] == known["set"]).groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(of_root, "root").select(F.col("node").alias("set"), "component_id")
    of_set = known.join(linked, "set", "left").select("set", F.coalesce("component_id", "least").alias("component_id"))
    full = rows.where("n > 0").join(of_set, "set").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _across(m: DataFrame) -> DataFrame:
    """Members (key, set, k, label, component) of large groups, dealt to pairs of blocks that hold different
    components. A component of much weight has blocks of its own; small ones share blocks."""
    sizes = m.groupBy("key", "component").agg(F.sum("k").alias("weight"))
    half = BLOCK / 2
    small = sizes.where(F.col("weight") <= half)
    bins = small.groupBy("key").agg(F.ceil(F.sum("weight") * 2 / half).cast("long").alias("bins"))
    place = sizes.join(bins, "key", "left").withColumn("is_small", F.col("weight") <= half)
    block = F.when(F.col("is_small"), F.pmod(F.xxhash64("component"), F.col("bins"))).otherwise(F.pmod(F.xxhash64("set"), F.ceil(F.col("weight") * 2 / half).cast("long")))
    alone = F.when(~F.col("is_small"), F.col("component"))
    m = written(m.join(place, ["key", "component"]).withColumn("block", F.xxhash64(alone, block)).select("key", "set", "label", "component", "block", alone.alias("alone")), "blocks")
    blocks = m.select("key", "block", "alone").distinct()
    left, right = blocks.toDF("g1", "g2", "alone2"), blocks.toDF("g1", "g3", "alone3")
    # Blocks of one group, not its members.
    pairs = written(left.join(right, "g1").where("g2 <= g3 AND NOT (alone2 <=> alone3 AND alone2 IS NOT NULL)").select("g1", "g2", "g3"), "pairs")
    sides = [m.join(pairs, (m["key"] == pairs["g1"]) & (m["block"] == pairs[g])).select("g1", "g2", "g3", "set", "label", "component") for g in ("g2", "g3")]
    return sides[0].unionByName(sides[1]).distinct()


def one_of_each(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs that stand for their component: of each the one of least doc_id, nulls last.

    A row goes only if its text is linked to or has the same set as that of the row that stays, or if it
    equals that row in all columns. Ties of one doc_id are broken by the ids of the sets, then by a hash of
    the row. Null doc_ids don't make rows alike, nor does one doc_id on different texts; rows without
    words are linked with nothing, so they stay. Rows are equal by a sha-256 of all their columns, maps included.
    """
    key, full = "row", "whole_row"
    while {key, full} & {c.lower() for c in docs.columns}:
        key, full = key + "_", full + "_"
    keyed = docs.withColumn(full, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).cast("binary"), 256)).withColumn(key, F.xxhash64(full))
    rows, roots = _linked(keyed.select("doc_id", "text", F.col(key).alias("row")), percent, size)
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "set", "row")
    of_set = rows.where("n > 0").groupBy("set").agg(F.min(order).alias("best"))
    of_root = of_set.join(roots.withColumnRenamed("node", "set"), "set", "left").groupBy(F.coalesce("root", "set").alias("root")).agg(F.min("best").alias("best"))
    stay = of_root.select(F.col("best.row").alias(key)).unionByName(rows.where("n = 0").select(F.col("row").alias(key)))
    # Two rows of one 64-bit key by chance both stay; only rows equal in all columns are one.
    return keyed.join(stay, key, "left_semi").dropDuplicates([full]).select(*[f"`{c}`" for c in docs.columns])
