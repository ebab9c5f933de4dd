"""Merkle manifest of a dataset: a mountain range of peaks for each indexed range, merged where the ranges meet.

Leaves are hashes of rows. Within a group they are numbered in order without gathering the group: rows are dealt by
ranges of (group, order, hash), each range counts its own, and the counts of earlier ranges are added. Then

1. each range keeps a stack of peaks, as one counts in base FANOUT = 2: when the last two peaks are the two children of
   one node, the carry replaces them by it and a node record is written. The last node of a level that is alone in its
   run becomes its parent without padding. What is left on the stack are the range's peaks, whose siblings are elsewhere;
2. peaks are dealt by the node above them, 8 ranges' worth and then 1,024 times as many a round, and the same stack
   merges them, until each group has its root. A group of any size is spread over as many tasks as it has ranges;
3. the groups' roots, ordered, are the leaves of a tree of their own;
4. proofs come top-down: nodes of ten levels below one node go to one task (2,047 at most), which appends the siblings
   inside to those above.

Only the number of rows and of ranges, and whether peaks are left, comes to the driver.

Defined cases: null is written as `-`; every other value as its UTF-8 byte count, `:` and the value, so null and empty
text differ. Null groups are one group, the first; null order keys come first. Rows of one order key, repeated rows
included, are ordered by their hashes; equal rows are leaves of their own. Very long texts are hashed whole, where they
are read. An empty table gives an empty result. Columns of docs other than those named are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 10  # levels of a proof's step, and of a merge after the first
BROADCAST_RANGES = 200_000  # rows of five numbers: some MB


class Tree(NamedTuple):
    leaves: DataFrame  # g, idx, hash and the columns carried along
    nodes: DataFrame  # g, level (from 1), idx, hash
    roots: DataFrame  # g, n (leaves), hash


def row_hash(*values: Column) -> Column:
    """sha256 of the values, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _depth(n: int) -> int:
    return (n - 1).bit_length()


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of (g, order, hash), with part, the range's number, and pos, the place in it."""
    place = ["g", *order, "hash"]
    dealt = rows.repartitionByRange(*place).sortWithinPartitions(*place)
    return written(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("pos")), "leaves")


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (g, hash, ...) with idx, the number within g by order and hash, and n, the size of g, sorted within partitions."""
    dealt = _dealt(rows, order)
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("c"), F.min("pos").alias("first"))
    group = Window.partitionBy("g")
    before = F.coalesce(F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = written(counts.select(F.col("g").alias("rg"), F.col("part").alias("rp"), (before - F.col("first")).alias("add"), F.sum("c").over(group).alias("n")), "ranges")
    few = ranges.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    out = dealt.join(F.broadcast(ranges) if few else ranges, (F.col("part") == F.col("rp")) & F.col("g").eqNullSafe(F.col("rg")))
    out = out.withColumn("idx", F.col("pos") + F.col("add")).drop("part", "pos", "rg", "rp", "add", *order)
    return out if few else out.repartitionByRange("g", "idx").sortWithinPartitions("g", "idx")


_CLIMBED = pa.schema([("g", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string()), ("n", pa.int64()), ("kind", pa.string())])


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, block, level, idx, hash, n), in order within each g and block: node records, the peaks left, and roots."""
    out: list[tuple] = []
    stack: list[tuple[int, int, str]] = []
    now, n = None, 0

    def push(level: int, idx: int, node: str) -> None:
        stack.append((level, idx, node))
        while len(stack) > 1 and stack[-1][1] & 1 and stack[-2][:2] == (stack[-1][0], stack[-1][1] - 1):
            _, _, right = stack.pop()
            level, idx, left = stack.pop()
            out.append((now[0], level + 1, idx >> 1, node := _h(left, right), n, "node"))
            stack.append((level + 1, idx >> 1, node))

    def close() -> None:
        while stack:
            level, idx, node = stack[-1]
            if level == _depth(n) or idx & 1 or (idx + 1) << level < n:
                break
            stack.pop()  # alone in the last run of its level
            out.append((now[0], level + 1, idx >> 1, node := _h(node), n, "node"))
            push(level + 1, idx >> 1, node)
        out.extend((now[0], level, idx, node, n, "root" if level == _depth(n) else "peak") for level, idx, node in stack)
        stack.clear()

    for batch in batches:
        for g, block, level, idx, node, size in zip(*[batch[c].to_pylist() for c in ("g", "block", "level", "idx", "hash", "n")]):
            if now != (g, block) or block is None and idx != stack[-1][1] + 1 << stack[-1][0]:
                close()
                now, n = (g, block), size
            push(level, idx, node)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CLIMBED.types)], schema=_CLIMBED)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _CLIMBED.types)], schema=_CLIMBED)


def build(rows: DataFrame, order: list[str]) -> Tree:
    """The trees over rows (g, hash, order columns, any more), one for each g."""
    leaves = written(_numbered(rows, order), "numbered")
    climb = "g string, level int, idx long, hash string, n long, kind string"
    step = leaves.select("g", F.lit(None).cast("long").alias("block"), F.lit(0).alias("level"), "idx", "hash", "n").mapInArrow(_climb, climb)
    rounds = [written(step, "nodes")]
    size, ranges = leaves.count(), max(1, rounds[0].where("kind = 'peak'").select("g", "idx").count() // 8)
    top = max(1, size // ranges).bit_length() + 3
    while not (peaks := rounds[-1].where("kind = 'peak'")).isEmpty():
        block = F.expr(f"CASE WHEN level < {top} THEN shiftright(idx, {top} - level) ELSE shiftleft(idx, level - {top}) END")
        placed = peaks.select("g", block.alias("block"), "level", "idx", "hash", "n", F.expr("shiftleft(idx, level)").alias("at"))
        rounds.append(written(placed.repartition("g", "block").sortWithinPartitions("g", "block", "at").mapInArrow(_climb, climb), "nodes"))
        top += BITS
    full = rounds[0]
    for r in rounds[1:]:
        full = full.unionByName(r)
    return Tree(leaves.drop("n"), full.where("kind = 'node'").select("g", "level", "idx", "hash"), full.where("kind = 'root'").select("g", "n", "hash"))


def _walk(last: bool, bottom: int):
    """Rows of one step's blocks -> (g, idx, path, n, subroot, root) of its lowest nodes, or (last) leaves' columns, proof and folded root.

    A path has a token for each level: L or R and the sibling's hash, by the sibling's side, or S where there is none.
    """
    fields = _PROVED if last else _PATHS

    def block_rows(rows: list[tuple]) -> Iterator[tuple]:
        known = {(level, idx): node for level, idx, node, *_ in rows if level >= 0}
        upper = next((r[4:8] for r in rows if r[0] < 0), None)
        if upper is None:  # the root of a smaller group, met by the step above it
            return
        above, n, subroot, root = upper
        levels = range(bottom, min(bottom + BITS, _depth(n)))
        for level, idx, node, extra, *_ in rows:
            if level != bottom:
                continue
            path = []
            for k in levels:
                at = idx >> (k - bottom)
                other = known.get((k, at ^ 1))
                path.append("S" if other is None else f"{'L' if at & 1 else 'R'}{other}")
            path += [above] if above else []
            if last:
                steps = [x for x in ",".join(path).split(",") if x]
                yield (*extra, node, subroot, root, _h(*[x[1:] for x in steps]), fold(extra[1] or node, steps))
            else:
                yield (rows[0][-1], idx, ",".join(path), n, subroot, root)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for g, block, level, idx, node, doc, claimed, path, n, subroot, root in zip(*[c.to_pylist() for c in batch.columns]):
                if now != (g, block):
                    out += block_rows(held) if held else []
                    now, held = (g, block), []
                held.append((level, idx, node, (doc, claimed), path, n, subroot, root, g))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields.types)], schema=fields)
        if held and (out := list(block_rows(held))):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), fields.types)], schema=fields)

    return walk


_PATHS = pa.schema([("g", pa.string()), ("idx", pa.int64()), ("path", pa.string()), ("n", pa.int64()), ("subroot", pa.string()), ("root", pa.string())])
_PROVED = pa.schema([("doc_id", pa.int64()), ("claimed", pa.string()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())])


def fold(leaf: str, steps: list[str]) -> str:
    """The root that a leaf and the tokens of its path give."""
    for x in steps:
        leaf = _h(x[1:], leaf) if x[0] == "L" else _h(leaf, x[1:]) if x[0] == "R" else _h(leaf)
    return leaf


def _paths(tree: Tree, tops: DataFrame, last: bool) -> DataFrame:
    """tops (g, path, n, subroot, root) of each group's root -> the same of each leaf, by steps of BITS levels from the top."""
    depth = F.expr("CASE WHEN n > 1 THEN length(bin(n - 1)) ELSE 0 END")
    tops = tops.withColumn("depth", depth)
    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("hash", "string"), ("doc_id", "long"), ("claimed", "string"), ("path", "string"), ("n", "long"), ("subroot", "string"), ("root", "string"))}
    above = None
    for bottom in range(max(0, (tops.agg(F.max("depth")).first()[0] or 0) - 1) // BITS * BITS, -1, -BITS):
        reached = (F.col("depth") <= bottom + BITS) & ((F.col("depth") > bottom) | F.lit(bottom == 0))
        roots = tops.where(reached).select("g", F.lit(0).cast("long").alias("idx"), "path", "n", "subroot", "root")
        uppers = roots if above is None else above.unionByName(roots)
        upper = uppers.select("g", F.col("idx").alias("block"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), none["hash"], none["doc_id"], none["claimed"], "path", "n", "subroot", "root")
        inside = tree.nodes.where((F.col("level") >= bottom) & (F.col("level") < bottom + BITS))
        if last and bottom == 0:
            inside = inside.select("*", none["doc_id"], none["claimed"]).unionByName(tree.leaves.select("g", F.lit(0).alias("level"), "idx", "hash", "doc_id", "claimed"))
        else:
            inside = (inside if bottom else inside.unionByName(tree.leaves.select("g", F.lit(0).alias("level"), "idx", "hash"))).select("*", none["doc_id"], none["claimed"])
        rows = inside.select("g", F.expr(f"shiftright(idx, {bottom + BITS} - level)").alias("block"), "level", "idx", "hash", "doc_id", "claimed", none["path"], none["n"], none["subroot"], none["root"]).unionByName(upper)
        done = last and bottom == 0
        schema = "doc_id long, claimed string, leaf string, subroot string, root string, proof_sha256 string, folded_root string" if done else "g string, idx long, path string, n long, subroot string, root string"
        above = rows.repartition("g", "block").sortWithinPartitions("g", "block").mapInArrow(_walk(done, bottom), schema)
        above = above if done else written(above, "paths")
    return above


def manifest(rows: DataFrame) -> tuple[Tree, Tree]:
    """The trees of each group of rows (g, o, hash, any more), and the tree over their roots."""
    tree = build(rows, ["o"])
    tops = tree.roots.select(F.lit(None).cast("string").alias("g"), F.col("g").alias("lang"), F.col("g").alias("o"), "hash", F.col("n").alias("size"))
    return tree, build(tops, ["o"])


def prove(rows: DataFrame) -> DataFrame:
    """rows (g, o, hash, doc_id, claimed): doc_id, claimed, leaf, subroot, root, proof_sha256 and folded_root of each.

    proof_sha256 is the hash of the siblings on the way to the root; folded_root is what they and claimed give, or
    the leaf itself where claimed is null.
    """
    tree, over = manifest(rows)
    whole = over.roots.select(F.col("hash").alias("root"), F.col("n").alias("groups"))  # one row
    top = over.leaves.crossJoin(F.broadcast(whole))
    own = _paths(over, over.roots.select("g", F.lit("").alias("path"), "n", F.col("hash").alias("subroot"), F.col("hash").alias("root")), False)
    tops = own.select("idx", "path").join(top, "idx").select(F.col("lang").alias("g"), "path", F.col("size").alias("n"), F.col("hash").alias("subroot"), "root")
    return _paths(tree, written(tops, "tops"), True)


def dataset_proofs(docs: DataFrame, tampered: Column) -> DataFrame:
    """Each row of docs as a leaf of its lang's tree, with its proof; where tampered holds, n_chars + 1 is claimed."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"), F.col("text").cast("string"))
    claimed = F.when(tampered & F.col("n_chars").isNotNull(), row_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]))
    rows = own.select(F.col("lang").alias("g"), F.col("doc_id").alias("o"), row_hash(*[F.col(c) for c in FIELDS]).alias("hash"), "doc_id", claimed.alias("claimed"))
    return prove(rows).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
