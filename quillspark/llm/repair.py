"""Token-id output in a binary format with Re-Pair grammar compression.

Documents are range-partitioned and sorted by doc_id (rows of one id by their texts); each partition is a shard, written as blocks of
some millions of ids. In a block, Re-Pair replaces the most frequent pairs of neighbours by new symbols
until no pair is left that pays (none across an end id). A block stores its rules, the length each rule
expands to, the shortened sequence, and where each document begins in it, so one document, or any range
of ids, is decoded without the rest.

The files are Parquet in the shared folder, one row per block, with columns
  shard, block           place in the order of documents
  n_before               ids of the shard's earlier blocks
  doc_ids, known         little-endian int64 (0 where null), one byte each
  n_ids                  little-endian uint32: ids of each document, with the end id
  begins                 little-endian uint32: first symbol of each document, and the end
  rules                  little-endian uint32 pairs (left, right) of symbols FIRST_RULE, FIRST_RULE + 1, ...
  lengths                little-endian uint32: ids that each rule expands to
  symbols                little-endian uint16 (or uint32 if wide), the sequence
so executors can be lost at any time, and nothing depends on a local file.

Encoding is that of the tokenizers library. Pre-tokenization never joins across ASCII white space, so
a text's ids are those of its space-separated parts one after another; parts are encoded once a worker.

Defined cases: null or empty text: just the end id. Null doc_id sorts first. Repeated rows are stored
each, in the order of their text. A very long text is one document of one block. An empty table gives no
file rows and an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.coded import ids_of, pieces_of
from quillspark.llm.shared import written

END = 1
BLOCK_IDS = 2_000_000
#: A rule takes 12 bytes (two symbols and a length) and each place where it is used saves a symbol of 2: from 7 places on it pays.
LEAST_COUNT = 7
SHARD_BYTES, MOST_SHARDS = 64_000_000, 2_000_000
MOST_WORDS = 1_200_000
MOST_TAILS = 100_000

_APART = "`"
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
_WORD = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:-@[-`{-~]*)")
# What could be a special token, or a combining mark.
_ALONE = "<\\||[\u0300-\u037f]"


class WordEncoder:
    """Ids of texts as little-endian uint32, by way of the parts between ASCII white space.

    For a tokenizer that lower-cases, ASCII letters are put in lower case first, so that more parts are
    alike. Left alone are texts with what could be a special token, or with combining marks, whose
    composition depends on case. The distinct parts of a batch are looked up and the texts' ids gathered
    from theirs. A new part of lower-case letters that the tokenizer's own normalizer and pre-tokenizer
    keep as one goes to its model at once, and so does such a part before punctuation split off from it.
    """

    def __init__(self, tokenizer: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(tokenizer)
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes | None] = {}
        self.alike = self.ids("Ab, CD.\nEf.") == self.ids("ab, cd.\nef.")
        apart = self.ids(_APART)
        self.apart = apart[0] if len(apart) == 1 and self.ids(f"a {_APART} b") == [*self.ids("a"), *apart, *self.ids("b")] else None
        self.letters = {ord(c): "".join(self.pieces(c)) for c in _LETTERS}
        if self.pieces(_LETTERS) != [_LETTERS.translate(self.letters)] or any(self.ids(w) != self.model_ids(w) for w in (_LETTERS, *_LETTERS)):
            self.letters = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, text: str) -> list[str]:
        """What the tokenizer's model gets of a text."""
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(text) if normalizer else text
        return [p for p, _ in cutter.pre_tokenize_str(text)] if cutter else [text]

    def model_ids(self, letters: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(letters.translate(self.letters))]

    def tail(self, tail: str) -> bytes | None:
        """Ids of punctuation that is split off from letters before it; None if it isn't."""
        if tail not in self.tails:
            if len(self.tails) > MOST_TAILS:
                self.tails.clear()
            apart = self.pieces("ab" + tail) == [*self.pieces("ab"), *self.pieces(tail)] and self.ids("ab" + tail) == self.ids("ab") + self.ids(tail)
            self.tails[tail] = array("I", self.ids(tail)).tobytes() if apart else None
        return self.tails[tail]

    def learn(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of new parts: the model's for letters, else many in one text, apart from each other by a part that none contains."""
        rest = []
        for w in words:
            cut = _WORD.fullmatch(w) if self.letters else None
            tail = self.tail(cut[2]) if cut and cut[2] else b""
            if cut is None or tail is None:
                rest.append(w)
                continue
            ids = self.known.get(cut[1])
            yield w, (array("I", self.model_ids(cut[1])).tobytes() if ids is None else ids) + tail
        alone = rest if self.apart is None else [w for w in rest if _APART in w]
        for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            yield w, array("I", e.ids).tobytes()
        if self.apart is not None:
            many = [w for w in rest if _APART not in w]
            groups = [many[k : k + 256] for k in range(0, len(many), 256)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([f" {_APART} ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == self.apart) * 4
                data = ids.tobytes()
                yield from zip(group, [data[x:y] for x, y in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(data)])])

    def encode(self, texts: pa.Array) -> list[bytes]:
        texts = pc.fill_null(texts, "")
        if self.alike:
            texts = pc.if_else(pc.match_substring_regex(texts, _ALONE), texts, pc.ascii_lower(texts))
        return ids_of(pc.ascii_split_whitespace(texts), self.lookup)

    def lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct parts; the new ones are learned."""
        found = list(map(self.known.get, words))
        new = dict(self.learn([w for w, ids in zip(words, found) if ids is None]))
        found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
        if len(self.known) + len(new) > MOST_WORDS:
            self.known = dict(zip(words, found))
        else:
            self.known |= new
        return found


@lru_cache(2)
def _encoder(tokenizer: bytes) -> WordEncoder:
    return WordEncoder(tokenizer)


def compress(ids: np.ndarray, first_rule: int, fixed: int = END, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): Re-Pair of ids; fixed is in no pair. Rule k is symbol first_rule + k.

    In a round all pairs that occur at least a quarter as often as the most frequent one are replaced, the
    more frequent first where they overlap; the most frequent is replaced wherever it stands. It ends
    when no pair occurs least times without overlap. Counts are exact: the slots of a hash table bound
    them from above, and pairs in full enough slots are counted one by one. Once all pairs of least
    places have had their round, what is new are pairs of the last round's symbols, so only these are
    counted, until there are none; then all are counted once more.
    """
    symbols, rules = ids.astype(np.uint32), np.empty(0, np.uint64)
    bound, since = None, None  # least count of the last round; first symbol of it, where only new ones are looked at
    while len(symbols) > 1:
        if since is not None:
            new = symbols >= since
            end = symbols == fixed
            at = np.flatnonzero((new[:-1] | new[1:]) & ~(end[:-1] | end[1:]))
            pairs, which, at, count = _places(symbols, at)
            if count.max(initial=0) < least:
                since = None
                continue
        else:
            slot = (symbols[:-1] * np.uint32(0x9E3779B1) + symbols[1:] * np.uint32(0x85EBCA6B) >> np.uint32(12)).astype(np.int32)
            end = symbols == fixed
            slot[end[:-1] | end[1:]] = 1 << 20
            slots = np.bincount(slot, minlength=(1 << 20) + 1)
            slots[1 << 20] = 0
            most = int(slots.max())
            if most < least:
                break
            bound = max(least, min(most, bound or most) // 4)
            while True:
                pairs, which, at, count = _places(symbols, np.flatnonzero((slots >= bound)[slot]))
                if bound == least or count.max(initial=0) >= bound:
                    break
                bound = max(least, bound // 4)
        often = count >= bound
        if not often.any():
            break
        # The more frequent of overlapping pairs goes first: places whose pair ranks above both neighbours'.
        rank = np.full(len(pairs), -1)
        order = np.flatnonzero(often)[np.lexsort((pairs[often], count[often]))]
        rank[order] = np.arange(len(order))
        at, which = at[often[which]], which[often[which]]
        place = np.full(len(symbols) + 2, -1, np.int32)
        place[at + 1] = rank[which]
        mine = place[at + 1]
        take = (mine > place[at]) & (mine > place[at + 2])
        at, which = at[take], which[take]
        # Pairs that have a rule from an earlier round keep it; new rules need enough places.
        taken = np.bincount(which, minlength=len(pairs))
        symbol = np.full(len(pairs), -1)
        if len(rules):
            sorter = np.argsort(rules, kind="stable")
            k = sorter[np.minimum(np.searchsorted(rules, pairs, sorter=sorter), len(rules) - 1)]
            symbol = np.where(rules[k] == pairs, first_rule + k, -1)
        if bound == least:
            since = np.uint32(first_rule + len(rules))
        fresh = np.flatnonzero((taken >= least) & (symbol < 0))
        symbol[fresh] = first_rule + len(rules) + np.arange(len(fresh))
        rules = np.append(rules, pairs[fresh])
        has = symbol[which] >= 0
        at, which = at[has], which[has]
        symbols[at] = symbol[which]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
    return symbols.astype(np.int64), np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], 1).astype(np.int64)


def _places(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs at the given places; of the places those that count, which pair each is, and how many of each.
    Of a run of one pair over itself (aaaa) every second place counts."""
    pairs, which = np.unique(symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1], return_inverse=True)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (which[1:] != which[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    apart = (np.arange(len(at)) - start) % 2 == 0
    return pairs, which[apart], at[apart], np.bincount(which[apart], minlength=len(pairs))


def lengths_of(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """How many ids each rule expands to."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append(sum(1 if x < first_rule else out[x - first_rule] for x in (a, b)))
    return np.array(out, np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int) -> np.ndarray:
    """The ids of a sequence of symbols: rules are written out once each, one after another, at places their lengths give."""
    ends = first_rule + np.cumsum(lengths)
    flat = np.empty(int(ends[-1]) if len(ends) else first_rule, "<u4")
    flat[:first_rule] = np.arange(first_rule)
    begin = np.concatenate([np.arange(first_rule), ends - lengths]).astype(np.int64)
    size = np.concatenate([np.ones(first_rule, np.int64), lengths])
    starts, sizes = begin.tolist(), size.tolist()
    for k, (a, b) in enumerate(rules.tolist(), first_rule):
        at, n, m = starts[k], sizes[a], sizes[b]
        flat[at : at + n] = flat[starts[a] : starts[a] + n]
        flat[at + n : at + n + m] = flat[starts[b] : starts[b] + m]
    begin, size = begin[symbols], size[symbols]
    end = np.cumsum(size)
    return flat[np.repeat(begin - (end - size), size) + np.arange(int(size.sum()))]


def expand_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_rule: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of what symbols expand to. Whatever lies outside is passed over by its length;
    only rules that reach into the range are opened, and of them only the parts that do."""
    size = np.ones(len(symbols), np.int64)
    size[symbols >= first_rule] = lengths[symbols[symbols >= first_rule] - first_rule]
    reached = np.cumsum(size)
    a = int(np.searchsorted(reached, start, side="right"))
    skip = start - (int(reached[a - 1]) if a else 0)
    left, out, work = stop - start, [], symbols[a : int(np.searchsorted(reached, stop)) + 1].tolist()[::-1]
    while left > 0 and work:
        x = work.pop()
        n = 1 if x < first_rule else int(lengths[x - first_rule])
        if skip >= n:
            skip -= n
        elif x < first_rule:
            out.append(x)
            left -= 1
        else:
            work += rules[x - first_rule].tolist()[::-1]
    return np.array(out, "<u4")


_FILE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_before", pa.int64()), ("doc_ids", pa.binary()), ("known", pa.binary()), ("n_ids", pa.binary()), ("begins", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary()), ("wide", pa.bool_()), ("first_rule", pa.int32())])
_FILE_DDL = "shard int, block int, n_before long, doc_ids binary, known binary, n_ids binary, begins binary, rules binary, lengths binary, symbols binary, wide boolean, first_rule int"


def _block(shard: int, block: int, before: int, docs: list[tuple[int | None, bytes]], first_rule: int, least: int) -> tuple:
    end = np.array([END], "<u4").tobytes()
    ids = np.frombuffer(b"".join(c + end for _, c in docs), "<u4")
    counts = np.array([len(c) // 4 + 1 for _, c in docs], "<u4")
    symbols, rules = compress(ids, first_rule, least=least)
    lengths = lengths_of(rules, first_rule)
    size = np.ones(len(symbols), np.int64)
    nonterminal = symbols >= first_rule
    size[nonterminal] = lengths[symbols[nonterminal] - first_rule]
    reached = np.concatenate([[0], np.cumsum(size)])
    begins = np.searchsorted(reached, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]))
    wide = bool(len(symbols) and symbols.max() >= 1 << 16)
    return (
        shard, block, before, np.array([d or 0 for d, _ in docs], "<i8").tobytes(), np.array([d is not None for d, _ in docs], np.uint8).tobytes(), counts.tobytes(), begins.astype("<u4").tobytes(),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), symbols.astype("<u4" if wide else "<u2").tobytes(), wide, first_rule,
    )


def write_ids(docs: DataFrame, tokenizer: bytes, shards: int | None = None, least: int = LEAST_COUNT) -> DataFrame:
    """Encode docs (doc_id, text), write the files, and return them as read again. With least = 2 Re-Pair goes
    on until no pair occurs twice, also where rules take more than they save."""
    spark = docs.sparkSession
    if shards is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # the optimizer's estimate
        shards = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES)), MOST_SHARDS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, block, before, held, n = _encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, [], 0
        first_rule = encoder.tokenizer.get_vocab_size(with_added_tokens=True)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(_block(shard, block, before, held, first_rule, least), _FILE)], schema=_FILE)

        for batch in batches:
            doc_ids = iter(batch["doc_id"].to_pylist())
            for texts in pieces_of(batch["text"]):
                for coded, d in zip(encoder.encode(texts), doc_ids):
                    held.append((d, coded))
                    n += len(coded) // 4 + 1
                    if n >= BLOCK_IDS:
                        yield out()
                        before, block, held, n = before + n, block + 1, [], 0
        if held:
            yield out()

    placed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Rows of one id or of none are ranged by the beginnings of their texts too, and equal ones by where they were read.
    named = placed.withColumn("begins", F.substring("text", 1, 256)).withColumn("read", F.monotonically_increasing_id())
    placed = named.repartitionByRange(shards, "doc_id", "begins", "read").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    return written(placed.mapInArrow(rows, _FILE_DDL), "ids")


def starts_of_shards(files: DataFrame) -> DataFrame:
    """(shard, shard_start): ids of all earlier shards. One small row for each shard."""
    last = files.groupBy("shard").agg(F.max_by(F.struct("n_before", "n_ids"), "block").alias("x"))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [x["n_before"] + int(np.frombuffer(x["n_ids"], "<u4").sum(dtype=np.int64)) for x in b["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["shard"], pa.array(n, pa.int64())], names=["shard", "n"])

    totals = last.mapInArrow(total, "shard int, n long")
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.select("shard", before.alias("shard_start"))


def read_block(row: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the shard, its ids) of each document of a file row."""
    ids = expand(*_grammar(row))
    counts = np.frombuffer(row["n_ids"], "<u4").astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for d, known, a, b in zip(np.frombuffer(row["doc_ids"], "<i8").tolist(), row["known"], bounds.tolist(), bounds[1:].tolist()):
        yield (d if known else None), row["n_before"] + a, ids[a:b]


def read_document(row: dict, k: int) -> np.ndarray:
    """Ids of the k-th document of a file row, without decoding the others."""
    symbols, rules, lengths, first_rule = _grammar(row)
    begins = np.frombuffer(row["begins"], "<u4")
    return expand_range(symbols[begins[k] : begins[k + 1]], rules, lengths, first_rule, 0, int(np.frombuffer(row["n_ids"], "<u4")[k]))


def read_range(row: dict, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a file row, found by the stored lengths."""
    return expand_range(*_grammar(row), start, stop)


def _grammar(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    symbols = np.frombuffer(row["symbols"], "<u4" if row["wide"] else "<u2")
    return symbols, np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64), np.frombuffer(row["lengths"], "<u4").astype(np.int64), row["first_rule"]


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, and stored_symbols: what its ids took."""
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("stored_symbols", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                stored = np.diff(np.frombuffer(row["begins"], "<u4").astype(np.int64)).tolist()
                out = [(row["shard"], d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), s) for (d, at, ids), s in zip(read_block(row), stored)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    read = files.mapInArrow(rows, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long, stored_symbols long")
    full = read.join(F.broadcast(starts_of_shards(files)), "shard")  # as many rows as shards
    return full.select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "stored_symbols")
