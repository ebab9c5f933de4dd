"""SentencePiece encoding and decoding by shared-prefix dynamic programming.

Texts are cut into marked words: a run of the space mark with what follows up to the next mark. No
piece crosses such a cut, so words can be encoded apart. The distinct new words of a batch are sorted,
which walks their trie depth-first: the forward state of each character is kept on a stack and reused
by every word with the same prefix.

Unigram models: the state is the best score of a prefix and its last piece (Viterbi). BPE models have
ranks, no probabilities, and the highest sum isn't what merging yields; there the same forward pass
keeps the one last piece whose pair with the piece before it is stable under merging, which gives
exactly the ids of BPE. The model says which of the two it is.

The vocabulary file is read where the plan is built, by a path that is a parameter, and its bytes go to
the tasks with the function (its size is that of the file, at most MOST_MODEL_BYTES).

Defined cases: null or empty text: no ids, decoded to ''. Repeated rows are encoded each. A literal
mark (U+2581) decodes as a space, as in the SentencePiece library. Very long texts, also of one word, are
encoded whole, in memory proportional to the text. An empty table gives an empty result. An existing column named ids (decode: decoded) is replaced.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.coded import ids_of, pieces_of

MARK = "▁"
MOST_MODEL_BYTES = 64 << 20
#: Words whose ids a worker keeps; when full, those of the last batch stay.
MOST_WORDS = 200_000


class Decoder:
    """The pieces of a model, and texts from ids."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        self.proto = proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.kind = kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("only models with identity normalization and a dummy prefix are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.unknown = next(k for k, p in enumerate(proto.pieces) if p.type == kind.UNKNOWN)
        self.byte = [None] * 256
        self.bytes_of = [p.encode() for p in self.pieces]
        for k, p in enumerate(proto.pieces):
            if p.type == kind.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = k
                self.bytes_of[k] = bytes([int(p.piece[1:-1], 16)])
        self.bytes_of[self.unknown] = " ⁇ ".encode()

        self.bytes_array = pa.array(self.bytes_of, pa.binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each list of ids; bytes that aren't UTF-8 are replaced."""
        bounds = pa.array(np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())]), pa.int32())
        joined = pc.binary_join(pa.ListArray.from_arrays(bounds, self.bytes_array.take(ids.flatten())), b"")
        try:
            text = joined.cast(pa.string())
        except pa.ArrowInvalid:
            text = pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())
        return pc.replace_substring(pc.replace_substring_regex(text, f"^{MARK}", ""), MARK, " ")


class Segmenter(Decoder):
    """Ids from texts."""

    def __init__(self, model: bytes):
        super().__init__(model)
        proto, kind = self.proto, self.kind
        self.ids = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece crosses words")
        self.score = [p.score for p in proto.pieces]
        self.unknown_score = min(self.score[k] for k in self.ids.values()) - 10.0
        self.unigram = proto.trainer_spec.model_type == proto.trainer_spec.UNIGRAM
        self.merging = dict(self.ids)
        self.stable: dict[int, bool] = {}  # of pairs of pieces
        if not self.unigram:  # pieces that merging can't reach never come out
            self.ids = {p: k for p, k in self.ids.items() if self.merged(p) == [p]}
        self.suffix = {p[k:]: -1 for p in self.ids for k in range(len(p))} | self.ids  # all endings of pieces; -1: no piece itself
        self.lone = not any("\n" in p for p in self.merging)
        self.known: dict[str, bytes] = {}

    def merged(self, s: str) -> list[str]:
        """BPE of a short string, merge by merge."""
        parts = list(s)
        while len(parts) > 1:
            found = [(self.score[self.merging[a + b]], -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.merging]
            if not found:
                break
            k = -max(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def is_stable(self, a: int, b: int) -> bool:
        """Does merging the two pieces' text give back just these two?"""
        x, y = self.pieces[a], self.pieces[b]
        out = self.merged(x + y) == [x, y]
        if len(self.stable) > 2_000_000:
            self.stable.clear()
        self.stable[a << 32 | b] = out
        return out

    def spelled(self, c: str) -> list[int]:
        """Ids of an unknown character: its bytes, if the model has them."""
        out = [self.byte[b] for b in c.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in out else out

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each of the sorted words; begin and last (and best) are the forward states along the trie's current path."""
        begin, last, best = [0], [-1], [0.0]  # of a prefix: where its last piece begins, that piece, score
        forward = self.forward_unigram if self.unigram else self.forward_bpe
        before = ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del begin[shared + 1 :], last[shared + 1 :], best[shared + 1 :]
            forward(word, shared + 1, begin, last, best)
            out, end = [], len(word)
            while end:
                if last[end] >= 0:
                    out.append(last[end])
                else:
                    out += self.spelled(word[begin[end] : end])[::-1]
                end = begin[end]
            before = word
            out.reverse()
            yield word, array("I", out).tobytes()

    def forward_bpe(self, word: str, first: int, begin: list[int], last: list[int], best: list[float]) -> None:
        """The one stable last piece of each prefix from length first on: endings are tried from the shortest, until no piece ends so."""
        suffix, stable = self.suffix.get, self.stable.get
        for end in range(first, len(word) + 1):
            at, piece, k = end - 1, -1, end - 1
            while k >= 0:
                p = suffix(word[k:end])
                if p is None:
                    break
                if p >= 0:
                    left = last[k]
                    if left >= 0:
                        ok = stable(left << 32 | p)
                        if ok is None:
                            ok = self.is_stable(left, p)
                    else:
                        ok = True
                    if ok:
                        at, piece = k, p
                        break
                k -= 1
            begin.append(at)
            last.append(piece)

    def forward_unigram(self, word: str, first: int, begin: list[int], last: list[int], best: list[float]) -> None:
        """The best score of each prefix from length first on, and its last piece."""
        ids, suffix, score = self.ids, self.suffix, self.score
        for end in range(first, len(word) + 1):
            at, piece = end - 1, -1
            top = -float("inf") if word[end - 1] in ids else best[end - 1] + self.unknown_score
            for k in range(end - 1, -1, -1):
                p = suffix.get(word[k:end])
                if p is None:
                    break
                if p >= 0 and best[k] + score[p] >= top:
                    at, piece, top = k, p, best[k] + score[p]
            begin.append(at)
            last.append(piece)
            best.append(top)

    def words(self, texts: pa.Array) -> pa.Array:
        """The marked words of each text; also empty ones, which have no ids."""
        texts = pc.fill_null(texts, "")
        out = pc.replace_substring(pc.replace_substring(texts, " ", MARK), MARK, f" {MARK}")
        out = pc.binary_join_element_wise(pa.scalar(MARK), out, "")
        for _ in range(2):  # so that runs of marks of any length are whole again
            out = pc.replace_substring(out, f"{MARK} {MARK}", MARK + MARK)
        if self.lone:
            out = pc.replace_substring(out, "\n", " \n ")
        return pc.split_pattern(pc.if_else(pc.equal(texts, ""), texts, out), " ")

    def lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: the new ones are sorted and encoded."""
        found = list(map(self.known.get, words))
        new = dict(self.encode_words(sorted(w for w, ids in zip(words, found) if ids is None)))
        found = [new[w] if ids is None else ids for w, ids in zip(words, found)]
        if len(self.known) + len(new) > MOST_WORDS:
            self.known = dict(zip(words, found))
        else:
            self.known.update(new)
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return ids_of(self.words(texts), self.lookup)


@lru_cache(2)
def _segmenter(model: bytes) -> Segmenter:
    return Segmenter(model)


@lru_cache(2)
def _decoder(model: bytes) -> Decoder:
    return Decoder(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > MOST_MODEL_BYTES:
        raise ValueError(f"{path} is too large for a vocabulary")
    return model


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """docs with a column ids (array of int) of its column text."""
    docs = docs.drop("ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = _segmenter(model)
        for batch in batches:
            a = 0
            for texts in pieces_of(batch["text"], 2 << 20):
                pa.default_memory_pool().release_unused()
                part = batch.slice(a, len(texts))
                a += len(texts)
                coded = segmenter.encode(texts)
                offsets = np.cumsum([0] + [len(c) // 4 for c in coded]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(coded), np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), values)], names=[*part.schema.names, "ids"])

    return docs.mapInArrow(rows, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, model: bytes) -> DataFrame:
    """coded with a column decoded (string) of its column ids; null ids: ''."""
    coded = coded.drop("decoded")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, decoder.decode(part["ids"])], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(rows, T.StructType([*coded.schema.fields, T.StructField("decoded", T.StringType())]))
