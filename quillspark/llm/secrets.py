"""Secret scans with a trigram inverted index.

From the syntax tree of each rule's regex a Boolean query over byte trigrams is derived (every match
must contain them). Each Arrow batch of documents gets an inverted index of just the trigrams that
some rule asks for; postings are intersected and united as the query says, and only the documents
that remain are searched with the regex. A rule without mandatory trigrams scans all documents.

Defined cases: null or empty text: no span. Repeated rows are scanned each. Null doc_id stays null. Very
long texts are indexed and searched whole, in memory proportional to the text. An empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A match counts if its group (0: all of it) has least characters; others are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, in their fixed order, then well-known public credential formats.
BASE_RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_password", r"[a-z][a-z0-9+]*://[^\s/:@]+:[^\s/:@]+@"),
)
RULES = BASE_RULES + MORE_RULES


# ---- from a regex to a Boolean trigram query -------------------------------------------------
# A query is True (all documents) or a tuple ("tri", frozenset) / ("and"|"or", queries).
# Trigrams are of the lower-cased ASCII bytes, so that one index serves both cases.


def _both(a, b):
    return b if a is True else a if b is True else ("and", (a, b))


def _either(queries: list):
    return True if not queries or any(q is True for q in queries) else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _of_strings(strings: set[bytes]):
    """Every match contains one of the strings."""
    return _either([True if len(s) < 3 else ("tri", frozenset(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


_MOST = 64  # strings that a part may stand for before it counts as anything


def _exact(node) -> set[bytes] | None:
    """All (lower-cased) strings that one node can match, or None if too many."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower().encode()} if arg < 128 else None
    if op is C.IN:
        out: set[bytes] = set()
        for kind, x in arg:
            codes = [x] if kind is C.LITERAL else range(x[0], x[1] + 1) if kind is C.RANGE else None
            if codes is None or len(codes) > _MOST or max(codes) > 127:
                return None
            out |= {chr(c).lower().encode() for c in codes}
        return out if len(out) <= 4 else None
    if op is C.SUBPATTERN:
        return _exact_all(arg[3])
    if op is C.BRANCH:
        parts = [_exact_all(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        low, high, inner = arg
        base = _exact_all(inner)
        if base is None or high > 4:
            return None
        out, power = set(), {b""}
        for k in range(high + 1):
            out |= power if k >= low else set()
            power = {x + y for x in power for y in base}
            if len(power) > _MOST:
                return None
        return out
    return None


def _exact_all(nodes) -> set[bytes] | None:
    out = {b""}
    for n in nodes:
        e = _exact(n)
        if e is None or len(out) * len(e) > _MOST:
            return None
        out = {x + y for x in out for y in e}
    return out


def _query(nodes):
    """What any match of a sequence of nodes must contain: runs of exactly known strings, and inner queries."""
    out, run = True, {b""}
    for n in nodes:
        e = _exact(n)
        if e is not None and len(run) * len(e) <= _MOST:
            run = {x + y for x in run for y in e}
            continue
        out, run = _both(out, _of_strings(run)), {b""}
        if e is not None:
            run = e
            continue
        op, arg = n
        if op is C.SUBPATTERN:
            out = _both(out, _query(arg[3]))
        elif op is C.BRANCH:
            out = _both(out, _either([_query(p) for p in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            out = _both(out, _query(arg[2]))
    return _both(out, _of_strings(run))


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex; True if nothing is mandatory."""
    return _query(_parser.parse(pattern))


def _trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return set(query[1]) if query[0] == "tri" else set().union(*map(_trigrams, query[1]))


# ---- index of a batch ------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings (ascending document numbers) of the wanted trigrams over a batch of texts."""

    def __init__(self, wanted: list[bytes]):
        self.wanted = wanted
        self.number = np.zeros(1 << 24, np.uint16)
        for k, t in enumerate(wanted):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = k + 1

    def build(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        found: list[list[int]] = [[] for _ in self.wanted]
        start = 0
        while start < len(texts):  # some MB of text at a time
            end, total = start, 0
            while end < len(texts) and (total == 0 or total + len(texts[end]) < 1 << 21):
                total += len(texts[end]) + 2
                end += 1
            part = _LOWER[np.frombuffer(b"\xff\xff".join(texts[start:end]), np.uint8)]
            if len(part) > 2:
                starts = np.cumsum([0] + [len(t) + 2 for t in texts[start : end - 1]])
                code = part[:-2].astype(np.uint32) << 16 | part[1:-1].astype(np.uint32) << 8 | part[2:]
                hit = self.number[code]
                at = np.flatnonzero(hit)
                doc = np.searchsorted(starts, at, side="right") - 1 + start
                pairs = np.unique(hit[at].astype(np.int64) << 40 | doc)
                for k, d in zip((pairs >> 40).tolist(), (pairs & (1 << 40) - 1).tolist()):
                    found[k - 1].append(d)
            start = end
        return {t: np.array(f, np.int64) for t, f in zip(self.wanted, found)}


def candidates(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Documents that satisfy the query, by intersecting and uniting postings."""
    if query is True:
        return np.arange(n)
    kind, parts = query
    if kind == "tri":
        out = None
        for p in sorted((postings[t] for t in parts), key=len):
            out = p if out is None else np.intersect1d(out, p, assume_unique=True)
        return out
    lists = [candidates(q, postings, n) for q in parts]
    if kind == "or":
        return np.unique(np.concatenate(lists))
    out = lists[0]
    for p in lists[1:]:
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def scanner(rules: tuple[Rule, ...]):
    """A function from a batch of texts to the (start, end, kind) spans of each."""
    order = {r.kind: k for k, r in enumerate(rules)}
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(_trigrams, queries)))

    def start():
        index = TrigramIndex(wanted)
        # A lone run of one class has the same maximal matches with its least length inside the regex.
        compiled = [re.compile(f"{r.pattern[:-1]}{{{r.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and not r.group else r.pattern) for r in rules]

        def scan(texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
            postings = index.build([b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts])
            spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
            for rule, rx, q in zip(rules, compiled, queries):
                for d in candidates(q, postings, len(texts)):
                    if texts[d]:
                        spans[d] += [(*m.span(), rule.kind) for m in rx.finditer(texts[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            return [sorted(s, key=lambda x: (x[0], order[x[2]])) for s in spans]

        return scan

    return start


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with a column secret_spans: array of (kind, start, end) in code points, end exclusive, by start
    and then by the rules' order. Existing columns stay, but one named secret_spans is replaced."""
    docs = docs.drop("secret_spans")
    start = scanner(rules)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = start()
        for batch in batches:
            column = [[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in scan(batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, _SPANS)], names=[*batch.schema.names, "secret_spans"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return docs.mapInArrow(rows, docs.limit(0).withColumn("secret_spans", F.lit(None).cast(kind)).schema)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, digest of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with each secret in text replaced by mark (overlapping spans as one); n_chars, where there is one, follows the new text."""
    start = scanner(rules)

    def cleaned(text: str | None, spans) -> str | None:
        if not spans:
            return text
        out, last = [], 0
        for a, b, _ in spans:
            if a >= last:
                out += [text[last:a], mark]
            last = max(last, b)
        return "".join(out) + text[last:]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = start()
        for batch in batches:
            texts = batch["text"].to_pylist()
            new = [cleaned(t, s) for t, s in zip(texts, scan(texts))]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array(new, batch["text"].type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([k if a == b else len(b) for k, a, b in zip(kept, texts, new)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(rows, docs.schema)
