"""Chat formatting by incremental black-box rendering.

A template is only a function from a list of turns to a text. The operator renders the prefixes of
a conversation one after another, takes the difference of consecutive outputs as the span of the
newest turn, and reports a template that changes what it had already written ("rewrites").

A conversation is one value, as a document's text is one, so that a black box can render it: its
turns come together in one task. Rendering all prefixes costs the square of its number of turns.

Defined cases: null text, role: empty. Turns are ordered by (turn, role, text), nulls first; repeated
rows are repeated turns. conv_id null is one conversation of its own. Very long texts and conversations
of many turns are rendered whole like others. An empty table gives an empty result. Other columns of
the input, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]  # role, text

_CONTROL = re.compile(r"</?s>|\[/?INST\]")


def escape(text: str) -> str:
    """Doubles backslashes and breaks each control string with a single one."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render_inst(turns: list[Turn]) -> str:
    """Each turn: <s>[INST]role[/INST]text</s>, with control strings inside role and text escaped."""
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


_MARKED = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


def read_inst(part: str) -> list[tuple[str, int, int]]:
    """(role, start, end) of the escaped text of each turn found in a rendered part."""
    return [(unescape(m[1]), m.start(2), m.end(2)) for m in _MARKED.finditer(part)]


@dataclass(frozen=True)
class ChatTemplate:
    """render is the black box; read finds marked texts in its output and unescape undoes its escapes."""

    render: Callable[[list[Turn]], str] = render_inst
    read: Callable[[str], list[tuple[str, int, int]]] = read_inst
    unescape: Callable[[str], str] = unescape


INST = ChatTemplate()

def turn_ends(turns: list[Turn], render: Callable[[list[Turn]], str]) -> tuple[str, list[int], bool]:
    """The whole output, the end of each turn in it, and whether a longer prefix changed earlier output.

    Every prefix is rendered, whatever the number of turns, as nothing less shows that a template leaves
    alone what it wrote; two outputs are held at a time.
    """
    ends, before, rewrites = [], "", False
    for k in range(1, len(turns) + 1):
        after = render(turns[:k])
        if not after.startswith(before):
            rewrites = True
            same = common_prefix(before, after)
            ends = [min(e, same) for e in ends]  # what was rewritten belongs to the newest turn
        ends.append(len(after))
        before = after
    return before, ends, rewrites


def common_prefix(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


_SPAN = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_())]))
_OUT = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("rewrites", pa.bool_()), ("spans", _SPAN)])
_DDL = "conv_id long, formatted string, rewrites boolean, spans array<struct<role: string, start: long, end: long, text_start: long, text_end: long, loss: boolean>>"


def format_conversations(conversations: DataFrame, template: ChatTemplate = INST, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: its formatted text and, from prefix differences, the span of each turn.

    Spans are code points, end exclusive; text_start and text_end bound the escaped text inside the
    span, and loss says whether the turn's text is under the loss mask.
    """
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("turns")
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, turns in zip(batch["conv_id"].to_pylist(), batch["turns"].to_pylist()):
                turns = [(t["role"], t["text"]) for t in turns]
                whole, ends, rewrites = turn_ends(turns, template.render)
                spans, start = [], 0
                for (role, _), end in zip(turns, ends):
                    found = template.read(whole[start:end])
                    a, b = (found[-1][1] + start, found[-1][2] + start) if found else (end, end)
                    spans.append({"role": role, "start": start, "end": end, "text_start": a, "text_end": b, "loss": role in loss_roles})
                    start = max(start, end)
                out.append({"conv_id": conv_id, "formatted": whole, "rewrites": rewrites, "spans": spans})
                if len(out) == 500:
                    yield pa.RecordBatch.from_pylist(out, _OUT)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, _OUT)

    return grouped.mapInArrow(rows, _DDL)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])


def digests(formatted: DataFrame, template: ChatTemplate = INST) -> DataFrame:
    """Digests of what is read back from the formatted text and its spans."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text = r["formatted"]
                turns = [(role, template.unescape(text[a:b])) for role, a, b in template.read(text)]
                loss = "".join(template.unescape(text[s["text_start"] : s["text_end"]]) for s in r["spans"] if s["loss"])
                sha = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                out.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": sha, "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(text), "rewrites": r["rewrites"]})
            yield pa.RecordBatch.from_pylist(out, _DIGEST)

    return formatted.mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
