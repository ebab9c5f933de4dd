"""Ids of texts from those of their distinct parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 24 << 20


def pieces_of(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """An array of texts in slices of about so many bytes."""
    place = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def ids_of(parts: pa.Array, lookup: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """Ids (uint32) of each list of parts; lookup gives those of the distinct parts, each asked for once."""
    coded = parts.flatten().dictionary_encode()
    found = lookup(coded.dictionary.to_pylist())
    pool = np.frombuffer(b"".join(found), "<u4")
    length = np.fromiter(map(len, found), np.int64, len(found)) // 4
    start, which, bounds = np.cumsum(length) - length, coded.indices.to_numpy(), parts.offsets.to_numpy()
    out: list[bytes] = []
    for k in range(0, len(parts), 1024):
        at = bounds[k : k + 1025] - bounds[0]
        words = which[at[0] : at[-1]]
        size = length[words]
        reached = np.concatenate([[0], np.cumsum(size)])
        data = pool[np.repeat(start[words] - reached[:-1], size) + np.arange(reached[-1])].tobytes()
        ends = (4 * reached[at - at[0]]).tolist()
        out += [data[x:y] for x, y in zip(ends, ends[1:])]
    return out
