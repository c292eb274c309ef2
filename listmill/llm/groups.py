"""Groups of rows inside Python tasks: runs of equal keys in sorted batches, and local union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows of each key that has two rows or more; batches are sorted by the long column `key`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch[key].to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(np.diff(keys)) + 1
        if held and held[-1][key][-1].as_py() != int(keys[0]):
            yield from _whole(held)
            held = []
        if not len(ends):
            held.append(batch)
            continue
        held.append(batch.slice(0, int(ends[0])))
        yield from _whole(held)
        sizes = np.diff(ends)
        for at, n in zip(ends[:-1][sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            yield pa.Table.from_batches([batch.slice(at, n)])
        held = [batch.slice(int(ends[-1]))]
    yield from _whole(held)


def _whole(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
    if held and sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1 that keeps the links which joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def link_batch(links: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    a, b = zip(*links, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], ["a", "b"])
