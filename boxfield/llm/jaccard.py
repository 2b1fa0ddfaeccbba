"""Exact links of shingle sets inside candidate groups.

A set is a sorted array of distinct 64-bit shingle hashes.  Two sets are linked
if their Jaccard similarity reaches the threshold.  Only sets that share one of
their rarest hashes (prefix filter, without loss) are compared, and a set that
has a component already is never compared again, so that a large group of near
copies takes few comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 20
SLACK = 1e-9


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())


def set_components(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the position of the first set of its component."""
    n = len(sets)
    root = np.arange(n)
    lengths = np.fromiter(map(len, sets), np.int64, n)
    if n < 2 or not lengths.sum():
        return root
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token, owner = rank[token], np.repeat(root, lengths)
    token = token[np.lexsort((token, owner))]
    starts = np.cumsum(lengths) - lengths
    prefix = np.minimum(lengths, lengths - np.ceil(similarity * lengths - SLACK).astype(np.int64) + 1)
    at = spread(starts, prefix)
    held, holder = token[at], owner[at]
    order = np.argsort(held, kind="stable")
    held, holder = held[order], holder[order]
    left = np.ones(n, bool)
    count = built = n
    mine = np.zeros(len(often), bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        count -= 1
        queue = [first]
        while queue and count:
            if 2 * count < built:  # sets with a component leave the index
                stay = left[holder]
                held, holder, built = held[stay], holder[stay], count
            d = queue.pop()
            own = token[starts[d] : starts[d] + lengths[d]]
            a = np.searchsorted(held, own[: prefix[d]], "left")
            near = np.unique(holder[spread(a, np.searchsorted(held, own[: prefix[d]], "right") - a)])
            near = near[left[near]]
            near = near[(lengths[near] >= similarity * lengths[d] - SLACK) & (similarity * lengths[near] <= lengths[d] + SLACK)]
            mine[own] = True
            cuts = np.flatnonzero(np.diff(np.cumsum(lengths[near]) // CHUNK)) + 1
            for part in np.split(near, cuts):
                if not len(part):
                    continue
                size = lengths[part]
                both = np.add.reduceat(mine[token[spread(starts[part], size)]], np.cumsum(size) - size, dtype=np.int64)
                hit = part[both * (1 + similarity) >= similarity * (size + lengths[d]) - SLACK]
                root[hit], left[hit] = first, False
                count -= len(hit)
                queue.extend(hit.tolist())
            mine[own] = False
    return root


def confirmed(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that join, within each group, all rows (group, node, shingles) that links of ``similarity`` join."""

    def solve(nodes: list[int], found: list[bytes]) -> pa.RecordBatch:
        root = set_components([np.frombuffer(x, "<u8") for x in found], similarity)
        moved = np.flatnonzero(root != np.arange(len(root))).tolist()
        return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in moved], pa.int64()), pa.array([nodes[root[i]] for i in moved], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, found = None, [], []
        for batch in batches:
            for group, node, x in zip(batch.column("group").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles")):
                if group != now:
                    if len(nodes) > 1:
                        yield solve(nodes, found)
                    now, nodes, found = group, [], []
                if not (nodes and nodes[-1] == node):  # repeated rows
                    nodes.append(node)
                    found.append(x.as_py())
        if len(nodes) > 1:
            yield solve(nodes, found)

    rows = sets.select("group", "node", "shingles").repartition("group").sortWithinPartitions("group", "node")
    return rows.mapInArrow(run, "a bigint, b bigint")
