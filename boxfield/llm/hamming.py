"""Hamming self-join of fingerprints through a Gray-order hierarchical index.

A fingerprint is one or more 64-bit words.  Tables select bits: two fingerprints
meet where they agree on all selected bits of a table.  With the bits dealt into
``radius + 1`` disjoint tables at least one of them agrees for any pair within
the radius, so the join is exact.

Inside a bucket the fingerprints are sorted by Gray rank and become the leaves
of a tree.  Each node keeps the bits on which all below it agree; what a parent
states is left out below it.  A search walks down from the root and adds up
the differences to the stated bits; a node whose sum is beyond the radius is
pruned with everything below it.

Other keys than selected bits may make the buckets too (simhash.py uses shingles).
Buckets too large for one task are split without loss before they are searched:
by more bits (``refined``), or into blocks that meet two by two (``in_blocks``).
Pairs are never written out: each task keeps a forest of the links that it finds
and returns its edges, and rows that are joined already are not compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FAN = 16
FRONTIER = 1 << 20
BUFFER = 1 << 19


def gray_rank(words: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray order."""
    out = words.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def differences(x: np.ndarray) -> np.ndarray:
    """Bits set in each row of words."""
    return np.bitwise_count(x).sum(axis=1, dtype=np.int32)


class GrayIndex:
    """Forest over rows sorted by (bucket, Gray rank): one tree for each bucket."""

    def __init__(self, fp: np.ndarray, bucket: np.ndarray) -> None:
        self.fp = fp
        heads = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
        sizes = np.diff(np.r_[heads, len(fp)])
        self.tree_of = np.repeat(np.arange(len(heads)), sizes)
        every_and, every_or, tree = fp, fp, self.tree_of
        self.levels: list[dict] = []
        while True:
            n = len(tree)
            first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
            rank = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
            cut = np.flatnonzero(rank % FAN == 0)
            a, o = np.bitwise_and.reduceat(every_and, cut, axis=0), np.bitwise_or.reduceat(every_or, cut, axis=0)
            mask = ~(a ^ o)
            self.levels.append({"mask": mask, "value": a & mask, "start": cut, "end": np.r_[cut[1:], n]})
            every_and, every_or, tree = a, o, tree[cut]
            if len(tree) == len(heads):
                break
        self.levels.reverse()
        for up, down in zip(self.levels, self.levels[1:]):
            parent = np.repeat(np.arange(len(up["start"])), up["end"] - up["start"])
            down["rest"] = down["mask"] & ~up["mask"][parent]
        self.levels[0]["rest"] = self.levels[0]["mask"]

    def uniform(self, root: np.ndarray) -> list[np.ndarray]:
        """For each level the root that all rows below a node share, or -1."""
        low = high = root
        out = []
        for level in reversed(self.levels):
            low, high = np.minimum.reduceat(low, level["start"]), np.maximum.reduceat(high, level["start"])
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def roots(self, radius: int) -> np.ndarray:
        """Root of each row after joining all pairs within the radius and in one bucket.

        Nodes below which all rows have the query's root already are left out too,
        so that a large group of near copies takes few comparisons.
        """
        n = len(self.fp)
        root = np.arange(n)
        if not n:
            return root
        cost = np.cumsum(np.bincount(self.tree_of)[self.tree_of])
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + FRONTIER, "right")))
            shared = self.uniform(root)
            q = np.arange(at, min(to, n))
            at = to
            node = self.tree_of[q]
            acc = np.zeros(len(q), np.int32)
            mask_of = node
            for level, own in zip(self.levels, shared):
                new = own[node] != root[q]
                q, node, acc = q[new], node[new], acc[new]
                acc = acc + differences((self.fp[q] ^ level["value"][node]) & level["rest"][node])
                keep = acc <= radius
                q, node, acc = q[keep], node[keep], acc[keep]
                width = level["end"][node] - level["start"][node]
                base = np.repeat(level["start"][node] - np.r_[0, np.cumsum(width)[:-1]], width)
                mask_of = np.repeat(node, width)
                q, acc, node = np.repeat(q, width), np.repeat(acc, width), base + np.arange(width.sum())
            other = (node > q) & (root[node] != root[q])
            q, node, acc, mask_of = q[other], node[other], acc[other], mask_of[other]
            acc = acc + differences((self.fp[q] ^ self.fp[node]) & ~self.levels[-1]["mask"][mask_of])
            hit = acc <= radius
            join(root, q[hit], node[hit])
        return root


def join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the pairs (a, b) in the forest ``root``, in which every row points to the smallest row of its tree."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def table_bits(count: int, size: int) -> list[list[int]]:
    """``count`` disjoint runs that cover ``size`` bits."""
    cuts = [round(i * size / count) for i in range(count + 1)]
    return [list(range(a, b)) for a, b in zip(cuts, cuts[1:])]


def selected(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """One number made of up to 63 selected bits; bit 0 is the highest of the first word."""
    out = np.zeros(len(fp), np.uint64)
    for b in bits:
        out = (out << np.uint64(1)) | ((fp[:, b // 64] >> np.uint64(63 - b % 64)) & np.uint64(1))
    return out


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of several numbers."""
    out = np.uint64(0x9E3779B97F4A7C15)
    for x in parts:
        out = (out ^ np.asarray(x, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(29))
    return out


def words_in(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(w).to_numpy(zero_copy_only=False).view(np.uint64) for w in names], axis=1)


def fanned(rows: DataFrame, names: list[str], make) -> DataFrame:
    """rows with (id, words..., h) for each key column that ``make(fp, batch)`` yields."""
    kinds = "id bigint, " + ", ".join(f"{w} bigint" for w in names) + ", h bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for h in make(words_in(b, names), b):
                    yield pa.RecordBatch.from_arrays([b.column("id"), *(b.column(w) for w in names), pa.array(h.view(np.int64))], names=["id", *names, "h"])

    return rows.mapInArrow(run, kinds)


def keyed(nodes: DataFrame, names: list[str], tables: list[list[int]]) -> DataFrame:
    """A row for each node and table; h holds the selected bits and the table's number."""
    count = np.uint64(len(tables))
    return fanned(nodes.select("id", *names), names, lambda fp, _: (selected(fp, bits) * count + np.uint64(t) for t, bits in enumerate(tables)))


def searched(rows: DataFrame, names: list[str], radius: int) -> DataFrame:
    """Edges (a, b) of a forest over the links of rows with equal h."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(ids, fp, key):
            single = np.r_[True, key[1:] != key[:-1]] & np.r_[key[1:] != key[:-1], True]
            ids, fp, key = ids[~single], fp[~single], key[~single]
            if not len(ids):
                return None
            bucket = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            order = np.lexsort((gray_rank(fp[:, 0]), bucket))
            ids, fp, bucket = ids[order], fp[order], bucket[order]
            root = GrayIndex(fp, bucket).roots(radius)
            moved = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root[moved]])], names=["a", "b"])

        held: list[tuple] = []
        count = 0
        for b in batches:
            key = b.column("h").to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            fp = words_in(b, names)
            held.append((b.column("id").to_numpy(zero_copy_only=False), fp, key))
            count += len(key)
            if count < BUFFER:
                continue
            ids, fp, key = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if cut:
                if (out := solve(ids[:cut], fp[:cut], key[:cut])) is not None:
                    yield out
                ids, fp, key = ids[cut:], fp[cut:], key[cut:]
            held, count = [(ids, fp, key)], len(key)
        if held and (out := solve(*(np.concatenate(x) for x in zip(*held)))) is not None:
            yield out

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "a bigint, b bigint")


def hot_keys(rows: DataFrame, split_rows: int, scratch: Scratch, n_rows: int | None = None) -> DataFrame:
    """(h, n) of keys with more than ``split_rows`` rows.

    Keys are counted by some of their bits first, so that few counts are shuffled;
    only keys in crowded parts are then counted one by one.
    """
    bits = max(16, (max(1, (n_rows or 0) // 2000)).bit_length())
    part = F.shiftrightunsigned(F.xxhash64("h"), 64 - bits)
    crowded = scratch.write(rows.groupBy(part.alias("part")).count().where(F.col("count") > split_rows).select("part"))
    if crowded.isEmpty():
        return crowded.select(F.col("part").alias("h"), F.col("part").alias("n"))
    return scratch.write(rows.select("h").withColumn("part", part).join(crowded, "part", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > split_rows))


def links(rows: DataFrame, names: list[str], radius: int, scratch: Scratch, split, *, split_rows: int = 20_000, n_rows: int | None = None) -> DataFrame:
    """Edges (a, b) that join all rows (id, words..., h) of equal h within the radius; ``split`` cuts hot buckets (rows with n) into smaller ones."""
    hot = hot_keys(rows, split_rows, scratch, n_rows)
    if hot.isEmpty():
        return searched(rows, names, radius)
    big = rows.join(hot, "h")
    small = rows.join(hot, "h", "left_anti")
    return searched(small, names, radius).union(searched(split(big), names, radius))


def table_links(nodes: DataFrame, names: list[str], tables: list[list[int]], radius: int, scratch: Scratch, **options) -> DataFrame:
    """Edges that join all nodes (id, words...) within the radius.

    Exact: ``tables`` are disjoint runs over all bits, and more than ``radius`` of them.
    """
    return links(keyed(nodes, names, tables), names, radius, scratch, lambda big: refined(big.drop("n"), names, tables, radius), **options)


def in_blocks(big: DataFrame, names: list[str], size: int) -> DataFrame:
    """Rows of hot buckets, dealt into blocks of about ``size`` rows; every two blocks of a bucket meet in a bucket of their own."""
    blocks = F.ceil(F.col("n") / F.lit(size))
    own = F.pmod(F.xxhash64("id"), blocks)
    spread = big.select("id", *names, "h", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)).alias("other"))
    return spread.where("own <> other").select("id", *names, F.xxhash64("h", F.least("own", "other"), F.greatest("own", "other")).alias("h"))


def refined(big: DataFrame, names: list[str], tables: list[list[int]], radius: int) -> DataFrame:
    """Rows of hot buckets, keyed by their bucket and one of ``radius + 1`` parts of all other bits.

    Two fingerprints of a bucket agree on its bits, so all their differences lie
    in the others; of radius + 1 parts of these, one is equal for any pair within
    the radius.
    """
    size, count = 64 * len(names), radius + 1
    parts = []
    for bits in tables:
        rest = [b for b in range(size) if b not in set(bits)]
        cuts = [round(i * len(rest) / count) for i in range(count + 1)]
        parts.append([rest[a:b] for a, b in zip(cuts, cuts[1:])])

    def make(fp, batch):
        h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
        of = (h % np.uint64(len(tables))).astype(int)
        for i in range(count):
            out = np.zeros(len(h), np.uint64)
            for t in np.unique(of):
                rows = of == t
                out[rows] = mixed(h[rows], i, selected(fp[rows], parts[t][i]))
            yield out

    return fanned(big, names, make)
