"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are the symbols.  Every run of ``window`` words of a benchmark item is a
pattern; an item with fewer words is one pattern of its own length, and each
length has its own search table:

* a block is the last two words of a position (one word for one-word patterns);
* the shift table tells how far the end of a pattern is at least from a block,
  so that most positions are skipped without being read;
* a block with shift 0 leads to a suffix bucket, which is split by the first
  block of the pattern, and the words themselves are compared at last.

The patterns are cut into tables of at most ``max_patterns`` windows.  One table
is sent to the executors at a time and searched in all documents, so what is
broadcast is bounded however long the benchmark is.

Nulls and texts without words have no words, no hits and ``contaminated`` false.
Repeated documents give a row each.  Items with a null id or text are left out.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, quoted, with_text_columns

WINDOW = 10
MAX_PATTERNS = 100_000
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

RESULT = "n_words bigint, n_hit bigint, items array<string>"
SPANS = "n_words bigint, starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of letters, digits and anything beyond ASCII."""
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(words: list[bytes], window: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


class WuManber:
    """Search table for patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], tuple[str, ...]]) -> None:
        self.length, self.patterns = length, patterns
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(dict)
        for p in patterns:
            for end in range(self.block, length + 1):
                at = p[end - 2 : end] if self.block == 2 else p[end - 1]
                if self.shift.get(at, self.far) > length - end:
                    self.shift[at] = length - end
            last = p[-2:] if self.block == 2 else p[-1]
            self.bucket[last].setdefault(p[: self.block], []).append(p)
        self.bucket = dict(self.bucket)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        """(first word, pattern) of each occurrence, by ascending end."""
        m, n, get, far, two = self.length, len(words), self.shift.get, self.far, self.block == 2
        i = m - 1
        while i < n:
            at = (words[i - 1], words[i]) if two else words[i]
            step = get(at, far)
            if step:
                i += step
                continue
            start = i - m + 1
            for p in self.bucket[at].get(tuple(words[start : start + self.block]), ()):
                if all(words[start + k] == p[k] for k in range(m)):
                    yield start, p
            i += 1


def tables(windows: Iterable[tuple[tuple[bytes, ...], str]]) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for p, item in windows:
        by_length[len(p)][p].add(item)
    return [WuManber(m, {p: tuple(sorted(x)) for p, x in ps.items()}) for m, ps in sorted(by_length.items())]


def occurrences(words: list[bytes], searchers: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans [start, end) of hit words, and the items found."""
    spans, items = [], set()
    for s in searchers:
        for start, p in s.find(words):
            spans.append((start, start + s.length))
            items.update(s.patterns[p])
    return merged(spans), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def pattern_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, max_patterns: int) -> Iterator[list[WuManber]]:
    """Tables of at most ``max_patterns`` windows; the driver holds one block at a time."""
    rows = benchmark.select(column(benchmark, item_id).cast("string").alias("i"), column(benchmark, text).cast("string").alias("t")).where("i is not null and t is not null")

    def all_windows():
        for r in rows.toLocalIterator():
            for p in windows_of(words_of(r.t.encode()), window):
                yield p, r.i

    source = all_windows()
    while block := list(islice(source, max_patterns)):
        yield tables(block)


def spans(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW, max_patterns=MAX_PATTERNS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, n_words, and the merged spans of hit words (starts, ends as word positions) with the items found.

    With more than one block of patterns, the documents are numbered, searched
    block after block and the spans of each document are merged.
    """
    spark = docs.sparkSession
    keep = [doc_id] if keep is None else keep
    blocks = pattern_blocks(benchmark, item_id, item_text, window, max_patterns)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        return _search(spark, docs, text, first, keep)
    scratch = Scratch(spark)
    numbered = scratch.write(docs.select(*(column(docs, c).alias(c) for c in {*keep, text})).withColumn("__n", F.monotonically_increasing_id()))
    parts = [scratch.write(_search(spark, numbered, text, b, ["__n"])) for b in _chain(first, second, blocks)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.groupBy("__n").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("s"), F.flatten(F.collect_list("ends")).alias("e"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.arrow_udf("struct<starts:array<int>,ends:array<int>>")
    def union(s, e):
        import pyarrow as pa

        rows = [merged(list(zip(a, b))) for a, b in zip(s.to_pylist(), e.to_pylist())]
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array([[x[k] for x in r] for r in rows], kind) for k in (0, 1)], names=["starts", "ends"])

    every = every.withColumn("u", union("s", "e")).select("__n", "n_words", "u.starts", "u.ends", "items")
    return numbered.select("__n", *(quoted(c) for c in keep)).join(every, "__n").drop("__n")


def _chain(*heads):
    yield heads[0]
    yield heads[1]
    yield from heads[2]


def _search(spark, docs: DataFrame, text: str, searchers: list[WuManber], keep: list[str]) -> DataFrame:
    sent = spark.sparkContext.broadcast(searchers)

    def make():
        found = sent.value

        def work(batch):
            out = {"n_words": [], "starts": [], "ends": [], "items": []}
            for t in batch:
                words = words_of(t)
                at, items = occurrences(words, found)
                out["n_words"].append(len(words))
                out["starts"].append([a for a, _ in at])
                out["ends"].append([b for _, b in at])
                out["items"].append(sorted(items))
            return out

        return work

    return with_text_columns(docs, text, make, SPANS, keep)


def digest(found: DataFrame, doc_id="doc_id") -> DataFrame:
    """The columns of the op10 contract from ``spans``."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select(quoted(doc_id), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"))


def remove_hits(docs: DataFrame, benchmark: DataFrame, *, text="text", **options) -> DataFrame:
    """Documents without any benchmark occurrence, with their own columns."""
    # Numbered names, so that no column of the documents clashes with a result column.
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    found = spans(plain, benchmark, text=names[docs.columns.index(text)], keep=names, **options)
    return found.where(F.size("starts") == 0).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))


def brute_force(docs: list[tuple], items: list[tuple], window=WINDOW) -> list[tuple]:
    """The same result by comparing every position with every window; for tests."""
    pats = [(p, str(i)) for i, t in items if i is not None and t is not None for p in windows_of(words_of(t.encode()), window)]
    out = []
    for d, t in docs:
        w = words_of(t.encode() if t is not None else None)
        hit, found = np.zeros(len(w), bool), set()
        for p, i in pats:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit[s : s + len(p)] = True
                    found.add(i)
        out.append((d, len(w), int(hit.sum()), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit.any())))
    return out
