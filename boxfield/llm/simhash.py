"""SimHash near-duplicates of documents.

A text is lower-cased (A-Z), split into words at ASCII white space and shingled;
a fingerprint bit is 1 if it is set in over half of the shingles' hashes, repeats
included (near_duplicates leaves them out: its similarity is one of sets).
Documents with equal fingerprints form a class, the Gray-order index of
hamming.py links the classes, and graph.py joins them into components.

Two uses share this code:

* ``components_within``: one 64-bit word, a radius of 3, buckets of equal bits: exact.
* ``near_duplicates``: five-word shingles and a similarity of sets.  Two sets of
  that similarity share one of the least shingles of each (prefix filter, without
  loss), so these make the buckets; shingles that very many documents have come
  last in the order.  In a bucket the index searches 192-bit fingerprints within a
  radius that leaves room for the estimate's error, and jaccard.py decides each
  link by the sets.  Nothing in this depends on the size of the corpus.

Nulls and texts without words have no shingles and fingerprint zero; such
documents are alike and link like any others.  Rows with a null id get a null
component.  Repeated rows keep a row each.  An id on rows with different texts is
one document to ``components_within`` (what its texts reach, it reaches), while
``near_duplicates`` and ``keep_one`` look at each row by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, filtered, quoted, text_bytes, with_text_columns
from .graph import components
from .hamming import in_blocks, links, table_bits, table_links
from .jaccard import confirmed

SEED = 42
CHUNK = 1 << 16
#: Odd multipliers for further words: the 64-bit golden ratio times odd numbers.
GOLDEN = 0x9E3779B97F4A7C15
#: Frequent shingles: hashes counted together, least number among them, and how many are kept (they only set an order).
COUNTED, OFTEN, FREQUENT = 1 << 22, 6, 1 << 16
#: Shingle sets that one task holds to confirm links, in bytes.
CONFIRM_BYTES = 64 << 20
#: Rows of a block of a hot bucket.
BLOCK_ROWS = 10_000
SLACK = 1e-9


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle; fewer words than ``width`` are one shingle, none give none."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return np.frombuffer(digest(joined, SEED), ">u8").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends)]), ">u8").astype(np.uint64)


def word(hashes: np.ndarray, j: int) -> np.ndarray:
    """The j-th 64 hash bits of each shingle: the hash itself, then mixes of it."""
    if j == 0:
        return hashes
    x = hashes * np.uint64((GOLDEN * (2 * j + 1)) & (2**64 - 1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(GOLDEN)
    return x ^ (x >> np.uint64(29))


def fingerprint(hashes: np.ndarray, n_words: int = 1) -> list[int]:
    """Signed 64-bit words, highest bit first."""
    out = []
    for j in range(n_words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), CHUNK):
            bits = np.unpackbits(word(hashes[at : at + CHUNK], j).astype(">u8").view(np.uint8)).reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.uint32 if len(bits) > 255 else np.uint8)
        out.append(int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True))
    return out


def names(n_words: int) -> list[str]:
    return [f"fp{j}" for j in range(n_words)]


def fingerprints(docs: DataFrame, *, text="text", width=3, n_words=1, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs and fp0, fp1, ... (bigint)."""

    def make():
        def work(batch):
            rows = [fingerprint(shingle_hashes(t, width), n_words) for t in batch]
            return {f"fp{j}": [r[j] for r in rows] for j in range(n_words)}

        return work

    return with_text_columns(docs, text, make, ", ".join(f"fp{j} bigint" for j in range(n_words)), keep)


def linked(prints: DataFrame, doc_id: str, key: list[str], search, scratch: Scratch, *, with_class=(), confirm=None, one_id_one_document: bool = False) -> DataFrame:
    """prints with component_id, the smallest id that can be reached over links, and the component's own number.

    ``prints`` must be a written table: it is read more than once.  Rows that
    agree in ``key`` form a class, numbered ``node``; ``search`` makes edges of
    the classes' table, and ``confirm`` the edges that hold from that table with a
    candidate component.
    """
    ids = column(prints, doc_id)
    classes = scratch.write(prints.where(ids.isNotNull()).groupBy(*key).agg(F.min(ids).alias("id"), *(F.first(c).alias(c) for c in with_class)).withColumn("node", F.monotonically_increasing_id()))
    edges = search(classes)
    if confirm:
        found = components(edges, scratch)
        edges = confirm(scratch.write(classes.drop("least").join(found, "node")))
    if one_id_one_document:
        edges = edges.union(shared_ids(prints, ids, classes, key, scratch))
    found = components(edges, scratch)
    labelled = classes.select(*key, "id", "node").join(found, "node", "left").withColumn("__c", F.coalesce("component", "node")).drop("component")
    labelled = scratch.write(labelled)
    first = labelled.groupBy("__c").agg(F.min("id").alias("__component"))
    labelled = labelled.join(first, "__c").select(*(F.col(k).alias(f"__k_{k}") for k in key), "__component", "__c")
    same = [prints[k] == labelled[f"__k_{k}"] for k in key]
    return prints.join(labelled, same, "left").select(*(prints[quoted(c)] for c in prints.columns), F.when(ids.isNotNull(), F.col("__component")).alias("component_id"), F.when(ids.isNotNull(), F.col("__c")).alias("component"))


def shared_ids(prints: DataFrame, ids, classes: DataFrame, key: list[str], scratch: Scratch) -> DataFrame:
    """Edges between the classes of each id that rows of several classes have."""
    several = scratch.write(prints.where(ids.isNotNull()).groupBy(ids.alias("__id")).agg(*(F.min(k).alias(f"a_{k}") for k in key), *(F.max(k).alias(f"b_{k}") for k in key)).where(" or ".join(f"a_{k} <> b_{k}" for k in key)).select("__id"))
    rows = prints.join(several, ids == F.col("__id"), "left_semi").select(ids.alias("__id"), *key).distinct().join(classes.select("node", *key), key)
    order = Window.partitionBy("__id").orderBy("node")
    return rows.select(F.col("node").alias("a"), F.first("node").over(order).alias("b")).where("a <> b")


def components_within(docs: DataFrame, *, doc_id="doc_id", text="text", width=3, radius=3) -> DataFrame:
    """(doc_id, fp0, component_id) with links at ``radius`` or fewer of 64 bits, found exactly."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.write(fingerprints(docs, text=text, width=width, keep=[doc_id]))

    def search(classes):
        return table_links(classes.select(F.col("node").alias("id"), "fp0"), ["fp0"], table_bits(radius + 1, 64), radius, scratch)

    return linked(prints, doc_id, ["fp0"], search, scratch, one_id_one_document=True).drop("component")


def hexadecimal(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def digest(found: DataFrame, doc_id="doc_id") -> DataFrame:
    """The columns of the op6 contract."""
    return found.select(quoted(doc_id), hexadecimal(F.col("fp0")).alias("fingerprint"), "component_id")


def equal_bits(similarity: float) -> float:
    """Chance that two texts of this similarity agree on a bit."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def search_radius(similarity: float, bits: int, deviations: float = 6.5) -> int:
    """Differing bits within which nearly all pairs of ``similarity`` lie: the mean and ``deviations`` of it.

    Short texts differ in up to a quarter more bits than the mean (at 0.8: four of
    five shingles shared); this leaves five deviations for them too.
    """
    p = 1 - equal_bits(similarity)
    return math.ceil(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def set_of(hashes: np.ndarray) -> bytes:
    return np.unique(hashes).astype("<u8").tobytes()


def set_key(shingles: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(shingles, SEED), "big", signed=True)


def frequent_shingles(docs: DataFrame, *, text: str, width: int) -> np.ndarray:
    """Hashes of shingles that very many documents have, the most frequent last; at most ``FREQUENT``.

    They only set the order in which a text's least shingles are taken; the result
    of the search is the same with any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for t in text_bytes(b.column("t")):
                own = np.unique(shingle_hashes(t, width))
                held.append(own)
                size += len(own)
                if size >= COUNTED:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h[n >= OFTEN].view(np.int64)), pa.array(n[n >= OFTEN])], names=["h", "n"])

    found = docs.select(column(docs, text).cast("string").alias("t")).mapInArrow(run, "h bigint, n bigint")
    top = found.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return np.array([r.h for r in reversed(top)], np.int64).view(np.uint64)


def least_shingles(own: np.ndarray, similarity: float, frequent: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order, so many that any set of ``similarity`` shares one of its own first ones.

    ``own`` is sorted; ``frequent`` is sorted too, with the place of each in the order of frequency.
    """
    n = len(own)
    count = n - math.ceil(similarity * n - SLACK) + 1 if n else 0
    if not len(frequent) or not n:
        return own[:count]
    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
    known = frequent[at] == own
    if not known.any():
        return own[:count]
    rare = own[~known]
    return rare[:count] if len(rare) >= count else np.r_[rare, own[known][np.argsort(place[at[known]])][: count - len(rare)]]


def set_prints(docs: DataFrame, *, text: str, width: int, similarity: float, n_words: int, frequent: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns, a hash of the text, and of its distinct shingles fp0, fp1, ..., a hash of the set, its size and its least ones."""
    order = np.argsort(frequent)
    sent = docs.sparkSession.sparkContext.broadcast((frequent[order], order))

    def make():
        known, place = sent.value

        def work(batch):
            sets = [np.unique(shingle_hashes(t, width)) for t in batch]
            rows = [fingerprint(h, n_words) for h in sets]
            least = [least_shingles(h, similarity, known, place).view(np.int64) for h in sets]
            out = {f"fp{j}": [r[j] for r in rows] for j in range(n_words)}
            return out | {"set_key": [set_key(h.astype("<u8").tobytes()) for h in sets], "n_set": [len(h) for h in sets], "least": least}

        return work

    kinds = ", ".join(f"fp{j} bigint" for j in range(n_words)) + ", set_key bigint, n_set int, least array<bigint>"
    hashed = docs.select(*(column(docs, c).alias(c) for c in dict.fromkeys([*keep, text])), text_key(column(docs, text)).alias("text_key"))
    return with_text_columns(hashed, text, make, kinds, [*keep, "text_key"])


def text_key(text):
    return F.xxhash64(text.cast("string"), text.isNull())


def sets_within(docs: DataFrame, classes: DataFrame, *, doc_id: str, text: str, width: int) -> DataFrame:
    """(group, node, shingles) of classes (id, set_key, node, component, n_set), from the texts of their ids.

    A component beyond ``CONFIRM_BYTES`` is dealt into blocks, and every two of
    them make a group, so that all pairs meet and no task holds more than two.
    """

    def make():
        def work(batch):
            sets = [set_of(shingle_hashes(t, width)) for t in batch]
            return {"found": [set_key(x) for x in sets], "shingles": sets}

        return work

    blocks = classes.groupBy("component").agg(F.greatest(F.lit(1), F.ceil(2 * 8 * F.sum("n_set") / F.lit(float(CONFIRM_BYTES)))).cast("bigint").alias("blocks"))
    own = F.when(F.col("blocks") < 3, 0).otherwise(F.pmod(F.xxhash64("node"), F.col("blocks")))
    spread = classes.join(blocks, "component").withColumn("own", own).withColumn("other", F.explode(F.when(F.col("blocks") < 3, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
    spread = spread.where("blocks < 3 or own <> other").select("id", "set_key", "node", F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("group"))
    # Most texts are in no component: they are left out before the join, and sets are made behind it.
    some, _ = filtered(docs.select(column(docs, doc_id).alias("id"), column(docs, text).cast("string").alias("text")), classes, F.xxhash64("id"))
    sets = with_text_columns(some.join(spread, "id"), "text", make, "found bigint, shingles binary", ["group", "node", "set_key"])
    return sets.where("found = set_key").select("group", "node", "shingles")


def with_components(docs: DataFrame, scratch: Scratch, *, doc_id="doc_id", text="text", width=5, similarity=0.8, n_words=3) -> DataFrame:
    """(doc_id, text_key, component_id, component) of each row: components of rows whose shingle sets have a Jaccard similarity of ``similarity`` or more."""
    frequent = frequent_shingles(docs, text=text, width=width)
    prints = scratch.write(set_prints(docs, text=text, width=width, similarity=similarity, n_words=n_words, frequent=frequent, keep=[doc_id]))
    words = names(n_words)
    radius = search_radius(similarity, 64 * n_words)

    def search(classes):
        rows = classes.select(F.col("node").alias("id"), *words, F.explode("least").alias("h"))
        n_rows = classes.agg(F.sum(F.size("least"))).first()[0]
        return links(rows, words, radius, scratch, lambda big: in_blocks(big, words, BLOCK_ROWS), split_rows=2 * BLOCK_ROWS, n_rows=n_rows)

    def confirm(classes):
        return confirmed(sets_within(docs, classes, doc_id=doc_id, text=text, width=width), similarity)

    found = linked(prints, doc_id, [*words, "set_key"], search, scratch, with_class=("n_set", "least"), confirm=confirm)
    return found.select(quoted(doc_id), "text_key", "component_id", "component")


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """(doc_id, component_id) of each row; options as for ``with_components``."""
    return with_components(docs, Scratch(docs.sparkSession), doc_id=doc_id, text=text, **options).select(quoted(doc_id), "component_id")


def keep_one(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """One row of each group of near-duplicates, the one of the smallest id (and text hash); rows without an id stay.

    Rows are looked at one by one, so rows of one id with different texts stay
    each, and of rows that repeat id and text one stays.
    """
    scratch = Scratch(docs.sparkSession)
    found = with_components(docs, scratch, doc_id=doc_id, text=text, **options).toDF("__id", "__key", "__component_id", "__component")
    found = scratch.write(found.where("__id is not null").drop("__component_id"))
    row = F.struct("__id", "__key")
    first = found.groupBy("__component").agg(F.min(row).alias("__first"))
    ranked = found.join(first, "__component")
    others = scratch.write(ranked.where(row != F.col("__first")).select("__id", "__key").distinct())
    again = scratch.write(ranked.where(row == F.col("__first")).groupBy("__id", "__key").count().where("count > 1").select("__id", "__key"))
    # Numbered names, so that no column of the documents clashes with another.
    names_ = [f"__c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names_[docs.columns.index(c)] for c in (doc_id, text))
    plain = docs.toDF(*names_).withColumn("__own", text_key(F.col(own_text)))
    same = (F.col(own_id) == F.col("__id")) & (F.col("__own") == F.col("__key"))
    # Rows that no other row stands for are told by a filter, and only the rest are joined.
    hashed = F.xxhash64(F.col("__id"), F.col("__key"))
    suspects, clear = filtered(plain.withColumns({"__id": F.col(own_id), "__key": F.col("__own")}), others, hashed)
    kept = clear.drop("__id", "__key").unionByName(suspects.drop("__id", "__key").join(others, same, "left_anti"))
    if not again.isEmpty():
        order = Window.partitionBy(own_id, "__own").orderBy(F.xxhash64(*names_))
        one = kept.join(again, same, "left_semi").withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names_, docs.columns)))


def brute_force(rows: list[tuple], width=3, radius=3) -> list[tuple]:
    """(id, fingerprint, component) by comparing all pairs; for tests."""
    prints = [(i, fingerprint(shingle_hashes(t.encode() if t is not None else None, width))[0] & (2**64 - 1)) for i, t in rows]
    ids = sorted({i for i, _ in prints})
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= radius and (x := top(i)) != (y := top(j)):
                up[max(x, y)] = min(x, y)
    return [(i, f"{p:016x}", top(i)) for i, p in prints]
