"""Token ids of documents packed into rows of a fixed length.

Documents longer than a row are split losslessly into full rows and a rest.
Pieces are dealt into groups by a hash, about ``GROUP_BYTES`` of text each, and
every group is packed by best-fit-decreasing: pieces by falling length, each
into the open row with the least room that still holds it, which a segment tree
over the room left finds in logarithmic time.  A group is one task's work and
bounded; more documents make more groups.

A packed row has its length, the id matrix row (little-endian, two bytes an id
or four in a vocabulary beyond 65,536, padded), the cumulative segment lengths,
the positions that restart at every segment, and which document and which part
of it each segment is, so that ``unpacked`` gives every document back.  Ids of
documents may have any type that can be ordered.  Null and empty texts have no
tokens and no segments.  Repeated rows are packed once for each row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from .common import column, text_udf
from .pieces import SPACE, PieceModel

LENGTH = 4096
GROUP_BYTES = 16 << 20
PAD = 0
#: Words whose ids a worker remembers.
WORDS = 250_000
PACKED = "pack_id bigint, length int, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<{id}>, parts array<int>, starts array<bigint>"
_encoders: dict = {}


class RoomTree:
    """Segment tree over room 0..length: how many open rows have so much room."""

    def __init__(self, length: int) -> None:
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, row) of an open row with the least room of at least ``least``, which it removes."""
        count, at = self.count, least + self.leaves
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at *= 2
                if not count[at]:
                    at += 1
        room = at - self.leaves
        row = self.rows[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, row


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Item numbers of each row; every size is 1..length."""
    tree, rows = RoomTree(length), []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = tree.take(sizes[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > sizes[i]:
            tree.put(room - sizes[i], row)
    return rows


def id_type(model: PieceModel) -> str:
    return "<u2" if len(model.pieces) <= 1 << 16 else "<i4"


def encoder(data: bytes, key: int) -> Words:
    """The library for this model and the words it has encoded, once for each worker process."""
    if key not in _encoders:
        _encoders[key] = Words(SentencePieceProcessor(model_proto=data), PieceModel(data))
    return _encoders[key]


class Words(dict):
    """Ids, as bytes, of the words between single spaces, each encoded by the library when it is first met.

    No piece has a space behind another character (``PieceModel`` refuses models that do),
    so a word's ids are the same alone, where the library puts a space before it.  Texts
    with runs of spaces or escaped ones, and models that put no space before, are encoded whole.
    """

    def __init__(self, library: SentencePieceProcessor, model: PieceModel, limit: int = WORDS) -> None:
        super().__init__()
        self.library, self.apart, self.limit = library, model.dummy_prefix, limit
        self.code = "H" if id_type(model) == "<u2" else "i"

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; all words that are new to the batch go to the library at once."""
        code = self.code
        parts = [t.split(" ") for t in texts]
        cut = [self.apart and SPACE not in t and "" not in p for t, p in zip(texts, parts)]
        if len(self) >= self.limit:
            self.clear()
        new = {w for p, c in zip(parts, cut) if c for w in p if w not in self}
        new = list(new)
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.update((w, array(code, x).tobytes()) for w, x in zip(some, self.library.encode(some, num_threads=1)))
        return [b"".join(map(self.__getitem__, p)) if c else array(code, self.library.encode(t)).tobytes() for t, p, c in zip(texts, parts, cut)]


def split(ids: bytes, width: int, length: int) -> list[dict]:
    """Parts of at most ``length`` ids of ``width`` bytes each."""
    step = width * length
    return [{"part": k, "start": at // width, "n": (min(len(ids), at + step) - at) // width, "ids": ids[at : at + step]} for k, at in enumerate(range(0, len(ids), step))]


def token_parts(docs: DataFrame, data: bytes, *, doc_id="doc_id", text="text", length: int = LENGTH) -> DataFrame:
    """(doc_id, part, start, n, ids) for each part of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(data)
    key = sent._jbroadcast.id()
    kind = id_type(PieceModel(data))

    def make():
        words = encoder(sent.value, key)
        width = np.dtype(kind).itemsize

        def work(batch):
            parts = []
            for at in range(0, len(batch), 64):  # new words of a few texts at a time
                parts += [split(x, width, length) for x in words.encode([t.decode() if t else "" for t in batch[at : at + 64]])]
            return {"parts": parts}

        return work

    run = text_udf(make, "parts array<struct<part:int,start:bigint,n:int,ids:binary>>")
    return docs.select(column(docs, doc_id).alias("doc_id"), F.explode(run(column(docs, text).cast("string"))["parts"]).alias("p")).select("doc_id", "p.*")


def pack(docs: DataFrame, model_path: str, *, doc_id="doc_id", text="text", length: int = LENGTH, pad: int = PAD, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Packed rows (PACKED) of all documents; the only second look at the texts takes their byte lengths."""
    with open(model_path, "rb") as f:
        data = f.read()
    kind = id_type(PieceModel(data))
    width = np.dtype(kind).itemsize
    total = docs.agg(F.sum(F.octet_length(column(docs, text).cast("string")))).first()[0] or 0
    groups = -(-total // group_bytes) or 1
    parts = token_parts(docs, data, doc_id=doc_id, text=text, length=length)
    # The row number spreads repeated rows and a frequent id over all groups.
    dealt = parts.withColumn("group", F.pmod(F.xxhash64("doc_id", "part", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    names = ["doc_id", "part", "start", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None
        for b in batches:
            for g, *row in zip(b.column("group").to_pylist(), *(b.column(c).to_pylist() for c in names)):
                if g != current:
                    if held:
                        yield from packed(held, current)
                    held, current = [], g
                held.append(tuple(row))
        if held:
            yield from packed(held, current)

    def packed(rows: list[tuple], group: int) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1], r[4]))
        filler = np.array([pad], kind).tobytes()
        positions = np.arange(length, dtype="<u2" if length <= 1 << 16 else "<i4").tobytes()
        step = len(positions) // length
        out: list[dict] = []
        for number, items in enumerate(best_fit_decreasing([r[3] for r in rows], length)):
            own = [rows[i] for i in items]
            sizes = [r[3] for r in own]
            used = sum(sizes)
            out.append({
                "pack_id": (group << 32) + number, "length": length, "n_tokens": used,
                "input_ids": b"".join([*(r[4] for r in own), filler * (length - used)]),
                "position_ids": b"".join([*(positions[: n * step] for n in sizes), bytes(step * (length - used))]),
                "cu_seqlens": [0, *np.cumsum(sizes).tolist()], "doc_ids": [r[0] for r in own], "parts": [r[1] for r in own], "starts": [r[2] for r in own],
            })
            if len(out) == 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from .warc import arrow_schema

    ddl = PACKED.format(id=dealt.schema["doc_id"].dataType.simpleString())
    schema = arrow_schema(ddl)
    assert width <= 4
    return dealt.repartition("group").sortWithinPartitions("group").select("group", *names).mapInArrow(run, ddl)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet; the matrices are the concatenated rows of the binary columns."""
    packed.write.mode("error").parquet(path)


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids, positions) of a batch of packed rows, each rows x length."""
    length = batch.column("length")[0].as_py()

    def matrix(name: str) -> np.ndarray:
        rows = batch.column(name).to_pylist()
        return np.frombuffer(b"".join(rows), "<u2" if len(rows[0]) == 2 * length else "<i4").reshape(-1, length)

    return matrix("input_ids"), matrix("position_ids")


def unpacked(packed: DataFrame) -> DataFrame:
    """(doc_id, part, start, ids binary) of every segment: the parts of a document in order are its ids."""
    i = F.posexplode(F.arrays_zip("doc_ids", "parts", "starts"))
    width = F.expr("cast(octet_length(input_ids) div length as int)")
    rows = packed.select("input_ids", "cu_seqlens", width.alias("width"), i.alias("k", "s"))
    begin, end = F.col("cu_seqlens")[F.col("k")], F.col("cu_seqlens")[F.col("k") + 1]
    ids = F.substring("input_ids", begin * F.col("width") + 1, (end - begin) * F.col("width"))
    return rows.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.parts").alias("part"), F.col("s.starts").alias("start"), ids.alias("ids"))
