"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model, offline:

* the normaliser: an arc from space to its escaped form, identity else, and an
  arc at the start that writes one more;
* the pieces: a trie whose final states write a piece, and for each character
  that is no piece a fallback arc that writes its bytes;
* for merge models, an acceptor over neighbouring pieces.  Its weight is 0 where
  the two strings, merged side by side, never join across their border, else
  infinite.  This is read off two tables of each piece, made once: which symbol
  stands at its end (at its start) while the piece is merged, and the rank of its
  next merge meanwhile.  No text is merged when it is encoded.

They are composed lazily with each input, in a merge model stretch by stretch between
neighbouring characters that stand side by side in no piece: a state is a place in the text and the
last piece, and the arcs are relaxed in the tropical semiring in text order.
Merging never crosses a border that the two pieces beside it would not cross on
their own, so in a merge model one path of finite weight leads to any place.
Unigram models need no acceptor; there a piece weighs minus its score.  Decoding
runs the inverse: pieces to bytes, bytes to characters, escaped spaces back.

Null encodes and decodes to null; the empty text has no ids.
"""

from __future__ import annotations

import codecs
import math
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text_columns
from .pieces import BPE, BYTE, CONTROL, SPACE, UNKNOWN, PieceModel, Segments

#: What a character spelled in bytes costs beyond the heaviest piece of a unigram model.
FALLBACK = 10.0
START = -1
#: Stretches whose ids a worker remembers.
STRETCHES = 350_000
_encoders: dict = {}

codecs.register_error("pieces", lambda e: ("\ufffd" * (e.end - e.start), e.end))


class Normaliser:
    """One state; ``arcs`` holds what differs from identity, ``first`` what the arc from the start writes."""

    def __init__(self, model: PieceModel) -> None:
        self.arcs = ((" ", SPACE),)
        self.first = SPACE if model.dummy_prefix else ""

    def __call__(self, text: str) -> str:
        if not text:
            return ""
        for read, written in self.arcs:
            text = text.replace(read, written)
        return self.first + text


class Neighbours:
    """The acceptor over neighbouring pieces of a merge model.

    ``ends[p]`` and ``starts[p]`` list, for each stage of merging the string p by
    itself, (last or first symbol, rank of the next merge; infinite at the end).
    """

    def __init__(self, model: PieceModel) -> None:
        self.rank = model.rank
        self.ends: dict[str, list[tuple[str, float]]] = {}
        self.starts: dict[str, list[tuple[str, float]]] = {}

    def stages(self, piece: str) -> None:
        parts, get = list(piece), self.rank.get
        ends, starts = [], []
        while True:
            ranks = [get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
            best = min(ranks, default=math.inf)
            ends.append((parts[-1], best))
            starts.append((parts[0], best))
            if best == math.inf:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        self.ends[piece], self.starts[piece] = ends, starts

    def weight(self, left: str, right: str) -> float:
        """0 where merging left + right keeps the border, else infinite: both sides go on by rank until a merge across would come first."""
        ends, starts = self.ends[left], self.starts[right]
        i = j = 0
        while True:
            (x, a), (y, b) = ends[i], starts[j]
            across = self.rank.get(x + y, math.inf)
            if across < a and across <= b:  # of equals the leftmost is merged
                return math.inf
            if a == b == math.inf:
                return 0.0
            if a <= b:
                i += 1
            else:
                j += 1


class Transducer:
    """The pieces' trie, fallback arcs and weights of a model.

    Pieces are numbered by their ids; characters spelled in bytes get numbers
    beyond, as they come.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.normalise = Normaliser(model)
        self.merged = model.kind == BPE
        self.names: dict[int, str] = {i: p for p, i in model.ids.items()}
        self.written: dict[int, bytes] = {i: i.to_bytes(4, "little") for i in self.names}
        self.spelled: dict[str, int] = {}
        #: Neighbouring characters inside any piece: no arc and no merge crosses a place between two others.
        self.inner = frozenset(p[i : i + 2] for p in model.ids for i in range(len(p) - 1))
        #: What is written for each stretch without such a place that has been met.
        self.stretches: dict[str, bytes] = {}
        #: Weight of each neighbour pair that has been met, by first * 2**20 + second.
        self.pair: dict[int, float] = {}
        self.trie: dict = {}
        if self.merged:
            self.neighbours = Neighbours(model)
            final = {p: i for p, i in model.ids.items() if p in model.whole}  # others never come out of merging
            for p in final:
                self.neighbours.stages(p)
            self.weight = dict.fromkeys(final.values(), 0.0)
            self.fallback = 0.0
        else:
            final = model.ids
            self.weight = {i: -model.scores[i] for i in final.values()}
            self.fallback = FALLBACK + max(self.weight.values(), default=0.0)
        for p, i in final.items():
            node, child = self.trie, None
            for c in p:
                child = node.setdefault(c, [{}, None])
                node = child[0]
            child[1] = i

    def spell(self, char: str) -> int:
        """The number of the fallback arc of a character."""
        number = self.spelled.get(char)
        if number is None:
            number = self.spelled[char] = (1 << 19) + len(self.spelled)
            self.names[number] = char
            self.written[number] = b"".join(self.model.byte_ids[b].to_bytes(4, "little") for b in char.encode())
            self.weight[number] = self.fallback
            if self.merged:
                self.neighbours.stages(char)
        return number

    def beside(self, last: int, piece: int) -> float:
        """The acceptor's weight of two neighbours; the first piece of a text has none before it."""
        key = (last << 20) | piece
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) > 600_000:
                self.pair.clear()
            known = self.pair[key] = 0.0 if last == START else self.neighbours.weight(self.names[last], self.names[piece])
        return known

    def shortest(self, text: str) -> list[int]:
        """Numbers of the pieces on the lightest path through a normalised text."""
        last, back = self._relaxed_merges(text) if self.merged else self._relaxed(text)
        n = len(text)
        if n and last[n] is None:
            raise ValueError("no path")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def _relaxed(self, text: str) -> tuple[list, list]:
        """Last piece of the lightest path to each place, and where that piece starts."""
        n, weight = len(text), self.weight
        total, last, back = [0.0] + [math.inf] * n, [None] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node, j, arcs = self.trie, i, []
            for c in text[i:]:
                child = node.get(c)
                if child is None:
                    break
                j += 1
                node, piece = child
                if piece is not None:
                    arcs.append((piece, j))
            if not arcs or arcs[0][1] > i + 1:  # the character is no piece
                arcs.append((self.spell(text[i]), i + 1))
            for piece, j in arcs:
                cost = total[i] + weight[piece]
                if cost < total[j]:
                    total[j], last[j], back[j] = cost, piece, i
        return last, back

    def _relaxed_merges(self, text: str) -> tuple[list, list]:
        """The same where only neighbours weigh, 0 or infinite: a place that is reached at all is reached at 0.

        So the end of the text is settled as soon as it is reached, and the arcs of later places are left out.
        """
        n, root, known = len(text), self.trie, self.pair.get
        last: list = [None] * (n + 1)
        back = [0] * (n + 1)
        last[0] = START
        for i in range(n):
            before = last[i]
            if before is None:
                continue
            first, node, j = before << 20, root, i
            for c in text[i:]:
                child = node.get(c)
                if child is None:
                    break
                j += 1
                node, piece = child
                if piece is not None and last[j] is None:
                    w = known(first | piece)
                    if w is None:
                        w = self.beside(before, piece)
                    if w == 0.0:
                        last[j], back[j] = piece, i
            if last[n] is not None:
                break
            if last[i + 1] is None and ((child := root.get(text[i])) is None or child[1] is None):
                piece = self.spell(text[i])
                if self.beside(before, piece) == 0.0:
                    last[i + 1], back[i + 1] = piece, i
        return last, back

    def output(self, text: str) -> bytes:
        """What the lightest path through a normalised text writes; in a merge model it is composed stretch by stretch.

        There all paths of finite weight weigh the same, so the lightest path is made of those of the stretches.
        """
        inner = self.inner
        cuts = [i for i, pair in enumerate(map(add, text, text[1:]), 1) if pair not in inner] if self.merged else []
        if not cuts:
            return self._written(text)
        at, out = 0, []
        for i in cuts:
            out.append(self._written(text[at:i]))
            at = i
        out.append(self._written(text[at:]))
        return b"".join(out)

    def _written(self, text: str) -> bytes:
        found = self.stretches.get(text)
        if found is None:
            found = b"".join(map(self.written.__getitem__, self.shortest(text)))
            if len(text) <= 64:
                if len(self.stretches) >= STRETCHES:
                    self.stretches.clear()
                self.stretches[text] = found
        return found

    def encoder(self, limit: int = 150_000) -> Segments:
        """Ids of parts as little-endian 32-bit bytes."""
        return Segments(self.model, self.output, b"".join, limit=limit, normalise=self.normalise)


class Decoder:
    def __init__(self, model: PieceModel) -> None:
        self.dummy = model.dummy_prefix
        self.out = []
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds)):
            if k == BYTE:
                self.out.append(bytes([int(p[3:5], 16)]))
            elif k == CONTROL:
                self.out.append(b"")
            else:
                self.out.append((model.unk_surface if k == UNKNOWN else p.replace(SPACE, " ")).encode())
        self.starts_with_space = [p.startswith(SPACE) and k not in (UNKNOWN, CONTROL, BYTE) for p, k in zip(model.pieces, model.kinds)]
        self.control = [k == CONTROL for k in model.kinds]

    def text(self, ids: list[int]) -> str:
        """The inverse transducer's output; bytes that are no character become U+FFFD."""
        data = b"".join(map(self.out.__getitem__, ids))
        if self.dummy:
            for i in ids:
                if not self.control[i]:
                    if self.starts_with_space[i]:
                        data = data[1:]
                    break
        # A byte piece that spells part of an escaped space stays apart from what unescaping has made.
        return data.decode("utf-8", "pieces").replace(SPACE, " ")


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        model = PieceModel(f.read())
    model.whole  # noqa: B018
    return model


def id_lists(flat: list[bytes | None]) -> pa.ListArray:
    sizes = np.fromiter((len(x) // 4 if x else 0 for x in flat), np.int64, len(flat))
    offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
    values = pa.array(np.frombuffer(b"".join(x for x in flat if x), "<i4"), pa.int32())
    nulls = np.fromiter((x is None for x in flat), bool, len(flat))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(nulls)) if nulls.any() else pa.ListArray.from_arrays(offsets, values)


def encode(docs: DataFrame, model_path: str, *, text="text", ids="ids", keep: list[str], check: str | None = None) -> DataFrame:
    """``keep`` columns and ids array<int>; the model file is read on the driver only.

    With ``check``, a column of that name says whether decoding the ids gives the
    text back; the ids are decoded where they are, and not sent around for it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    key = sent._jbroadcast.id()

    def make():
        if key not in _encoders:
            _encoders[key] = Transducer(sent.value).encoder(), Decoder(sent.value)
        known, back = _encoders[key]

        def work(batch):
            texts = [None if t is None else t.decode() for t in batch]
            flat = [None if t is None else b"".join(known.values_of(t)) for t in texts]
            out = {ids: id_lists(flat)}
            if check:
                out[check] = [None if t is None else back.text(np.frombuffer(x, "<i4").tolist()) == t for t, x in zip(texts, flat)]
            return out

        return work

    return with_text_columns(docs, text, make, f"`{ids}` array<int>" + (f", `{check}` boolean" if check else ""), keep)


def decode_column(spark, model_path: str):
    """An Arrow UDF array<int> -> string."""
    sent = spark.sparkContext.broadcast(read_model(model_path))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        back = Decoder(sent.value)
        for b in batches:
            yield pa.array([None if x is None else back.text(x) for x in (None if not v.is_valid else v.values.to_pylist() for v in b)], pa.string())

    return run


def round_trip(docs: DataFrame, model_path: str, *, text="text", keep: list[str]) -> DataFrame:
    """``keep`` columns, ids, n_tokens, and whether decoding the ids gives the text back (null for null)."""
    out = encode(docs, model_path, text=text, keep=keep, check="round_trip")
    n_tokens = F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("bigint")
    return out.select(*(F.col(f"`{c}`") for c in keep), "ids", n_tokens.alias("n_tokens"), "round_trip")
