"""Quality of documents by a linear-chain conditional random field over their lines.

Each line has features of its own and of the lines beside it, and is labelled
good or bad.  Training starts with every line of a labelled document carrying
the document's label; lines of bad documents are then labelled anew by the
model and the model is fitted again, so that good lines in bad documents are
learnt as good.  The score of a document is the mean of its lines' marginals
from forward-backward, weighted by length, put through a logistic curve fitted
on the same sample.

At most ``ROWS`` labelled documents, chosen by a hash of the id, are used for
fitting, with all their lines; a document of more than ``CHAIN`` lines is fitted
as several chains, one after another.  Scoring covers whole texts as one chain.

A null or empty text is one empty line.  Without labelled documents of both
kinds the score is the rate of good labels, or one half.  Repeated rows keep a
row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, quoted, text_bytes, with_text_columns
from .learning import labelled_sample, logistic, sigmoid
from .quality_rules import KEPT_BYTES, repeated_mask

ROWS = 3000
CHAIN = 128
ROUNDS = 2
STEPS = 120
LETTERS_NOT_UPPER = bytes(b for b in range(256) if not 0x41 <= b <= 0x5A)
NOT_DIGITS = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)
OWN = 14
#: Own features that also count from the line before and the line after.
BESIDE = (0, 1, 2, 3, 5, 7, 8)
SIZE = OWN + 2 * len(BESIDE)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN features in 0..1, length weights); blank lines are left out."""
    rows, weights = [], []
    lines = [(x, w) for x in text.split(b"\n") if (w := x.split())] or [(b"", [])]
    mask = repeated_mask([w for _, ws in lines for w in ws])
    inside = None if mask is None else np.r_[0, np.cumsum(mask)]
    at = 0
    seen: set[bytes] = set()
    for x, words in lines:
        n, size = len(words), max(1, len(x))
        own = max(1, n)
        again = 0.0 if inside is None else float(inside[at + n] - inside[at]) / own
        at += n
        rows.append((
            min(1.0, 10 * len(x.translate(None, KEPT_BYTES)) / size),
            min(1.0, 2 * len(x.translate(None, LETTERS_NOT_UPPER)) / size),
            min(1.0, x.count(b"!") / own),
            min(1.0, x.count(b"|") / own),
            min(1.0, 4 * len(x.translate(None, NOT_DIGITS)) / size),
            sum(map(bytes.__eq__, words, words[1:])) / own,
            1 - len(set(words)) / own if n else 0.0,
            again,
            float(x in seen),
            float(n < 3),
            float(n < 10),
            min(1.0, size / own / 20),
            float(x[-1:] not in b".!?:\"'" or not x),
            float(len(lines) == 1 and n < 10),
        ))
        seen.add(x)
        weights.append(size)
    return np.asarray(rows), np.asarray(weights, float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    part = own[:, BESIDE]
    blank = np.zeros((1, part.shape[1]))
    return np.concatenate([own, np.r_[blank, part[:-1]], np.r_[part[1:], blank]], axis=1)


@dataclass
class Crf:
    """weights: pull towards bad; step[a, b]: log weight of label b after a (0 good, 1 bad); curve: slope and constant."""

    weights: np.ndarray
    constant: float
    step: np.ndarray
    curve: np.ndarray

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Chance that each line is bad."""
        pull = np.exp(np.clip(features @ self.weights + self.constant, -30, 30)).tolist()
        gg, gb, bg, bb = np.exp(self.step).ravel().tolist()
        n = len(pull)
        forward, g, b = [], 1.0, pull[0]
        total = g + b
        g, b = g / total, b / total
        forward.append((g, b))
        for e in pull[1:]:
            g, b = g * gg + b * bg, (g * gb + b * bb) * e
            total = g + b
            g, b = g / total, b / total
            forward.append((g, b))
        out = [0.0] * n
        x, y = 1.0, 1.0
        for t in range(n - 1, -1, -1):
            g, b = forward[t]
            out[t] = b * y / (g * x + b * y)
            e = pull[t]
            if t:
                x, y = gg * x + gb * e * y, bg * x + bb * e * y
                total = x + y
                x, y = x / total, y / total
        return np.asarray(out)

    def badness(self, text: bytes) -> float:
        own, weights = line_features(text)
        return float(self.marginals(with_neighbours(own)) @ weights / weights.sum())

    def score(self, badness: np.ndarray) -> np.ndarray:
        return sigmoid(self.curve[0] * badness + self.curve[1])


def fit_chain(x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, constant and steps by Adam on the log-likelihood.

    x (lines, features) holds the lines of all documents one document after another,
    the longest first, y their labels; at each position only the documents that
    are long enough are worked on.
    """
    docs, length = len(lengths), int(lengths.max())
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    alive = [int((lengths > t).sum()) for t in range(length + 1)]
    inner = np.ones(len(x), bool)
    inner[starts] = False
    pairs = 2 * y[np.flatnonzero(inner) - 1] + y[inner]
    seen = np.bincount(pairs, minlength=4).reshape(2, 2)
    w, step = np.zeros(x.shape[1] + 1), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(step)], [np.zeros_like(w), np.zeros_like(step)]
    for k in range(1, STEPS + 1):
        e = np.stack([np.ones(len(x)), np.exp(np.clip(x @ w[:-1] + w[-1], -30, 30))], axis=1)
        trans = np.exp(step)
        a, b = e.copy(), np.ones((len(x), 2))
        a[starts] /= a[starts].sum(1, keepdims=True)
        for t in range(1, length):
            at = starts[: alive[t]] + t
            f = (a[at - 1] @ trans) * e[at]
            a[at] = f / f.sum(1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(length - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            eb = e[at + 1] * b[at + 1]
            joint = a[at][:, :, None] * trans * eb[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            f = eb @ trans.T
            b[at] = f / f.sum(1, keepdims=True)
        p = a * b
        off = p[:, 1] / p.sum(1) - y
        grads = [np.r_[off @ x, off.sum()] / len(x) + 1e-4 * w, (expected - seen) / len(x) + 1e-4 * step]
        for i, (theta, grad) in enumerate(zip((w, step), grads)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad**2
            theta -= 0.2 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return w[:-1], float(w[-1]), step


def fit(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> Crf:
    """A model from each document's line features, lengths and label (1 good)."""
    empty = Crf(np.zeros(SIZE), 0.0, np.zeros((2, 2)), logistic(np.zeros((len(labels), 1)), labels))
    if not len(labels) or labels.min() == labels.max():
        return empty
    # Chains of at most CHAIN lines, the longest first; ``of`` tells each chain's document and first line.
    of = [(i, at) for i, f in enumerate(features) for at in range(0, len(f), CHAIN)]
    of.sort(key=lambda k: -min(CHAIN, len(features[k[0]]) - k[1]))
    lengths = np.array([min(CHAIN, len(features[i]) - at) for i, at in of])
    x = np.concatenate([features[i][at : at + CHAIN] for i, at in of])
    lines = [np.full(len(f), 1 - y) for f, y in zip(features, labels)]
    model = empty
    for turn in range(ROUNDS):
        model = Crf(*fit_chain(x, lengths, np.concatenate([lines[i][at : at + CHAIN] for i, at in of])), empty.curve)
        if turn + 1 < ROUNDS:
            for i in np.flatnonzero(labels == 0):
                p = model.marginals(features[i])
                lines[i] = (p >= min(0.5, p.max())).astype(lines[i].dtype)
    bad = np.array([model.marginals(f) @ w / w.sum() for f, w in zip(features, weights)])
    model.curve = logistic(bad[:, None], labels)
    return model


def fitted(docs: DataFrame, labels: DataFrame, *, label="quality", mod=3, held_out=1, rows=ROWS, **columns) -> Crf:
    """Fits on a bounded sample of labelled documents; only line features reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, y in zip(text_bytes(b.column("text")), b.column("label").to_pylist()):
                own, weights = line_features(t)
                f = with_neighbours(own).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([f.tobytes()]), pa.array([weights.astype("<f4").tobytes()]), pa.array([y], pa.int32())], names=["f", "w", "label"])

    found = labelled_sample(docs, labels, label, mod, held_out, rows, **columns).mapInArrow(run, "f binary, w binary, label int").toPandas()
    # In a fixed order, so that sums do not depend on which task ends first.
    found = found.sort_values(["label", "f", "w"], ignore_index=True)
    features = [np.frombuffer(f, "<f4").reshape(-1, SIZE).astype(float) for f in found["f"]]
    weights = [np.frombuffer(w, "<f4").astype(float) for w in found["w"]]
    return fit(features, weights, found["label"].to_numpy(np.int64))


def scored(docs: DataFrame, model: Crf, *, text="text", keep: list[str], name="score") -> DataFrame:
    """``keep`` columns and the score of each whole text."""

    def make():
        def work(batch):
            return {name: model.score(np.array([model.badness(t or b"") for t in batch], float).reshape(-1))}

        return work

    return with_text_columns(docs, text, make, f"`{name}` double", keep)


def labelled_lines(docs: DataFrame, model: Crf, *, text="text", keep: list[str]) -> DataFrame:
    """``keep`` columns and bad array<double>: the chance that each non-blank line is bad."""

    def make():
        return lambda batch: {"bad": [model.marginals(with_neighbours(line_features(t or b"")[0])).tolist() for t in batch]}

    return with_text_columns(docs, text, make, "bad array<double>", keep)


def digest(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """The columns of the op8 contract."""
    model = fitted(docs, labels, doc_id=doc_id, text=text)
    out = scored(docs, model, text=text, keep=[doc_id])
    return out.select(quoted(doc_id), (crc_remainder(F.col(quoted(doc_id)), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Documents with a score of one half or more, with their own columns."""
    model = fitted(docs, labels, **columns)
    out = scored(docs, model, text=columns.get("text", "text"), keep=list(docs.columns), name="__score")
    return out.where(F.col("__score") >= 0.5).drop("__score")
