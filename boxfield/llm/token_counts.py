"""Token counts of whole texts with the whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the
driver, by merging each of them.  A part of a text (a run of spaces and what
follows it) that is such a string counts 1 by a look-up; only the rest is merged,
and its count is remembered up to a bound.

Null counts as the empty text: no bytes, no tokens.  Repeated rows keep a row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_text_columns
from .pieces import SPACE, PieceModel, Segments

LIMIT = 4096
_counters: dict[int, Segments] = {}


def counter(model: PieceModel, key: int | None = None) -> Segments:
    """Counts of parts; one for each worker process and model, so that later tasks find what earlier ones merged."""
    if key is not None and key in _counters:
        return _counters[key]
    fixed = {p[1:]: 1 for p in model.whole if p[0] == SPACE}
    ids, merge = model.ids, model.merge
    out = Segments(model, lambda s: sum(1 if p in ids else len(p.encode()) for p in merge(s)), sum, fixed)
    out.bare = {p: 1 for p in model.whole if p[0] != SPACE}
    if key is not None:
        _counters[key] = out
    return out


def read_model(path: str) -> PieceModel:
    with open(path, "rb") as f:
        model = PieceModel(f.read())
    model.whole  # noqa: B018  proved here and sent along
    return model


def token_counts(docs: DataFrame, model_path: str, *, text="text", keep: list[str], limit: int = LIMIT) -> DataFrame:
    """``keep`` columns, n_bytes, n_tokens and over_limit (n_tokens > limit); the model file is read on the driver only."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(read_model(model_path))
    key = sent._jbroadcast.id()

    def make():
        known = counter(sent.value, key)

        def work(batch):
            return {"n_bytes": [len(t) if t else 0 for t in batch], "n_tokens": [sum(known.values_of(t.decode())) if t else 0 for t in batch]}

        return work

    counted = with_text_columns(docs, text, make, "n_bytes bigint, n_tokens bigint", keep)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
