"""Profiles: values of a group counted in bins of 5 cm, and what is read off the bins.

Counting is an aggregation where the points are; only the bins of a group, a few
hundred at most, meet in one row, and a pure function on their counts follows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .estimators import quantiles

BIN = 0.05
#: Shares between which the values lie that a short span falls back on.
OUTER = (0.005, 0.995)


def profiles(values: DataFrame, keys: list[str], v: str, cell: float = BIN, weight: str | None = None) -> DataFrame:
    """keys, low, total, bins array<struct<bin,n>>: bins start at each group's smallest value; a row counts as often as ``weight`` says."""
    rows = values.select(*keys, F.col(v).alias("__v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("__w"))
    low = rows.groupBy(*keys).agg(F.min("__v").alias("low"), F.coalesce(F.sum(F.when(F.col("__v").isNotNull(), F.col("__w"))), F.lit(0)).alias("total"))
    counted = rows.join(low, keys).groupBy(*keys, "low", "total", F.floor((F.col("__v") - F.col("low")) / cell).alias("bin")).agg(F.sum("__w").alias("n"))
    return counted.groupBy(*keys, "low", "total").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))


def dense(bins) -> np.ndarray:
    """Counts from the first to the last bin."""
    at = np.array([b["bin"] for b in bins], np.int64)
    out = np.zeros(at.max() + 1)
    out[at] = [b["n"] for b in bins]
    return out


def read(bins: DataFrame, keys: list[str], find: Callable[[np.ndarray], tuple[float, float] | None], names: tuple[str, str]) -> DataFrame:
    """keys and two bin numbers that ``find`` reads off the counts; nulls where it finds none."""
    fields = ", ".join(f"{n} double" for n in names)

    @F.pandas_udf(f"struct<{', '.join(f'{n}: double' for n in names)}>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [find(dense(b)) or (None, None) for b in part]
            yield pd.DataFrame(found, columns=list(names), dtype=float)

    assert fields
    return bins.withColumn("__r", run("bins")).select(*bins.columns, *(F.col(f"__r.{n}").alias(n) for n in names))


def runs(mask: np.ndarray) -> np.ndarray:
    """(first, last + 1) of each run of true values."""
    step = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return step.reshape(-1, 2)


def peaks(n: np.ndarray, strong: float = 0.06, joined: float = 0.20, least: float = 3.0) -> tuple[float, float] | None:
    """First bin and end of the bins that belong to peaks.

    Peaks are taken from the highest down to ``strong`` of the highest and ``least``;
    a peak takes the run of bins of at least ``joined`` of its own height.
    """
    left, limit, taken = n.copy(), max(strong * n.max(), least), np.zeros(len(n), bool)
    while (top := int(left.argmax())) >= 0 and left[top] >= limit:
        own = runs(left >= joined * left[top])
        a, b = own[np.searchsorted(own[:, 0], top, "right") - 1]
        taken[a:b] = True
        left[a:b] = 0
    at = np.flatnonzero(taken)
    return (float(at[0]), float(at[-1] + 1)) if len(at) else None


def body_end(n: np.ndarray) -> tuple[float, float] | None:
    """(first bin, end) of the body that stands on the lowest bins; it ends below two weak bins in a row.

    The first bin of a body needs a fifth of the median of filled bins, the others
    0.35 of the median of the bins before them that counted; one point at least.
    """
    start = max(0.20 * float(np.median(n[n > 0])), 1.0)
    strong = np.flatnonzero(n >= start)
    if not len(strong):
        return None
    body = [int(strong[0])]
    for i in range(body[0] + 1, len(n)):
        if i - body[-1] > 2:
            break
        if n[i] >= max(0.35 * float(np.median(n[body])), 1.0):
            body.append(i)
    return float(body[0]), float(body[-1] + 1)


def gap(n: np.ndarray, strong: float = 0.25, wide: float = 0.30, side: float = 0.40) -> tuple[float, float] | None:
    """(first, end) of the weak run of at least ``wide`` metres that splits the dense part most evenly, with ``side`` metres on both sides."""
    if len(n) < 5 or n.sum() < 60:
        return None
    filled = runs(n >= strong * n.max())
    best = None
    for (_, a), (b, _) in zip(filled, filled[1:]):
        before, behind = (a - filled[0, 0]) * BIN, (filled[-1, 1] - b) * BIN
        if (b - a) * BIN >= wide - 1e-9 and min(before, behind) >= side:
            best = min(best or (np.inf,), (max(before, behind), float(a), float(b)))
    return None if best is None else best[1:]


# Over tables


def body_tops(columns: DataFrame, keys: list[str], z: str = "z", least: int = 5, weight: str | None = None) -> DataFrame:
    """keys, top: upper edge of the body of each column of at least ``least`` heights."""
    return tops_in(profiles(columns, keys, z, weight=weight).where(F.col("total") >= least), keys)


def tops_in(bins: DataFrame, keys: list[str]) -> DataFrame:
    p = read(bins, keys, body_end, ("first", "end"))
    return p.select(*keys, (F.col("low") + F.col("end") * BIN).alias("top"))


def peak_spans(values: DataFrame, keys: list[str], v: str, least: int = 30, weight: str | None = None) -> DataFrame:
    """keys, lo, hi: span of the peaks of each profile of at least ``least`` values; outer percentiles where that is short or there is no peak."""
    return spans_in(profiles(values, keys, v, weight=weight), quantiles(values, keys, v, list(OUTER), weight=weight), keys, least)


def spans_in(bins: DataFrame, outer: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """``peak_spans`` from profiles and q, their quantiles at OUTER."""
    p = read(bins.where(F.col("total") >= least), keys, peaks, ("first", "end"))
    lo, hi = F.col("low") + F.col("first") * BIN, F.col("low") + F.col("end") * BIN
    q0, q1 = F.col("q")[0], F.col("q")[1]
    ok = F.coalesce(hi - lo >= 0.65 * (q1 - q0), F.lit(False))
    return p.join(outer, keys).select(*keys, F.when(ok, lo).otherwise(q0).alias("lo"), F.when(ok, hi).otherwise(q1).alias("hi"))


def gap_middles(values: DataFrame, keys: list[str], v: str, side: float = 0.40, weight: str | None = None) -> DataFrame:
    """keys, middle: where each profile is split; null where it has no gap."""
    p = read(profiles(values, keys, v, weight=weight), keys, lambda n: gap(n, side=side), ("first", "end"))
    return p.select(*keys, (F.col("low") + (F.col("first") + F.col("end")) / 2 * BIN).alias("middle"))
