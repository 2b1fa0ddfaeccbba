"""Spans along a row: the same device seen twice in a view or from both faces, and the pieces they make."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import to_world

SAME_PIXELS, SAME_SPAN = 0.5, 0.5
PIXELS = ("px0", "py0", "px1", "py1")


def pixel_iou(a: tuple, b: tuple) -> float:
    if None in a or None in b:
        return 0.0
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


def merged_spans(spans: DataFrame, key: str = "view_id") -> DataFrame:
    """(key, span_id, lo, hi, ms, n, label): spans (with pixel boxes px0..py1) of each view, each device once.

    Spans are taken by their lower end.  One that reaches into an earlier span and
    whose pixel box agrees with that one's by half is the same device: the two
    become one, with the label and pixel box of the one with more points.  Spans of
    different devices are never joined: where they overlap both end in the middle.
    Every step sees the ends that the one before it left, so a view, which is a few
    dozen spans, is folded in order.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        for s in pdf.sort_values(["lo", "span_id"]).to_dict("records"):
            pix = tuple(None if pd.isna(s[c]) else s[c] for c in PIXELS)
            s["pix"] = pix
            reached = [p for p in found if s["lo"] < p["hi"]]
            twin = next((p for p in reached if pixel_iou(p["pix"], pix) >= SAME_PIXELS), None)
            if twin:
                if s["n"] > twin["n"]:
                    twin["label"], twin["pix"] = s["label"], pix
                twin["lo"], twin["hi"] = min(twin["lo"], s["lo"]), max(twin["hi"], s["hi"])
                twin["n"], twin["ms"] = twin["n"] + s["n"], max(twin["ms"], s["ms"])
                continue
            for p in reached:
                if s["lo"] < p["hi"]:  # the span's own end has moved by the cuts before
                    p["hi"] = s["lo"] = (p["hi"] + s["lo"]) / 2
            found.append(s)
        return pd.DataFrame(found)[names]

    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    names = [key, "span_id", "lo", "hi", "ms", "n", "label"]
    ddl = ", ".join(f"{n} {kinds[n]}" for n in names)
    return spans.select(*names, *PIXELS).groupBy(key).applyInPandas(fold, ddl)


def cross_view(spans: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, span_id, lo, hi, ms, n, label): spans of a row seen from several views (view_id), each device once.

    If one of two views has a single span and the other several, the single one is
    left out where it overlaps any of them.  Spans that overlap by half of the
    shorter are linked; two that have only each other become one, with the smaller
    id; a span with two links or more bridges devices and is left out.
    """
    views = spans.groupBy(key, "view_id").agg(F.count(F.lit(1)).alias("own"))
    rows = views.groupBy(key).agg(F.count(F.lit(1)).alias("views"), F.max("own").alias("most"))
    counted = spans.join(views, [key, "view_id"]).join(rows, key)
    single = counted.where("views = 2 and most > 1 and own = 1")
    other = spans.select(F.col(key).alias("__k"), F.col("view_id").alias("__v"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    apart = F.least("hi", "__hi") > F.greatest("lo", "__lo")
    absorbed = single.join(other, (F.col(key) == F.col("__k")) & (F.col("view_id") != F.col("__v")) & apart, "left_semi").select("span_id")
    left = spans.join(absorbed, "span_id", "left_anti")
    b = left.select(F.col(key).alias("__k"), *(F.col(c).alias(f"{c}_b") for c in ("span_id", "lo", "hi")))
    near = F.least("hi", "hi_b") - F.greatest("lo", "lo_b") >= SAME_SPAN * F.least(F.col("hi") - F.col("lo"), F.col("hi_b") - F.col("lo_b"))
    links = left.join(b, (F.col(key) == F.col("__k")) & (F.col("span_id") != F.col("span_id_b")) & near).groupBy("span_id").agg(F.count(F.lit(1)).alias("links"), F.max("span_id_b").alias("mate"))
    kept = left.join(links, "span_id", "left").where("links is null or links = 1")
    mates = kept.select(*(F.col(c).alias(f"{c}_m") for c in ("span_id", "lo", "hi", "ms", "n", "label", "mate")))
    both = kept.join(mates, (F.col("mate") == F.col("span_id_m")) & (F.col("mate_m") == F.col("span_id")), "left").where("span_id_m is null or span_id < span_id_m")
    take = lambda f, c: F.coalesce(f(F.col(c), F.col(f"{c}_m")), F.col(c)).alias(c)
    return both.select(key, "span_id", take(F.least, "lo"), take(F.greatest, "hi"), take(F.greatest, "ms"), (F.col("n") + F.coalesce("n_m", F.lit(0))).alias("n"), F.when(F.col("n_m") > F.col("n"), F.col("label_m")).otherwise(F.col("label")).alias("label"))


def piece_scores(spans: DataFrame) -> DataFrame:
    """spans (lo, hi, ms, n) with centre, length and score of the piece they make."""
    return spans.withColumns({"centre": (F.col("lo") + F.col("hi")) / 2, "length": F.col("hi") - F.col("lo"), "piece_score": 0.55 * F.col("ms") + 0.45 * F.least(F.col("n") / 200.0, F.lit(1.0))})


def pieces(spans: DataFrame, seeds: DataFrame, key: str = "box_id") -> DataFrame:
    """Boxes cut out of seed boxes by spans (in the seed's own coordinate along): all columns of the seed, with centre, length and score of the piece."""
    p = piece_scores(spans).select(key, "span_id", "centre", "length", "piece_score").join(seeds, key)
    x, y, _ = to_world("centre", F.lit(0.0), F.lit(0.0), "cx", "cy", "cz", "yaw")
    return p.withColumns({"cx": x, "cy": y, "sl": F.col("length"), "score": F.col("piece_score")}).select("span_id", *seeds.columns)
