"""Replies of a vision model as columns: quality words, confirmations, boxes in whole and in broken JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

NUMBER = r"\s*(-?\d+(?:\.\d+)?)\s*"
BOX = r"[\"']?bbox[\s_]*2d[\"']?\s*:\s*\[" + ",".join([NUMBER] * 4) + r"\]"
LABEL = r"[\"']?label[\"']?\s*:\s*[\"']([^\"']{0,20})"
LABEL_REACH = 80


def has_any(label, words) -> Column:
    low = F.lower(label if isinstance(label, Column) else F.col(label))
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return F.coalesce(out, F.lit(False))


def is_door(label) -> Column:
    return has_any(label, ("door",))


def is_ladder(label) -> Column:
    return has_any(label, ("ladder", "cable tray"))


def is_subtractive(label) -> Column:
    return is_door(label) | is_ladder(label)


def is_equipment(label) -> Column:
    return has_any(label, C.EQUIPMENT_TOKENS)


def quality_word(text) -> Column:
    """The last stated view quality, good or poor; good where none is stated."""
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"quality\W{0,4}\s*(good|poor|true|false|yes|no)\b"), F.lit(1))
    last = F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.when(last.isin("poor", "false", "no"), "poor").otherwise("good")


def rack_confirm(text) -> tuple[Column, Column]:
    """(is_rack, confidence) of a JSON reply; confidence is 0.5 if missing and kept in 0..1."""
    flag = F.lower(F.get_json_object(F.col(text), "$.is_rack")).isin("true", "yes", "1")
    sure = F.expr(f"try_cast(get_json_object(`{text}`, '$.confidence') AS DOUBLE)")
    return F.coalesce(flag, F.lit(False)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(0.5))))


def salvaged_boxes(replies: DataFrame, text: str = "text", keep: tuple[str, ...] = ("reply_id",)) -> DataFrame:
    """keep, k, a0..a3: the complete boxes of a reply that need not be whole JSON, in order."""
    groups = [F.regexp_extract_all(F.col(text), F.lit(BOX), F.lit(i)) for i in range(1, 5)]
    rows = replies.select(*keep, F.posexplode(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups)))).alias("k", "b"))
    return rows.select(*keep, "k", *(F.col("b").getField(f"g{i}").cast("double").alias(f"a{i}") for i in range(4)))


def salvaged_labels(text) -> Column:
    """label of each complete box of a reply, in order: the one stated within ``LABEL_REACH`` characters behind it, else device."""
    tails = F.regexp_extract_all(F.col(text), F.lit(BOX + "(?=(?s:(.{0,%d})))" % LABEL_REACH), F.lit(5))
    return F.transform(tails, lambda t: F.coalesce(F.nullif(F.trim(F.regexp_extract(t, LABEL, 1)), F.lit("")), F.lit("device")))


def pixel_rects(boxes: DataFrame, width: int, height: int, least: float = 8.0, absolute: str | None = None) -> DataFrame:
    """Boxes a0..a3 as x0, y0, x1, y1: relative to 0..1000 unless a size is beyond (or the column ``absolute`` says so), ordered, clipped, large enough."""
    a = [F.col(f"a{i}") for i in range(4)]
    pixels = F.greatest(*map(F.abs, a)) > 1000
    pixels = pixels | F.col(absolute) if absolute else pixels
    x = [F.when(pixels, v).otherwise(v / 1000.0 * width) for v in (a[0], a[2])]
    y = [F.when(pixels, v).otherwise(v / 1000.0 * height) for v in (a[1], a[3])]
    clip = lambda v, top: F.greatest(F.lit(0.0), F.least(F.lit(float(top)), v))
    out = boxes.select(*(c for c in boxes.columns if c not in ("a0", "a1", "a2", "a3", absolute)), clip(F.least(*x), width).alias("x0"), clip(F.least(*y), height).alias("y0"), clip(F.greatest(*x), width).alias("x1"), clip(F.greatest(*y), height).alias("y1"))
    return out.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def stated_regions(text: str | None) -> list[dict]:
    """Regions of whole JSON in a reply: a list, or the regions or boxes of an object; with bbox_2d, or x0..y1 in pixels."""
    value = last_json(text, "{")
    items = (value.get("regions") or value.get("boxes")) if isinstance(value, dict) else None
    items = items or last_json(text, "[") or []
    out = []
    for item in items if isinstance(items, list) else []:
        if not isinstance(item, dict):
            continue
        raw = item.get("bbox_2d")
        try:
            found = [float(v) for v in (raw[:4] if raw is not None else [item[k] for k in SIDES])]
        except (KeyError, TypeError, ValueError):
            continue
        if len(found) == 4:
            out.append({**{f"a{i}": v for i, v in enumerate(found)}, "pixels": raw is None, "label": str(item.get("label", "device"))[:20] or "device"})
    return out


SIDES = ("x0", "y0", "x1", "y1")


def stated_regions_column(name: str):
    """An Arrow UDF text -> array<struct<a0..a3, pixels, label>>."""

    @F.arrow_udf("array<struct<a0:double,a1:double,a2:double,a3:double,pixels:boolean,label:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([*((f"a{i}", pa.float64()) for i in range(4)), ("pixels", pa.bool_()), ("label", pa.string())]))
        for b in batches:
            yield pa.array([stated_regions(t) for t in b.to_pylist()], kind)

    return run(F.col(name))


def grounded_rects(replies: DataFrame, width: int, height: int, text: str = "text", key: str = "reply_id") -> DataFrame:
    """key, k, label, x0..y1: the regions of each reply in pixels; from whole JSON, or from complete boxes of a broken reply where that gives none."""
    said = replies.select(key, F.posexplode(stated_regions_column(text)).alias("k", "r")).select(key, "k", "r.*")
    whole = pixel_rects(said, width, height, absolute="pixels")
    left = replies.join(whole.select(key).distinct(), key, "left_anti")
    groups = [F.regexp_extract_all(F.col(text), F.lit(BOX), F.lit(i)) for i in range(1, 5)]
    rows = left.select(key, F.posexplode(F.arrays_zip(*(g.alias(f"g{i}") for i, g in enumerate(groups)), salvaged_labels(text).alias("label"))).alias("k", "b"))
    broken = rows.select(key, "k", *(F.col("b").getField(f"g{i}").cast("double").alias(f"a{i}") for i in range(4)), F.col("b.label").alias("label"))
    return whole.unionByName(pixel_rects(broken, width, height))


def fragments(text: str, opener: str) -> list[tuple[int, int, object]]:
    """(start, end, value) of the outermost whole JSON values that begin with ``opener``, from left to right."""
    decode, out, at = json.JSONDecoder().raw_decode, [], text.find(opener)
    while at >= 0:
        try:
            value, end = decode(text, at)
            out.append((at, end, value))
        except ValueError:
            end = at + 1
        at = text.find(opener, end)
    return out


def last_json(text: str | None, opener: str = "{"):
    """The last whole value that starts with ``opener`` and lies in no other, else None."""
    found = fragments(text or "", opener)
    return found[-1][2] if found else None


def json_column(name: str, opener: str):
    """An Arrow UDF text -> JSON text of ``last_json``."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = [last_json(t, opener) for t in b.to_pylist()]
            yield pa.array([None if v is None else json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in out], pa.string())

    return run(F.col(name))


def box_groups(text: str | None) -> list[tuple[list[float], str]]:
    """(box in 0..1000, label) of the fullest reading of a reply: arrays, objects line by line, or a group list."""
    def items(value) -> list:
        if isinstance(value, dict):
            inner = next((v for k in ("candidate_groups", "groups", "boxes", "regions") if isinstance(v := value.get(k), list)), None)
            return inner if inner is not None else [value]
        return value if isinstance(value, list) else []

    def box(item) -> tuple[list[float], str] | None:
        if not isinstance(item, dict):
            return None
        raw = item.get("bbox_2d") or item.get("bbox") or item.get("box")
        if not (isinstance(raw, list) and len(raw) == 4 and all(isinstance(v, int | float) and not isinstance(v, bool) for v in raw)):
            return None
        scale = 1000.0 if max(raw) <= 1.0 else 1.0
        x0, y0, x1, y1 = (float(v) * scale for v in raw)
        if not (0 <= x0 < x1 <= 1000 and 0 <= y0 < y1 <= 1000):
            return None
        return [x0, y0, x1, y1], str(item.get("label", ""))

    read = lambda values: [b for v in values for i in items(v) if (b := box(i))]
    text = text or ""
    lists, objects = fragments(text, "["), fragments(text, "{")
    arrays = [read([v]) for _, _, v in lists]
    top, k = [], 0
    for a, e, v in objects:  # both lists run from left to right
        while k < len(lists) and lists[k][1] < e:
            k += 1
        if k == len(lists) or lists[k][0] > a:
            top.append(v)
    return max([*arrays, read(top)], key=len, default=[])


def box_groups_column(name: str):
    """An Arrow UDF text -> array<struct<box, label>>."""

    @F.arrow_udf("array<struct<box:array<double>,label:string>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("box", pa.list_(pa.float64())), ("label", pa.string())]))
        for b in batches:
            yield pa.array([[{"box": x, "label": y} for x, y in box_groups(t)] for t in b.to_pylist()], kind)

    return run(F.col(name))
