"""Box records: JSON layouts read and written, names for output, a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import corners, frame_rect

SCHEMA = "box_id bigint, cx double, cy double, cz double, sl double, sw double, sh double, yaw double, score double, device_type string, confidence string, source string"
DEFAULTS = {"yaw": 0.0, "score": 0.5, "device_type": "unknown", "confidence": "mid", "source": "coarse_seg"}
OBJECT = "name:string,centroid:struct<x:double,y:double,z:double>,dimensions:struct<length:double,width:double,height:double>,matrix:array<array<double>>,rotations:struct<x:double,y:double,z:double>"


def to_json(boxes: DataFrame) -> DataFrame:
    """value: one JSON object for each box."""
    return boxes.select(F.to_json(F.struct(*boxes.columns)).alias("value"))


def boxes_from_json(lines: DataFrame) -> DataFrame:
    """Boxes from JSON objects; missing fields get their defaults."""
    b = lines.select(F.from_json("value", SCHEMA).alias("b")).select("b.*")
    return b.select(*(F.coalesce(c, F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in b.columns))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """file and boxes of layout files: lists of boxes, or a detector's {"objects": [...]}, numbered from 0 in each file."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    listed = F.ltrim("value").startswith("[")
    found = raw.where(~listed).select("file", F.posexplode(F.from_json(F.get_json_object("value", "$.objects"), f"array<struct<{OBJECT}>>")).alias("k", "o")).select("file", F.col("k").cast("bigint").alias("box_id"), "o.*")
    detected = boxes_from_objects(found.withColumn("__key", F.struct("file", "box_id")), "__key").select("__key.*", "*").drop("__key")
    fields = ", ".join(":".join(x.split(" ")) for x in SCHEMA.split(", "))
    rows = raw.where(listed).select("file", F.explode(F.from_json("value", f"array<struct<{fields}>>")).alias("b")).select("file", "b.*")
    plain = rows.select(*(F.coalesce(c, F.lit(DEFAULTS[c])).alias(c) if c in DEFAULTS else F.col(c) for c in rows.columns))
    return plain.unionByName(detected, allowMissingColumns=True)


def layout_document(boxes: DataFrame) -> DataFrame:
    """value: one JSON array of all boxes by id; a layout is a few hundred boxes."""
    rows = boxes.select("box_id", F.struct(*boxes.columns).alias("b")).agg(F.array_sort(F.collect_list(F.struct("box_id", "b"))).alias("all"))
    return rows.select(F.to_json(F.col("all.b")).alias("value"))


def save_layout(boxes: DataFrame, path: str) -> None:
    layout_document(boxes).coalesce(1).write.mode("overwrite").text(path)


#: What a model's decision states.
VERDICT = "action string, params map<string,double>, confidence double, detail string, raw string, picture string"


def rounded_metrics(metrics: DataFrame, places: int = 4) -> DataFrame:
    """One row of metrics with fractions rounded half to even."""
    return metrics.select(*(F.bround(c, places).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes))


def metrics_line(metrics: DataFrame) -> DataFrame:
    """summary: one line of text."""
    return metrics.select(F.format_string("matched %d of %d true and %d found boxes; recall %.3f, precision %.3f, edges within limit %.3f, mean error %.4f m, p90 %.4f m", "n_matched", "n_gt", "n_pred", "recall", "precision", "edge_accuracy", "mean_edge_error_m", "p90_edge_error_m").alias("summary"))


def agent_report(unresolved: DataFrame, actions: DataFrame, performance: DataFrame) -> DataFrame:
    """value: one JSON object with the boxes left open, the actions taken (a few for each box) and seconds by stage (stage, seconds)."""
    listed = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    parts = listed(unresolved, "unresolved").crossJoin(listed(actions, "actions_taken")).crossJoin(performance.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "seconds")))).alias("performance")))  # one row each
    return parts.select(F.to_json(F.struct("unresolved", "actions_taken", "performance")).alias("value"))


def device_type(name: Column) -> Column:
    """Device type by what a name contains."""
    low = F.lower(name)
    return F.when(low.contains("crac") | low.contains("ac"), F.when(low.contains("rack"), "rack").otherwise("ac")).when(low.contains("rack") | low.contains("cabinet"), "rack").when(low.contains("ups"), "ups").otherwise("unknown")


def objects_of(boxes: DataFrame) -> DataFrame:
    """Boxes as a detector states them: centroid, dimensions and rotation matrix."""
    matrix = F.array(F.array(F.cos("yaw"), -F.sin("yaw"), F.lit(0.0)), F.array(F.sin("yaw"), F.cos("yaw"), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    return boxes.select(
        "box_id", F.concat(F.col("device_type"), F.lit("_"), F.col("box_id").cast("string")).alias("name"), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).alias("centroid"),
        F.struct(F.col("sl").alias("length"), F.col("sw").alias("width"), F.col("sh").alias("height")).alias("dimensions"), matrix.alias("matrix"), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.degrees("yaw").alias("z")).alias("rotations"),
    )


def boxes_from_objects(objects: DataFrame, key: str) -> DataFrame:
    """Boxes from detector objects; the direction comes from the matrix, else from the rotation about z."""
    yaw = F.coalesce(F.atan2(F.col("matrix")[1][0], F.col("matrix")[0][0]), F.radians("rotations.z"), F.lit(0.0))
    return objects.select(
        key, F.col("centroid.x").alias("cx"), F.col("centroid.y").alias("cy"), F.col("centroid.z").alias("cz"), F.col("dimensions.length").alias("sl"), F.col("dimensions.width").alias("sw"), F.col("dimensions.height").alias("sh"),
        yaw.alias("yaw"), device_type(F.col("name")).alias("device_type"), F.lit("mid").alias("confidence"), F.lit("coarse_seg").alias("source"), F.lit(0.5).alias("score"),
    )


def output_names(boxes: DataFrame, name: Column) -> DataFrame:
    """boxes with name: repeats get _2, _3 in order of box_id; a number that another box has as its own name is passed over."""
    base = boxes.withColumn("__base", F.coalesce(name, F.lit("rack")))
    order = Window.partitionBy("__base").orderBy("box_id")
    numbered = base.withColumn("__rn", F.row_number().over(order))
    taken = base.select(F.regexp_extract("__base", "^(.*)_([0-9]+)$", 1).alias("b"), F.regexp_extract("__base", "^(.*)_([0-9]+)$", 2).alias("n")).where("b <> ''").distinct()
    used = taken.groupBy("b").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("__used"))
    out = numbered.join(used.withColumnRenamed("b", "__base"), "__base", "left")
    shifted = F.aggregate(F.coalesce("__used", F.array().cast("array<int>")), F.col("__rn"), lambda acc, u: F.when((u >= 2) & (u <= acc), acc + 1).otherwise(acc))
    number = F.when(F.col("__rn") > 1, shifted).otherwise(1)
    return out.withColumn("name", F.when(number > 1, F.concat("__base", F.lit("_"), number.cast("string"))).otherwise(F.col("__base"))).drop("__base", "__rn", "__used")


COLOURS = {"high": "#2e9e4f", "mid": "#d9a400", "low": "#cc3333"}


def svg(boxes: DataFrame, title: str = "layout", margin: float = 0.4, scale: float = 220.0) -> DataFrame:
    """One row svg: a polygon and a label for each box, y upwards, coloured by confidence; boxes in order of id."""
    rect = [v.alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), frame_rect())]
    xy = corners()
    flat = boxes.select("box_id", "device_type", "confidence", "cx", "cy", *rect, F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in xy)).alias("c"))
    area = flat.agg(F.min("x0").alias("ax"), F.max("y1").alias("ay"), F.max("x1").alias("bx"), F.min("y0").alias("by"))
    px = lambda x: F.round((x - F.col("ax") + margin) * scale, 1)
    py = lambda y: F.round((F.col("ay") + margin - y) * scale, 1)
    pts = F.array_join(F.transform("c", lambda p: F.concat(px(p["x"]).cast("string"), F.lit(","), py(p["y"]).cast("string"))), " ")
    colour = F.when(F.col("confidence") == "high", COLOURS["high"]).when(F.col("confidence") == "mid", COLOURS["mid"]).otherwise(COLOURS["low"])
    shape = F.format_string('<polygon points="%s" fill="none" stroke="%s"/><text x="%s" y="%s">%s</text>', pts, colour, px(F.col("cx")).cast("string"), py(F.col("cy")).cast("string"), F.concat_ws(" ", "device_type", F.col("box_id").cast("string")))
    body = flat.crossJoin(F.broadcast(area)).select("box_id", shape.alias("s"), *("ax", "ay", "bx", "by"))
    one = body.agg(F.array_sort(F.collect_list(F.struct("box_id", "s"))).alias("all"), *(F.max(c).alias(c) for c in ("ax", "ay", "bx", "by")))
    head = F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%s" height="%s"><title>%s</title>', F.round((F.col("bx") - F.col("ax") + 2 * margin) * scale, 1).cast("string"), F.round((F.col("ay") - F.col("by") + 2 * margin) * scale, 1).cast("string"), F.lit(title))
    return one.select(F.concat(head, F.array_join(F.transform("all", lambda x: x["s"]), ""), F.lit("</svg>")).alias("svg"))
