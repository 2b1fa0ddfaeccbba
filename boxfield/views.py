"""Points, boxes, rectangles, images and replies derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pt_id, x, y, z in a room of 10 x 10.5 x 2.4 metres."""
    return table(spark, sf_dir, "lineitem").selectExpr("CAST(l_orderkey*10+l_linenumber AS BIGINT) pt_id", "l_quantity*0.2e0 x", "l_extendedprice/1e4 y", "l_discount*20e0+l_tax*5e0 z")


def gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with raw opacity, log scales, quaternion and colour coefficients."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_orderkey*10+l_linenumber AS BIGINT) pt_id", "l_quantity*0.2e0 x", "l_extendedprice/1e4 y", "l_discount*20e0+l_tax*5e0 z",
        "l_discount*60e0-2e0 raw_opacity", "l_tax*10e0-4e0 log_scale", "1e0+l_tax qw", "l_discount qx", "l_tax*2e0 qy", "0.5e0 qz", "l_quantity/25e0-1e0 f_dc",
    )


BOXES = [
    "s_suppkey box_id", "CAST(s_suppkey%10 AS DOUBLE)+0.5e0 cx", "CAST(CAST(floor(s_suppkey/10e0) AS BIGINT)%10 AS DOUBLE)+0.5e0 cy",
    "0.4e0+0.4e0*CAST(s_suppkey%4 AS DOUBLE) cz", "0.4e0+0.2e0*CAST(s_suppkey%5 AS DOUBLE) sl", "1.1e0 sw", "0.8e0+0.8e0*CAST(s_suppkey%4 AS DOUBLE) sh",
    "CAST(s_nationkey-12 AS DOUBLE)*0.05e0 yaw", "s_acctbal/1e4 score", "CASE s_suppkey%4 WHEN 0 THEN 'rack' WHEN 1 THEN 'ac' WHEN 2 THEN 'ups' ELSE 'unknown' END device_type",
    "CASE s_suppkey%3 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' ELSE 'high' END confidence", "CASE s_suppkey%5 WHEN 0 THEN 'coarse_seg' WHEN 1 THEN 'rule_fix' WHEN 2 THEN 'agent_fix' WHEN 3 THEN 'row_completion' ELSE 'manual' END source",
]


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*BOXES)


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes, shifted a little by their score."""
    return boxes(spark, sf_dir).withColumn("cx", F.expr("cx+(score-0.5e0)*0.2e0")).withColumn("cy", F.expr("cy-(score-0.5e0)*0.1e0"))


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image rectangles of 1280 x 1024 views with labels."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS BIGINT) view_id", "event_id rect_id", "value*2e0 x0", "CAST(event_id%37 AS DOUBLE)*20e0 y0",
        "value*2e0+40e0+CAST(event_id%7 AS DOUBLE) x1", "CAST(event_id%37 AS DOUBLE)*20e0+22e0 y1", "event_type label",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images: view_id, px, py, lum, depth, alpha, mask."""
    long = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return long.selectExpr(
        "vec_id view_id", "CAST(i%8 AS INT) px", "CAST(floor(i/8e0) AS INT) py", "CAST(e AS DOUBLE)+0.55e0 lum",
        "1.5e0+CAST(e AS DOUBLE) depth", "0.85e0+CAST(e AS DOUBLE)*0.5e0 alpha", "CAST(e AS DOUBLE)>0e0 mask",
    )


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model replies: fenced arrays, truncated arrays, prose, with quality lines."""
    box = "concat('{\"bbox_2d\": [', CAST(event_id%700 AS STRING), ', ', CAST(event_id%300 AS STRING), ', ', CAST(event_id%700+150 AS STRING), ', ', CAST(event_id%300+200 AS STRING), '], \"label\": \"', event_type, '\"}')"
    two = f"concat('Here it is: [', {box}, ', ', replace({box}, '[', '[1'), ']')"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id reply_id",
        f"CASE event_id%4 WHEN 0 THEN concat('```json\n[', {box}, ']\n```\nquality: poor') WHEN 1 THEN substring({two}, 1, 40 + CAST(event_id%90 AS INT)) WHEN 2 THEN {two} ELSE concat('nothing here, quality: ', CASE WHEN event_id%8=3 THEN 'good' ELSE 'no' END) END text",
    )
