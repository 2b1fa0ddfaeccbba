"""python -m boxfield run --points PATH --out PATH [--rects PATH] [--truth PATH] [--mesh] [--denoise]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import layout_plan
from .sources import layouts, ply


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="boxfield")
    command = parser.add_subparsers(dest="command", required=True).add_parser("run", help="fit and judge a layout")
    command.add_argument("--points", required=True, help="folder of .ply, .pcd or .npy files, or a Parquet table")
    command.add_argument("--out", required=True)
    command.add_argument("--rects", help="Parquet table of rectangles: rect_id, x0, y0, x1, y1")
    command.add_argument("--truth", help="layout file with true boxes")
    command.add_argument("--mesh", action="store_true")
    command.add_argument("--denoise", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("boxfield").getOrCreate()
    points = spark.read.parquet(a.points) if a.points.endswith(".parquet") else ply.read_points(spark, a.points)
    rects = (lambda _: spark.read.parquet(a.rects)) if a.rects else None
    truth = layouts.read_layout(spark, a.truth) if a.truth else None
    result = layout_plan.run(points, rects, truth, layout_plan.Options(denoise=a.denoise, mesh=a.mesh))
    layout_plan.write(result, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
