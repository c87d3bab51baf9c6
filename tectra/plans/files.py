"""Plans that write files and read them back: images, georeferenced rasters, shapefiles, projects, documents."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tectra.operators import per_image as one
from tectra.operators import raster as ops
from tectra.plans import filters, sql, vectors
from tectra.plans import registry as base
from tectra.plans.registry import KEY, ORACLES, plan
from tectra.plans.thinning import _CANNY
from tectra.sinks import files, formats
from tectra.sources import rasters as src


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; a folder of the machine only where all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/tectra-files/{uuid.uuid4().hex}-{label}"


def save_images(px: DataFrame, path: str, name, kind: str = "png") -> DataFrame:
    """Writes every image of px to path under name (a column on image_id); gives (name, bytes)."""
    one.reachable(px.sparkSession)
    written = files.write_files(files.encoded(px, kind), path, name)
    return px.sparkSession.createDataFrame(written.collect(), written.schema)  # a row an image


def read_back(spark: SparkSession, path: str, pattern: str = "*.png") -> DataFrame:
    """(name, y, x, v) of all image files of a folder that can be read."""
    read = src.image_pixels(src.images(spark, path, pattern))
    return read.select(F.element_at(F.split("origin", "/"), -1).alias("name"), "y", "x", F.col("b").alias("v"))


def _named(suffix: str = "", kind: str = "png"):
    return F.concat(F.lit("image"), F.col("image_id").cast("string"), F.lit(f"{suffix}.{kind}"))


def _id():
    return F.regexp_extract("name", "image([0-9]+)", 1).cast("long").alias("image_id")


@plan(f"WITH {sql.U8} SELECT image_id, y, x, v FROM u8")
def png_round_trip(spark, sf):
    """Images to PNG files and back, from a folder with another file and a broken one."""
    path = scratch(spark, "png")
    save_images(base._u8(spark, sf), path, _named())
    junk = spark.createDataFrame([("broken.png", b"no image"), ("notes.txt", b"text")], "name string, data binary")
    files.write_files(junk, path, F.col("name")).collect()
    return read_back(spark, path).select(_id(), "y", "x", "v")


@plan(f"WITH {sql.U8}, z AS (SELECT image_id, count(*) AS n FROM u8 GROUP BY 1) SELECT image_id, n AS pixels, true AS close FROM z")
def jpeg_export(spark, sf):
    """JPEG files of quality 90, decoded again: the mean difference is below 4, none above 40."""
    path = scratch(spark, "jpg")
    px = base._u8(spark, sf)
    save_images(px, path, _named(kind="jpg"), "jpeg")
    back = read_back(spark, path, "*.jpg").select(_id(), "y", "x", F.col("v").alias("w"))
    off = F.abs(F.col("v") - F.col("w"))
    return px.join(back, KEY).groupBy("image_id").agg(F.count(F.lit(1)).alias("pixels"), ((F.avg(off) < 4) & (F.max(off) <= 40)).alias("close"))


@plan(f"""WITH RECURSIVE {_CANNY}, {filters._SOBEL_ABS.removeprefix(sql.SOBEL).lstrip(' ,')}, f AS (SELECT 'Canny' AS filter, image_id, y, x, v * 255 AS v FROM edge UNION ALL SELECT 'Sobel', image_id, y, x, v FROM sobel_c)
    SELECT 'image' || image_id || '_' || filter || '.png' AS name, CAST(max(y) + 1 AS INTEGER) AS height, CAST(max(x) + 1 AS INTEGER) AS width, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 67 + x * 31)) AS BIGINT) AS placed FROM f GROUP BY filter, image_id""")
def batch_outputs(spark, sf):
    """The batch over files: read images from a folder, apply each filter, write <base>_<Filter>.png, read those."""
    source, path = scratch(spark, "batch-in"), scratch(spark, "batch-out")
    save_images(base._u8(spark, sf), source, _named())
    px = read_back(spark, source).select(_id(), "y", "x", "v").repartition("image_id")
    hits = base._hysteresis(ops.canny_flags(px, 50, 150))
    sat = lambda c: F.least(F.lit(255), F.abs(c))
    sobel = ops.sobel(px).select(*KEY, F.least(F.lit(255.0), F.rint(F.lit(0.5) * sat("gx") + F.lit(0.5) * sat("gy"))).cast("int").alias("v"))
    for kind, found in (("Canny", filters.on_grid(px, hits).withColumn("v", F.col("v") * 255)), ("Sobel", sobel)):
        save_images(found, path, _named(f"_{kind}"))
    placed = F.sum(F.col("v") * (F.col("y") * 67 + F.col("x") * 31)).alias("placed")
    return read_back(spark, path).groupBy("name").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sum("v").alias("total"), placed)


@plan(f"WITH {sql.U8}, {base._resize_sql(256, 256)} SELECT image_id, y, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * x) AS BIGINT) AS placed FROM resized GROUP BY 1, 2")
def load_images(spark, sf):
    """The load chain: decode, gray, normalise, resize to 256 by 256; sums of its rows."""
    path = scratch(spark, "load")
    save_images(base._u8(spark, sf), path, _named())
    px = read_back(spark, path).select(_id(), "y", "x", F.col("v").cast("double").alias("v")).repartition("image_id")
    return ops.resize(src.u8(px), 256, 256).groupBy("image_id", "y").agg(F.sum("v").alias("total"), F.sum(F.col("v") * F.col("x")).alias("placed"))


_INVERSE = f"WITH {filters._SOBEL_ABS} SELECT image_id, y, x, CASE WHEN v > 0 THEN 0 ELSE 255 END AS v FROM sobel_c"


@plan(_INVERSE)
def save_mask(spark, sf):
    """The mask dialog: gradient, inverse threshold at 0, PNG files; read back."""
    path = scratch(spark, "mask")
    mask = base.sobel_mag_abs(spark, sf).select(*KEY, F.when(F.col("v") > 0, 0).otherwise(255).alias("v"))
    save_images(mask, path, _named("_mask"))
    return read_back(spark, path).select(_id(), "y", "x", "v")


#: Pixel sizes, corner and system of the georeferenced examples.
_DX, _DY, _LEFT, _TOP, _EPSG = 30.0, -30.0, 500000.0, 4600000.0, 32633


@plan(f"WITH {sql.U8}, {base._resize_sql(32, 16)}, z AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w FROM u8 GROUP BY 1) SELECT image_id, y, x, v, {_DX}::DOUBLE * w / 16 AS dx, {_DY}::DOUBLE * h / 32 AS dy, {_LEFT}::DOUBLE AS left_, {_TOP}::DOUBLE AS top_, {_EPSG} AS epsg FROM resized JOIN z USING (image_id)")
def geotiff_round_trip(spark, sf):
    """Resized images as GeoTIFF files, with the transform of the new pixel size, and back."""
    path = scratch(spark, "tif")
    px = base._u8(spark, sf)
    size = px.groupBy("image_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    small = ops.resize(px, 32, 16).join(size, "image_id")

    def encode(key, pdf):
        data = formats.encode_geotiff(one.grid(pdf), (_DX * int(pdf["w"].iloc[0]) / 16, 0.0, _LEFT, 0.0, _DY * int(pdf["h"].iloc[0]) / 32, _TOP), _EPSG)
        return pd.DataFrame({"name": [f"image{key[0]}.tif"], "data": [data]})

    one.reachable(spark)
    files.write_files(small.groupBy("image_id").applyInPandas(encode, "name string, data binary"), path, F.col("name")).collect()
    return read_geotiffs(spark, path).select(_id(), "y", "x", "v", "dx", "dy", "left_", "top_", "epsg")


def read_geotiffs(spark: SparkSession, path: str, pattern: str = "*.tif") -> DataFrame:
    """(name, y, x, v, dx, dy, left_, top_, epsg): the first band of all TIFF files that can be read; what a file
    does not say is null."""
    one.reachable(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def decode(pdfs):
        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    a, t, epsg = formats.decode_tiff(bytes(data))
                except (ValueError, KeyError):
                    continue
                y, x = np.indices(a.shape)
                t = t or (None,) * 6
                yield pd.DataFrame({"name": name.rsplit("/", 1)[-1], "y": y.ravel(), "x": x.ravel(), "v": a.ravel(), "dx": t[0], "dy": t[4], "left_": t[2], "top_": t[5], "epsg": epsg})

    return found.mapInPandas(decode, "name string, y int, x int, v int, dx double, dy double, left_ double, top_ double, epsg int")


@plan(f"WITH RECURSIVE {vectors._LINES} SELECT line.g AS image_id, CAST(dense_rank() OVER (PARTITION BY line.g ORDER BY line.b) AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY line ORDER BY i) - 1 AS INTEGER) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM line_ JOIN lines USING (line)")
def shapefile_round_trip(spark, sf):
    """Filter, binarise, contours, simplified lines, shapefiles (shp, shx, dbf, prj); the shp files read back."""
    path = scratch(spark, "shp")

    def encode(key, pdf):
        rows = [[tuple(map(float, p.split())) for p in line.split(", ")] for line in pdf.sort_values("border")["path"]]
        made = formats.encode_shapefile(rows, 'LOCAL_CS["pixels"]')
        return pd.DataFrame({"name": [f"image{key[0]}.{k}" for k in made], "data": list(made.values())})

    lines = vectors.raster_lines(base._bin(spark, sf)).select("image_id", "border", "path")
    files.write_files(lines.groupBy("image_id").applyInPandas(encode, "name string, data binary"), path, F.col("name")).collect()
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.shp").load(path).select("path", "content")

    def decode(pdfs):
        for pdf in pdfs:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(name.rsplit("/", 1)[-1], k, i, x, y) for k, line in enumerate(formats.decode_shapefile(bytes(data)), 1) for i, (x, y) in enumerate(line)]
                yield pd.DataFrame(rows, columns=["name", "line_no", "i", "x", "y"])

    return found.mapInPandas(decode, "name string, line_no int, i int, x double, y double").select(_id(), "line_no", "i", "x", "y")


#: A project's folder: a table (a folder) for each part, one row a line of an image.
_PARTS = ("image", "mask", "filtered_image")
_SAVED = "image_id long, y int, x array<int>, v array<int>, part string"


def save_project(px: DataFrame, path: str) -> None:
    """Writes px (image_id, y, x and a whole number for each part) as a project; one pass makes all its tables."""
    row = ops.lines(px)
    parts = F.array(*(F.struct(F.lit(p).alias("part"), F.col(f"cells.{p}").alias("v")) for p in _PARTS))
    row.select("image_id", "y", "cells.x", F.explode(parts).alias("t")).select("image_id", "y", "x", "t.v", "t.part").write.partitionBy("part").parquet(path)


def open_project(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, image, mask, filtered_image) of a project.  Lines are joined, not pixels, and never by a
    broadcast: Spark would decide on one by the size of the files, which pixels exceed a hundredfold in memory."""
    saved = spark.read.schema(_SAVED).parquet(path)
    image, *rest = (saved.filter(F.col("part") == p).select("image_id", "y", F.col("x").alias(f"x_{p}"), F.col("v").alias(p)) for p in _PARTS)
    for part in rest:
        image = image.join(part.hint("merge"), ["image_id", "y"])
    same = reduce(Column.__and__, (F.col(f"x_{_PARTS[0]}") == F.col(f"x_{p}") for p in _PARTS[1:]))
    places = F.when(same, F.col(f"x_{_PARTS[0]}")).otherwise(F.raise_error(F.lit("a project's tables have different pixels")).cast("array<int>"))
    return image.withColumn("x", places).select("image_id", "y", F.inline(F.arrays_zip("x", *_PARTS)))


@plan(f"WITH {filters._SOBEL_ABS} SELECT u.image_id, u.y, u.x, u.v AS image, CASE WHEN u.v > 128 THEN 1 ELSE 0 END AS mask, s.v AS filtered FROM u8 u JOIN sobel_c s ON s.image_id = u.image_id AND s.y = u.y AND s.x = u.x")
def project_round_trip(spark, sf):
    """A project (image, mask and filtered image) saved as a folder of tables and opened again."""
    path = scratch(spark, "project")
    px = ops.sobel(base._u8(spark, sf))
    save_project(px.select(*KEY, F.col("v").alias("image"), F.when(F.col("v") > 128, 1).otherwise(0).alias("mask"), base._blend().alias("filtered_image")), path)
    return open_project(spark, path).withColumnRenamed("filtered_image", "filtered")


_PATHS = ORACLES["contour_paths"]


@plan(f"""WITH paths AS ({_PATHS}), pt AS (SELECT image_id, border, path, unnest(regexp_extract_all(path, '(-?[0-9]+) (-?[0-9]+)', 1)) AS x, unnest(regexp_extract_all(path, '(-?[0-9]+) (-?[0-9]+)', 2)) AS y FROM paths),
    box AS (SELECT image_id, min(CAST(x AS INTEGER)) AS x0, max(CAST(x AS INTEGER)) AS x1, min(CAST(y AS INTEGER)) AS y0, max(CAST(y AS INTEGER)) AS y1 FROM pt GROUP BY 1),
    fit AS (SELECT *, CASE WHEN x1 > x0 AND y1 > y0 THEN least(640.0::DOUBLE / (x1 - x0), 480.0::DOUBLE / (y1 - y0)) * 0.9::DOUBLE ELSE 1.0::DOUBLE END AS k FROM box)
    SELECT image_id, '<svg xmlns="http://www.w3.org/2000/svg" width="640" height="480"><rect width="100%" height="100%" fill="white"/><g transform="translate(' || printf('%.4f', (640 - (x1 - x0) * k) / 2 - x0 * k) || ',' || printf('%.4f', (480 - (y1 - y0) * k) / 2 - y0 * k) || ') scale(' || printf('%.4f', k) || ')">'
        || string_agg('<path fill="none" stroke="black" stroke-width="0.5" d="' || path || '"/>', '' ORDER BY border) || '</g></svg>' AS svg FROM paths JOIN fit USING (image_id) GROUP BY image_id, x0, x1, y0, y1, k""")
def svg_documents(spark, sf):
    """One document an image: its contours, scaled to nine tenths of the page and centred."""
    return files.svg_fitted(vectors.contour_paths(spark, sf).withColumnRenamed("image_id", "page").withColumnRenamed("border", "line_id"), 640, 480).withColumnRenamed("page", "image_id")
