"""Images and texts as files: encoded on executors, written to any store that pyarrow.fs reaches."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tectra.operators.per_image import grid
from tectra.sinks import formats


def encode_png(gray: np.ndarray) -> bytes:
    """8-bit gray or RGB (third axis) as PNG, rows unfiltered."""
    a = np.ascontiguousarray(gray, np.uint8)
    h, w = a.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encode_tiff(gray: np.ndarray) -> bytes:
    """8-bit gray as a baseline TIFF: little-endian, one uncompressed strip."""
    a = np.ascontiguousarray(gray, np.uint8)
    h, w = a.shape
    # Tag, type (3 short, 4 long) and value of each entry, by tag.
    tags = [(256, 4, w), (257, 4, h), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 0), (277, 3, 1), (278, 4, h), (279, 4, w * h)]
    start = 8 + 2 + 12 * len(tags) + 4
    entries = b"".join(struct.pack("<HHII", tag, kind, 1, start if tag == 273 else value) for tag, kind, value in tags)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + a.tobytes()


ENCODERS = {"png": encode_png, "tiff": encode_tiff, "jpeg": formats.encode_jpeg}


def encoded(px: DataFrame, kind: str = "png") -> DataFrame:
    """(image_id, height, width, data): one row an image of px (image_id, y, x, v).  Missing pixels are 0,
    values are cut to 0..255; an image takes one task's memory."""
    encode = ENCODERS[kind]

    def run(key, pdf):
        # Rows without a place have no pixel to set; a missing value is 0.
        pdf = pdf.dropna(subset=["y", "x"]).fillna({"v": 0}).astype({"y": int, "x": int})
        a = np.clip(grid(pdf), 0, 255) if len(pdf) else np.zeros((0, 0))
        return pd.DataFrame([(key[0], *a.shape, encode(a))] if a.size else [], columns=["image_id", "height", "width", "data"])

    named = px.select("image_id", "y", "x", "v")
    return named.groupBy("image_id").applyInPandas(run, f"image_id {named.schema['image_id'].dataType.simpleString()}, height int, width int, data binary")


def write_files(rows: DataFrame, path: str, name: Column, data: str = "data") -> DataFrame:
    """Writes data of every row to path/name and gives (name, bytes).  Files are written whole under
    another name and then moved, so that a task that is run again leaves no torn file.  path is a URI
    (file, s3, gs, hdfs) or a local path that all executors share."""
    uri = path if "://" in path else f"file://{path}"

    def run(batches):
        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        for batch in batches:
            sizes = []
            for file, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                body = body.encode() if isinstance(body, str) else body or b""
                with store.open_output_stream(f"{top}/{file}.part") as out:
                    out.write(body)
                store.move(f"{top}/{file}.part", f"{top}/{file}")
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return rows.select(name.cast("string").alias("name"), F.col(data).alias("data")).mapInArrow(run, "name string, bytes long")


def svg_document(paths: DataFrame, width: int, height: int) -> DataFrame:
    """(page, svg) of paths (page, line_id, path): one document a page, in order of line_id."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_id", "path"))), lambda p: F.concat(F.lit('<path fill="none" stroke="black" d="'), p["path"], F.lit('"/>')))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'
    return paths.groupBy("page").agg(F.concat(F.lit(head), F.array_join(lines, ""), F.lit("</svg>")).alias("svg"))


def svg_fitted(paths: DataFrame, width: int, height: int) -> DataFrame:
    """(page, svg) of paths (page, line_id, path of whole numbers): one document a page on white, its paths scaled to
    nine tenths of the room and centred; a page without extent is not scaled."""
    numbers = F.transform(F.regexp_extract_all("path", F.lit(r"-?[0-9]+"), F.lit(0)), lambda n: n.cast("int"))
    side = lambda odd: F.filter(numbers, lambda _, i: i % 2 == odd)
    held = paths.withColumns({"xs": side(0), "ys": side(1)})
    bounds = [f(g(c)).alias(n) for n, c, f, g in (("x0", "xs", F.min, F.array_min), ("x1", "xs", F.max, F.array_max), ("y0", "ys", F.min, F.array_min), ("y1", "ys", F.max, F.array_max))]
    page = held.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("line_id", "path"))).alias("lines"), *bounds)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    page = page.withColumn("k", F.when((w > 0) & (h > 0), F.least(F.lit(float(width)) / w, F.lit(float(height)) / h) * 0.9).otherwise(1.0))
    shift = lambda room, low, size: F.format_string("%.4f", (room - size * F.col("k")) / 2 - F.col(low) * F.col("k"))
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><rect width="100%" height="100%" fill="white"/><g transform="translate('
    drawn = F.array_join(F.transform("lines", lambda p: F.concat(F.lit('<path fill="none" stroke="black" stroke-width="0.5" d="'), p["path"], F.lit('"/>'))), "")
    return page.select("page", F.concat(F.lit(head), shift(width, "x0", w), F.lit(","), shift(height, "y0", h), F.lit(") scale("), F.format_string("%.4f", "k"), F.lit(')">'), drawn, F.lit("</g></svg>")).alias("svg"))
