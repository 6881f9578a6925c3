"""Zarr v2 stores with one-dimensional arrays, read with the standard library and zstandard.

Chunks are files of their own: the driver reads the small metadata, and tasks
decode the chunks that Spark's binary reader hands them.
"""

from __future__ import annotations

import gzip
import json
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def _decoded(raw: bytes, codec: dict | None) -> bytes:
    kind = (codec or {}).get("id")
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    if kind == "gzip":
        return gzip.decompress(raw)
    if kind == "zlib":
        return zlib.decompress(raw)
    if kind is None:
        return raw
    raise ValueError(f"codec {kind} is not supported")


def _text(spark: SparkSession, path: str) -> str:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]).decode()


def array(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, value)`` of a one-dimensional array."""
    meta = json.loads(_text(spark, f"{path}/.zarray"))
    n, size, kind, codec = meta["shape"][0], meta["chunks"][0], np.dtype(meta["dtype"]), meta.get("compressor")
    out = "double" if kind.kind == "f" else "long"

    def run(parts):
        for part in parts:
            for name, raw in zip(part["path"], part["content"], strict=True):
                k = int(name.rsplit("/", 1)[1])
                data = np.frombuffer(_decoded(bytes(raw), codec), kind)[: max(0, n - k * size)]
                import pandas as pd

                yield pd.DataFrame({"pos": np.arange(len(data)) + k * size, "value": data.astype("float64" if out == "double" else "int64")})

    chunks = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9]*").load(path).select("path", "content")
    return chunks.mapInPandas(run, f"pos long, value {out}")


def names(spark: SparkSession, path: str) -> list[str]:
    """A string array kept as one JSON or vlen-utf8 chunk set."""
    meta = json.loads(_text(spark, f"{path}/.zarray"))
    n, size = meta["shape"][0], meta["chunks"][0]
    out: list[str] = []
    for k in range(-(-n // size)):
        raw = _decoded(bytes(spark.read.format("binaryFile").load(f"{path}/{k}").select("content").first()[0]), meta.get("compressor"))
        count, at = int.from_bytes(raw[:4], "little"), 4
        for _ in range(count):
            length = int.from_bytes(raw[at : at + 4], "little")
            out.append(raw[at + 4 : at + 4 + length].decode())
            at += 4 + length
    return out[:n]


def read_zarr(spark: SparkSession, path: str) -> SparseMatrix:
    """A matrix of ``by_column/{data,indices,indptr}``; columns find their entries by the row pointer, an interval join on position."""
    attrs = json.loads(_text(spark, f"{path}/.zattrs"))
    vals, rows = array(spark, f"{path}/by_column/data"), array(spark, f"{path}/by_column/indices")
    ptr = array(spark, f"{path}/by_column/indptr")
    nxt = ptr.select((F.col("pos") - 1).alias("pos"), F.col("value").alias("stop"))
    spans = ptr.join(nxt, "pos").filter("stop > value").select(F.col("pos").alias("col_id"), F.explode(F.sequence(F.col("value"), F.col("stop") - 1)).alias("pos"))
    e = spans.join(vals.withColumnRenamed("value", "val"), "pos").join(rows.withColumnRenamed("value", "row_id"), "pos").select("row_id", "col_id", "val")
    axis = lambda n, key, label: spark.range(n).select(F.col("id").alias(key), F.col("id").cast("string").alias(label))
    return SparseMatrix(e, axis(attrs["nrow"], "row_id", "row_name"), axis(attrs["ncol"], "col_id", "col_name"), {"producer": "zarr"})
