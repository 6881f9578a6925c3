"""Shared helpers of the training-data operators; durable tables and lookups of hot keys come from the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import looked_up, perhaps_in, run_dir, stored, width

__all__ = ["WS", "ascii_lower", "held_out", "looked_up", "perhaps_in", "run_dir", "stored", "table", "width"]

#: ASCII white space, the word separators of the word-level contracts.
WS = r"\x20\x09-\x0D"

def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
