"""Selection of rows and columns: by index, name, prefix, pattern or mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..matrix import MatrixError, SparseMatrix
from ..plans.storage import stored


def parse_indices(spec: str, n: int) -> list[int]:
    """``"0,2,5"`` or ``"1-10"`` (both ends in), clipped to ``n``; nothing left is an error."""
    out: list[int] = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        m = re.fullmatch(r"(\d+)(?:-(\d+))?", part)
        if not m:
            raise MatrixError(f"not an index: {part}")
        a, b = int(m[1]), int(m[2] or m[1])
        out += [i for i in range(a, min(b, n - 1) + 1)]
    if not out:
        raise MatrixError(f"{spec!r} selects none of {n}")
    return out


def selection(spark: SparkSession, ids: list[int], key: str) -> DataFrame:
    """``(pos, key)`` of an ordered list of ids."""
    return spark.createDataFrame(list(enumerate(ids)), f"pos long, {key} long")


def read_columns(m: SparseMatrix, picked: DataFrame) -> DataFrame:
    """``(row_id, pos, val)`` of ``picked(pos, col_id)``; repeats are allowed."""
    return m.entries.join(picked, "col_id").select("row_id", "pos", "val")


def read_rows(m: SparseMatrix, picked: DataFrame) -> DataFrame:
    """``(pos, col_id, val)`` of ``picked(pos, row_id)``; repeats are allowed."""
    return m.entries.join(picked, "row_id").select("pos", "col_id", "val")


def read_column(m: SparseMatrix, col_id: int) -> DataFrame:
    return m.entries.filter(F.col("col_id") == col_id).select("row_id", "val")


def dense_columns(m: SparseMatrix, picked: DataFrame) -> DataFrame:
    """``(row_id, pos, val)`` of every row and picked column, zeros included; ``picked`` is a stated list."""
    frame = m.features.select("row_id").crossJoin(F.broadcast(picked))
    return frame.join(m.entries.join(F.broadcast(picked.select("col_id").distinct()), "col_id", "left_semi"), ["row_id", "col_id"], "left").select("row_id", "pos", F.coalesce("val", F.lit(0.0)).alias("val"))


def dense_rows(m: SparseMatrix, picked: DataFrame) -> DataFrame:
    """``(col_id, pos, val)`` of every column and picked row, zeros included."""
    frame = m.cells.select("col_id").crossJoin(F.broadcast(picked))
    return frame.join(m.entries.join(F.broadcast(picked.select("row_id").distinct()), "row_id", "left_semi"), ["col_id", "row_id"], "left").select("col_id", "pos", F.coalesce("val", F.lit(0.0)).alias("val"))


def pivoted(long: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A wide table with a column for each position of a stated list."""
    wide = long.groupBy(key).pivot("pos", list(range(len(names)))).agg(F.first("val"))
    return wide.withColumnsRenamed({str(i): n for i, n in enumerate(names)})


def dense_arrays(m: SparseMatrix) -> DataFrame:
    """``(col_id, row_ids, vals)``: each column's entries as sorted arrays."""
    packed = m.entries.groupBy("col_id").agg(F.sort_array(F.collect_list(F.struct("row_id", "val"))).alias("e"))
    return packed.select("col_id", F.transform("e", lambda x: x["row_id"]).alias("row_ids"), F.transform("e", lambda x: x["val"]).alias("vals"))


def name_matches(name: Column, pattern: str) -> Column:
    """A case-insensitive search."""
    return name.rlike(f"(?i){pattern}")


def substring_matches(df: DataFrame, name: str, queries: list[str]) -> DataFrame:
    """``df`` with ``rank``: rows whose name contains a query, each once, at the first that reaches it; none is an error for the caller."""
    asked = [q for q in queries if q.strip()]
    rank = F.coalesce(*[F.when(F.lower(F.col(name)).contains(q.lower()), F.lit(i)) for i, q in enumerate(asked)]) if asked else F.lit(None).cast("int")
    return df.withColumn("rank", rank).filter("rank is not null")


def membership_matches(df: DataFrame, name: str, asked: DataFrame, delimiter: str = "@") -> DataFrame:
    """``(query, <key columns>, tier)``: exact name, else the name before the delimiter, else one a prefix of the other.

    Tiers exact and base are equi-joins; prefixes are looked up only for names
    of the queries that neither of them reached.
    """
    base = lambda c: F.substring_index(c, delimiter, 1)
    exact = df.join(asked, F.col(name) == F.col("query")).withColumn("tier", F.lit(0))
    rest = asked.join(exact.select("query").distinct(), "query", "left_anti")
    by_base = df.join(rest.withColumn("_b", base(F.col("query"))), base(F.col(name)) == F.col("_b")).drop("_b").withColumn("tier", F.lit(1))
    last = rest.join(by_base.select("query").distinct(), "query", "left_anti")
    # Every prefix of one side with a length that the other side has.
    cut = lambda rows, c, lengths: rows.crossJoin(F.broadcast(lengths)).withColumn("_p", F.explode(F.filter(F.transform("_l", lambda n: F.when(n <= F.length(c), F.left(c, n))), lambda p: p.isNotNull())))
    lengths = lambda rows, c: rows.agg(F.collect_set(F.length(c)).alias("_l"))
    down = cut(df, name, lengths(last, "query")).join(last, F.col("_p") == F.col("query"))
    up = cut(last, "query", lengths(df, name)).join(df, F.col("_p") == F.col(name))
    by_prefix = down.unionByName(up).drop("_p", "_l").withColumn("tier", F.lit(2))
    return exact.unionByName(by_base).unionByName(by_prefix)


def _counted(picked: DataFrame, axis: DataFrame, key: str) -> None:
    rows = picked.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).first()
    if not rows.n:
        raise MatrixError("the selection is empty")
    if rows.d < rows.n:
        raise MatrixError("the selection repeats an index")
    if missing := picked.join(axis, key, "left_anti").first():
        raise MatrixError(f"{missing[key]} is out of range")


def subset_columns(m: SparseMatrix, picked: DataFrame, check: bool = True) -> SparseMatrix:
    """Columns of ``picked(pos, col_id)``, renumbered by ``pos``; empty, repeated or unknown ones are refused."""
    if check:
        _counted(picked, m.cells.select("col_id"), "col_id")
    cells = m.cells.join(picked, "col_id").drop("col_id").withColumnRenamed("pos", "col_id")
    return m.with_(entries=m.entries.join(picked, "col_id").select("row_id", F.col("pos").alias("col_id"), "val"), cells=cells)


def subset_rows(m: SparseMatrix, picked: DataFrame, check: bool = True) -> SparseMatrix:
    """Rows of ``picked(pos, row_id)``, renumbered by ``pos``."""
    return subset_columns(m.transposed(), picked.withColumnRenamed("row_id", "col_id"), check).transposed()


def keep_columns(m: SparseMatrix, kept: DataFrame) -> SparseMatrix:
    """Columns of ``kept(col_id)`` with their ids: a mask."""
    k = kept.select("col_id").distinct()
    return m.with_(entries=m.entries.join(k, "col_id", "left_semi"), cells=m.cells.join(k, "col_id", "left_semi"))


def keep_rows(m: SparseMatrix, kept: DataFrame) -> SparseMatrix:
    k = kept.select("row_id").distinct()
    return m.with_(entries=m.entries.join(k, "row_id", "left_semi"), features=m.features.join(k, "row_id", "left_semi"))


def keep_sides(kept: DataFrame, key: str, *sides: DataFrame) -> list[DataFrame]:
    """Side tables of an axis under its mask ``kept(key)``: each keeps its own columns and repeated rows."""
    k = kept.select(key).distinct()
    return [s.join(k, key, "left_semi") for s in sides]


def dense_ids(axis: DataFrame, key: str) -> DataFrame:
    """``(key, pos)``: ids 0, 1, ... in order of the old ones.

    Numbered in ranges: counts of ranges are summed up, no range meets another.
    """
    # Stored, since ranges must be the same wherever they are read.
    ranged = stored(axis.select(key).repartitionByRange(F.col(key)).withColumn("_part", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_part").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).drop("n")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_part").select(key, (F.col("_in") + F.col("before")).cast("long").alias("pos"))


def reorder_rows(m: SparseMatrix, order: DataFrame) -> SparseMatrix:
    """Row ``pos`` becomes the row named ``order(pos, row_name)``; unknown names give empty rows, unlisted rows go, a repeated name is refused."""
    if order.groupBy("row_name").count().filter("count > 1").first():
        raise MatrixError("a row is listed twice")
    to = order.join(m.features.select("row_name", "row_id"), "row_name", "left")
    entries = m.entries.join(to.filter("row_id is not null"), "row_id").select(F.col("pos").alias("row_id"), "col_id", "val")
    return m.with_(entries=entries, features=order.select(F.col("pos").alias("row_id"), "row_name"))


def scaled(m: SparseMatrix) -> DataFrame:
    """Entries divided by the ``scale`` of their column."""
    return m.entries.join(m.cells.select("col_id", "scale"), "col_id").select("row_id", "col_id", (F.col("val") / F.col("scale")).alias("val"))


def running(df: DataFrame, keys: list[str], order: list[str], count: Column | None = None) -> DataFrame:
    """``df`` with ``_n``: the sum of ``count`` (1 a row) over the rows of its keys up to and with its own, in order.

    Ranges of keys and order are summed on their own, so a key may be in any number of tasks. What comes before
    a range is told for the keys that go on over its border, at most one a border.
    """
    one = F.lit(1) if count is None else count
    # Stored, since ranges must be the same wherever they are read.
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    total = ranged.groupBy("_part", *keys).agg(F.sum(one).alias("_before"))
    upto = F.sum("_before").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_before")
    before = total.withColumn("_before", upto).filter("_before > 0")
    inside = F.sum(one).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_n", inside).join(F.broadcast(before), ["_part", *keys], "left").withColumn("_n", F.col("_n") + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """``df`` with later equal names as ``x-1, x-2, ...``, skipping names that are taken; a null name stays null."""
    rows = df.filter(F.col(name).isNotNull()).select(F.col(name).alias("_base"), F.col(order).alias("_order"), F.struct(*df.columns).alias("_row"))
    ranked = running(rows, ["_base"], ["_order"]).withColumn("_at", F.col("_n") - 1)
    # Of the suffixes of a name that are taken, how many free ones lie below each.
    suffix = df.select(F.regexp_extract(name, "^(.*)-[1-9][0-9]*$", 1).alias("_base"), F.regexp_extract(name, "^.*-([1-9][0-9]{0,17})$", 1).try_cast("long").alias("_t")).filter("_t is not null").distinct()
    taken = running(suffix, ["_base"], ["_t"]).select("_base", (F.col("_t") - F.col("_n")).alias("_at"), F.lit(1).alias("_taken"))
    # The k-th free suffix lies above the taken ones with fewer free ones below.
    both = ranked.filter("_at > 0").select("_base", "_at", F.lit(0).alias("_taken"), "_row").unionByName(taken, allowMissingColumns=True)
    found = running(both, ["_base"], ["_at", "_taken"], F.col("_taken")).filter("_taken = 0")
    later = found.select("_row.*", F.concat("_base", F.lit("-"), F.col("_at") + F.col("_n")).alias("_new"))
    later = later.select(*[F.col("_new").alias(c) if c == name else F.col(c) for c in df.columns])
    return ranked.filter("_at = 0").select("_row.*").unionByName(later).unionByName(df.filter(F.col(name).isNull()))
