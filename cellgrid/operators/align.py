"""Set algebra of matrices: union and intersection of rows, columns side by side or folded, merge and alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..matrix import MatrixError, SparseMatrix, common_meta
from ..plans.storage import stored
from .select import dense_ids

Canon = "Callable[[Column], Column]"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def named_rows(parts: list[SparseMatrix], canon=lambda c: c) -> DataFrame:
    """``(backend, row_id, name)`` of all rows under their canonical names."""
    return _union([m.features.select(F.lit(b).alias("backend"), "row_id", canon(F.col("row_name")).alias("name")) for b, m in enumerate(parts)])


def aligned_rows(parts: list[SparseMatrix], how: str = "union", canon=lambda c: c, at_least: int | None = None) -> DataFrame:
    """``(name, pos)`` in order of first appearance: rows of any backend, of all, or of at least so many."""
    need = at_least if at_least is not None else {"union": 1, "intersect": len(parts)}[how]
    seen = named_rows(parts, canon).groupBy("name").agg(F.countDistinct("backend").alias("n"), F.min(F.struct("backend", "row_id")).alias("first"))
    kept = seen.filter(F.col("n") >= need).withColumns({"_b": F.col("first.backend"), "_r": F.col("first.row_id")})
    ids = dense_ids(kept.withColumn("key", F.struct("_b", "_r")), "key")
    return kept.withColumn("key", F.struct("_b", "_r")).join(ids, "key").select("name", "pos")


def coverage(parts: list[SparseMatrix], rows: DataFrame, canon=lambda c: c) -> DataFrame:
    """``(name, backend, measured)`` for every aligned row and backend."""
    spark = rows.sparkSession
    here = named_rows(parts, canon).select("name", "backend").distinct().withColumn("measured", F.lit(True))
    frame = rows.select("name").crossJoin(F.broadcast(spark.range(len(parts)).select(F.col("id").cast("int").alias("backend"))))
    return frame.join(here, ["name", "backend"], "left").fillna(False, ["measured"])


def stacked_columns(parts: list[SparseMatrix], tags: list[str], columns: str = "disjoint", barcode=lambda c: c) -> DataFrame:
    """``(backend, col_id, tag, barcode, name, to_col)``: where ``stack`` puts each column of each part, and under which name."""
    tag = F.element_at(F.array(*map(F.lit, tags)), F.col("backend") + 1)
    cells = _union([m.cells.select(F.lit(b).alias("backend"), "col_id", barcode(F.col("col_name")).alias("barcode")) for b, m in enumerate(parts)])
    if columns == "union":
        if cells.groupBy("backend", "barcode").count().filter("count > 1").first():
            raise MatrixError("a barcode is given twice in one part")
        named = cells.withColumn("name", F.col("barcode"))
    else:
        named = cells.withColumn("name", F.concat_ws("@", "barcode", tag) if len(parts) > 1 else F.col("barcode"))
    key = "name" if columns == "union" else "_key"
    named = named.withColumns({"_key": F.struct("backend", "col_id"), "tag": tag})
    first = named.groupBy(key).agg(F.min("_key").alias("at"))
    ids = first.join(dense_ids(first, "at"), "at").select(key, F.col("pos").alias("to_col"))
    return named.join(ids, key).select("backend", "col_id", "tag", "barcode", "name", "to_col")


def stack(parts: list[SparseMatrix], tags: list[str], rows: str = "union", columns: str = "disjoint", canon=lambda c: c, barcode=lambda c: c, placed: DataFrame | None = None) -> SparseMatrix:
    """Several matrices as one.

    ``columns="disjoint"`` appends columns, named ``barcode@tag`` where there
    are several; ``"union"`` makes equal barcodes one column whose values are
    summed, a barcode given twice in one part is refused. Rows that fold to one
    name are summed. ``placed``: their ``stacked_columns``, where they are known.
    """
    names = aligned_rows(parts, rows, canon)
    # Further columns of a feature come from the first part that has it.
    described = _union([m.features.withColumns({"backend": F.lit(b), "name": canon(F.col("row_name"))}) for b, m in enumerate(parts)])
    others = [c for c in described.columns if c not in ("backend", "name", "row_id", "row_name")]
    more = described.groupBy("name").agg(F.min_by(F.struct(F.lit(0).alias("_"), *others), F.struct("backend", "row_id")).alias("more"))
    features = names.join(more, "name").select(F.col("pos").alias("row_id"), F.col("name").alias("row_name"), *[F.col(f"more.`{c}`") for c in others])
    row_map = named_rows(parts, canon).join(names, "name").select("backend", "row_id", F.col("pos").alias("to_row"))
    col_map = placed if placed is not None else stacked_columns(parts, tags, columns, barcode)
    entries = _union([m.entries.withColumn("backend", F.lit(b)) for b, m in enumerate(parts)])
    moved = entries.join(row_map, ["backend", "row_id"]).join(col_map, ["backend", "col_id"])
    summed = moved.groupBy(F.col("to_row").alias("row_id"), F.col("to_col").alias("col_id")).agg(F.sum("val").alias("val"))
    of = col_map.groupBy("to_col").agg(F.first("name").alias("col_name"), F.min(F.struct("backend", "tag")).alias("b"))
    out_cells = of.select(F.col("to_col").alias("col_id"), "col_name", F.col("b.tag").alias("batch"))
    return SparseMatrix(summed, features, out_cells, common_meta([m.meta for m in parts]))


def merge(parts: list[SparseMatrix], tags: list[str], common_rows: bool = False) -> SparseMatrix:
    """Columns of several matrices as ``name@tag``: equal rows in equal order are asked for, or the common ones are taken in the first's order."""
    if not common_rows:
        first = parts[0].features.select("row_id", "row_name")
        for m in parts[1:]:
            other = m.features.select("row_id", "row_name")
            if first.exceptAll(other).union(other.exceptAll(first)).first():
                raise MatrixError("the parts have other rows; ask for the common ones")
    return stack(parts, tags, "intersect" if common_rows else "union")


def merge_sorted(parts: list[SparseMatrix], tags: list[str]) -> SparseMatrix:
    """As ``merge`` on the common rows, in order of name."""
    m = stack(parts, tags, "intersect")
    ids = dense_ids(m.features, "row_name").select("row_name", "pos")
    to = m.features.join(ids, "row_name")
    return m.with_(entries=m.entries.join(to.select("row_id", "pos"), "row_id").select(F.col("pos").alias("row_id"), "col_id", "val"), features=to.drop("row_id").withColumnRenamed("pos", "row_id"))


def align(grid: list[list[SparseMatrix | None]]) -> list[list[SparseMatrix | None]]:
    """A grid of types (rows of the grid) by groups (columns): common rows within a type, common cells within a group, both in order of name."""
    types, groups = len(grid), len(grid[0])
    shared = lambda frames, key: reduce(lambda a, b: a.join(b, key, "left_semi"), frames)
    rows = [shared([m.features.select("row_name") for m in grid[t] if m], "row_name") for t in range(types)]
    cols = [shared([grid[t][g].cells.select("col_name") for t in range(types) if grid[t][g]], "col_name") for g in range(groups)]
    kept = [g for g in range(groups) if not cols[g].isEmpty()]

    def one(t: int, g: int) -> SparseMatrix | None:
        m = grid[t][g]
        if not m:
            return None
        r = m.features.join(dense_ids(rows[t].distinct(), "row_name"), "row_name").select("row_id", "row_name", "pos")
        c = m.cells.join(dense_ids(cols[g].distinct(), "col_name"), "col_name").select("col_id", "col_name", F.col("pos").alias("cpos"))
        e = m.entries.join(r, "row_id").join(c, "col_id").select(F.col("pos").alias("row_id"), F.col("cpos").alias("col_id"), "val")
        return m.with_(entries=e, features=r.select(F.col("pos").alias("row_id"), "row_name"), cells=c.select(F.col("cpos").alias("col_id"), "col_name"))

    return [[one(t, g) for g in kept] for t in range(types)]


def batch_names(paths: list[str]) -> list[str]:
    """Names of parts: the last folder, its parent before it where that repeats, then ``_k``."""
    parts = [p.rstrip("/").split("/") for p in paths]
    names = [p[-1] for p in parts]
    names = [f"{p[-2]}_{n}" if names.count(n) > 1 and len(p) > 1 else n for p, n in zip(parts, names, strict=True)]
    out: list[str] = []
    for n in names:
        k = sum(o == n or o.startswith(f"{n}_") and o[len(n) + 1 :].isdigit() for o in out)
        out.append(f"{n}_{k}" if k else n)
    return out


def joined_groups(m: SparseMatrix, table: DataFrame) -> DataFrame:
    """``(col_id, grp)`` by exact column name; a column without a group is refused."""
    out = m.cells.select("col_id", "col_name").join(table.select("col_name", "grp"), "col_name", "left").select("col_id", "col_name", "grp")
    if missing := out.filter("grp is null").first():
        raise MatrixError(f"no group for {missing.col_name}")
    return out.select("col_id", "grp")


def annotated(m: SparseMatrix, table: DataFrame, column: str) -> DataFrame:
    """``(col_id, <column>)`` by column name, an empty string where unknown."""
    return m.cells.select("col_id", "col_name").join(table.select("col_name", column), "col_name", "left").select("col_id", F.coalesce(column, F.lit("")).alias(column))


def islands(loci: DataFrame) -> DataFrame:
    """``loci(chrom, start, stop, ...)`` with ``lo, hi`` of their cluster: transitive overlaps, touching ones stay apart.

    Empty intervals and those without a chromosome belong to no cluster and are left out. Ranges of starts
    find their own clusters in one pass; a row a cluster then tells which go on over the border of a range.
    """
    kinds = dict(loci.dtypes)
    sorted_ = loci.filter("stop > start AND chrom IS NOT NULL").repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "stop").withColumn("_part", F.spark_partition_id())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chrom, lo, reach = None, 0, 0  # of the cluster that the last batch ended in
        for part in parts:
            if not part.num_rows:
                continue
            names = part.column("chrom").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            start, stop = (part.column(c).to_numpy(zero_copy_only=False) for c in ("start", "stop"))
            out = np.empty(len(start), start.dtype)
            edges = [0, *(np.flatnonzero(np.diff(code)) + 1), len(code)]
            for a, b in zip(edges, edges[1:], strict=False):
                name = names.dictionary[code[a]].as_py()
                far = np.maximum.accumulate(stop[a:b])
                before = np.concatenate([[start[a]], far[:-1]])
                if name == chrom:
                    before = np.maximum(before, reach)
                    far = np.maximum(far, reach)
                begins = start[a:b] >= before
                if name != chrom:
                    begins[0], lo = True, start[a]
                at = np.maximum.accumulate(np.where(begins, np.arange(b - a), -1))
                out[a:b] = np.where(at >= 0, start[a:b][np.maximum(at, 0)], lo)
                chrom, lo, reach = name, out[b - 1], far[-1]
            yield part.append_column("lo", pa.array(out))

    rows = stored(sorted_.mapInArrow(run, T.StructType([*sorted_.schema.fields, T.StructField("lo", sorted_.schema["start"].dataType)])), "loci")
    # Clusters of single ranges, and what reaches them from ranges before.
    own = rows.groupBy("chrom", "_part", "lo").agg(F.max("stop").alias("hi"))
    over = Window.partitionBy("chrom").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("chrom", "_part").agg(F.max("hi").alias("far")).withColumn("far", F.max("far").over(over))
    met = own.join(parts, ["chrom", "_part"]).withColumn("begin", F.when(F.col("far").isNull() | (F.col("lo") >= F.col("far")), F.col("lo")))
    last = met.groupBy("chrom", "_part").agg(F.max("begin").alias("last")).withColumn("before", F.max("last").over(over)).drop("last")
    named = met.join(last, ["chrom", "_part"]).select("chrom", "_part", "lo", "hi", F.coalesce("begin", "before").alias("whole"))
    ends = named.groupBy("chrom", "whole").agg(F.max("hi").alias("_hi"))
    clusters = named.join(ends, ["chrom", "whole"]).select("chrom", "_part", "lo", F.col("whole").alias("_lo"), "_hi")
    return rows.join(clusters, ["chrom", "_part", "lo"]).select(*loci.columns, F.col("_lo").cast(kinds["start"]).alias("lo"), F.col("_hi").cast(kinds["stop"]).alias("hi"))


def overlaps(left: DataFrame, right: DataFrame, bin_width: int) -> DataFrame:
    """Pairs of intervals ``(chrom, start, stop)`` that overlap, by an equi-join on bins; each pair once, in the bin where the later starts."""
    bins = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns], F.explode(F.sequence((F.col("start") / bin_width).cast("long"), ((F.col("stop") - 1) / bin_width).cast("long"))).alias("bin"), F.col("chrom"))
    both = bins(left, "l").join(bins(right, "r"), ["chrom", "bin"])
    meet = (F.col("l_start") < F.col("r_stop")) & (F.col("r_start") < F.col("l_stop"))
    return both.filter(meet & (F.col("bin") == (F.greatest("l_start", "r_start") / bin_width).cast("long"))).drop("bin", "chrom")
