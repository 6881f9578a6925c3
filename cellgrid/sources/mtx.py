"""MatrixMarket sets: reading, hashtag demultiplexing, and writing in the 10x layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import id_name, spelled_locus, type_kept
from ..matrix import MatrixError, SparseMatrix, from_triplets
from ..operators.select import keep_rows, running, unique_names
from ..plans.storage import listed, stored


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, value)`` of the lines of one side table, in file order, parts of a folder by name; compressed ones are known by their suffix."""
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line")]
    lines = spark.read.option("lineSep", "\n").text(path).select(F.rtrim("value", F.lit("\r")).alias("value"), *at)
    return running(lines, [], ["_file", "_block", "_line"]).select((F.col("_n") - 1).alias("pos"), "value")


def names_of(spark: SparkSession, path: str, n: int, what: str) -> DataFrame:
    """The ``n`` numbered lines of a side table that the header asks for; blank lines after the last name are left out, any other number is refused."""
    lines = numbered_lines(spark, path)
    blank = F.trim("value") == ""
    found = lines.agg(F.count("*").alias("n"), F.count_if(blank & (F.col("pos") < n)).alias("empty"), F.count_if(~blank & (F.col("pos") >= n)).alias("more")).first()
    if found.n < n or found.more or (found.n > n and found.empty):
        raise MatrixError(f"{path} has {found.n} lines for {n} {what}")
    return lines.filter(F.col("pos") < n)


def _named(paths: list[str], ending: str) -> str | None:
    exact = [p for p in paths if p.rsplit("/", 1)[1] == ending]
    fits = exact or [p for p in paths if p.endswith(ending)]
    if len(fits) > 1:
        raise MatrixError(f"{fits[0]} and {fits[1]} both end with {ending}")
    return fits[0] if fits else None


def found_sets(spark: SparkSession, folders: list[str], files: tuple[str, str, str] = ("matrix.mtx.gz", "features.tsv.gz", "barcodes.tsv.gz")) -> list[tuple[str, str, str, str]]:
    """``(folder, matrix, features, barcodes)`` of the folders and their subfolders, by name, that hold all three.

    A file is called as asked or ends so; where several end so and none is called so the set is refused.
    """
    out = []
    for folder in folders:
        inside = listed(spark, folder)
        for place, paths in [(folder, inside), *((p, listed(spark, p)) for p in inside)]:
            if all(any(p.endswith(f) for p in paths) for f in files):
                out.append((place, *(_named(paths, f) for f in files)))
    return out


def joined_words(value, most: int, sep: str):
    """The first words of a line joined by a separator."""
    return F.concat_ws(sep, F.slice(F.split(F.trim(value), r"\s+"), 1, most))


def read_mtx(spark: SparkSession, path: str, features: str | None = None, barcodes: str | None = None, select: str = "", remove: str = "", check: bool = True, repeated: str = "numbered") -> SparseMatrix:
    """A matrix from a coordinate file with optional side tables.

    Features are ``id, name, type`` (or one name), made unique, or with ``repeated="first"``
    only the first of a name stays; without a table rows and columns are numbered. Types may be selected
    or removed by words. A place given twice or out of range is refused, and so is a table of another length.
    """
    # The shape is the first line that is no comment, found by its place in one pass that counts the lines too.
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("at")).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = lines.agg(F.min(F.struct("at", "value")).alias("first"), F.count("*").alias("n")).first()
    shape = [int(x) for x in head.first.value.split()[:3]]
    if (found := head.n - 1) != shape[2]:
        raise MatrixError(f"{path} names {shape[2]} entries and has {found}")
    n = F.split(F.trim("value"), r"\s+")
    first = head.first["at"]
    body = lines.filter((F.col("at.file") != first.file) | (F.col("at.block") != first.block) | (F.col("at.line") != first.line)).withColumn("n", n)
    entries = body.select((F.get("n", F.lit(0)).cast("long") - 1).alias("row_id"), (F.get("n", F.lit(1)).cast("long") - 1).alias("col_id"), F.get("n", F.lit(2)).cast("double").alias("val"))
    entries = stored(entries, "entries") if check else entries  # four checks read them
    if features:
        p = F.split("value", "\t")
        table = names_of(spark, features, shape[0], "rows").withColumn("p", p).select(F.col("pos").alias("row_id"), spelled_locus(F.when(F.size("p") > 1, id_name(F.get("p", F.lit(0)), F.get("p", F.lit(1)))).otherwise(F.get("p", F.lit(0)))).alias("row_name"), F.coalesce(F.get("p", F.lit(2)), F.lit("")).alias("feature_type"))
        table = unique_names(table, "row_name", "row_id") if repeated == "numbered" else stored(table, "rows")
    else:
        table = spark.range(shape[0]).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("row_name"), F.lit("").alias("feature_type"))
    cells = unique_names(names_of(spark, barcodes, shape[1], "columns").select(F.col("pos").alias("col_id"), F.trim("value").alias("col_name")), "col_name", "col_id") if barcodes else spark.range(shape[1]).select(F.col("id").alias("col_id"), F.col("id").cast("string").alias("col_name"))
    m = from_triplets(entries, table, cells, {"producer": "mtx"}, check)
    if features and repeated == "first":
        m = keep_rows(m, m.features.groupBy("row_name").agg(F.min("row_id").alias("row_id")))
    if select or remove:
        kept = m.features.filter(type_kept(F.col("feature_type"), select, remove))
        m = m.with_(features=kept, entries=m.entries.join(kept.select("row_id"), "row_id", "left_semi"))
    return m


def demultiplexed(m: SparseMatrix, hashtags) -> tuple[SparseMatrix, DataFrame]:
    """Each cell named after its strongest hashtag, and ``(barcode, row_name, count)``.

    The first of equal tags wins; cells without tags go, and so do the tag rows.
    """
    tags = m.features.filter(hashtags)
    own = m.entries.join(tags.select("row_id", "row_name"), "row_id")
    best = own.groupBy("col_id").agg(F.max(F.struct("val", (-F.col("row_id")).alias("low"), "row_name")).alias("b"), F.sum("val").alias("all")).filter("all > 0")
    named = m.cells.join(best, "col_id").select("col_id", F.col("col_name").alias("barcode"), F.col("b.row_name").alias("row_name"), F.col("b.val").alias("count"))
    cells = named.select("col_id", F.concat_ws("@", "barcode", "row_name").alias("col_name"))
    rest = m.features.join(tags.select("row_id"), "row_id", "left_anti")
    entries = m.entries.join(rest.select("row_id"), "row_id", "left_semi").join(cells.select("col_id"), "col_id", "left_semi")
    return m.with_(entries=entries, features=rest, cells=cells), named.select("barcode", "row_name", "count")


def mtx_lines(m: SparseMatrix) -> DataFrame:
    """``(ord, value)``: lines of a coordinate file with rounded, 1-based entries."""
    shape = m.features.agg(F.count("*").alias("r")).crossJoin(m.cells.agg(F.count("*").alias("c"))).crossJoin(m.entries.agg(F.count("*").alias("n")))
    head = m.entries.sparkSession.createDataFrame([(F_ORDER[0], "%%MatrixMarket matrix coordinate integer general")], "o int, value string").select(F.struct("o", F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("r")).alias("ord"), "value")
    size = shape.select(F.struct(F.lit(F_ORDER[1]).alias("o"), F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("r")).alias("ord"), F.concat_ws(" ", "r", "c", "n").alias("value"))
    body = m.entries.select(F.struct(F.lit(F_ORDER[2]).alias("o"), F.col("col_id").alias("c"), F.col("row_id").alias("r")).alias("ord"), F.concat_ws(" ", F.col("row_id") + 1, F.col("col_id") + 1, F.round("val").cast("long")).alias("value"))
    return head.union(size).union(body)


F_ORDER = (0, 1, 2)


def write_mex(m: SparseMatrix, out: str, compress: bool = True) -> None:
    """``matrix.mtx``, ``features.tsv``, ``barcodes.tsv``: folders with parts in order, written side by side.

    The parts of a folder end to end, compressed or not, are the file.
    """
    codec = "gzip" if compress else "none"
    m = m.with_(entries=stored(m.entries, "entries"))
    last = lambda df: df.orderBy("ord").select("value").write.option("compression", codec)
    last(mtx_lines(m)).text(f"{out}/matrix.mtx")
    kind = F.col("feature_type") if "feature_type" in m.features.columns else F.lit("Gene Expression")
    last(m.features.select(F.col("row_id").alias("ord"), F.concat_ws("\t", "row_name", "row_name", kind).alias("value"))).text(f"{out}/features.tsv")
    last(m.cells.select(F.col("col_id").alias("ord"), F.col("col_name").alias("value"))).text(f"{out}/barcodes.tsv")


def ranked_argmax(m: SparseMatrix) -> DataFrame:
    """``(col_id, row_id, val)``: each column's largest entry, the first row among equals."""
    w = Window.partitionBy("col_id").orderBy(F.desc("val"), "row_id")
    return m.entries.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
