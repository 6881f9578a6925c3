"""HDF5 containers (10x matrices, h5ad); they need the optional h5py library."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..matrix import SparseMatrix


def read_hdf5(spark: SparkSession, path: str, group: str = "matrix") -> SparseMatrix:
    """A compressed-column group ``{data, indices, indptr, barcodes, features}``, columns read in slices by tasks.

    The file must lie where every executor can open it.
    """
    try:
        import h5py
    except ImportError as e:
        raise NotImplementedError("reading HDF5 needs h5py") from e
    with h5py.File(path) as f:
        g = f[group]
        rows, cols = (int(x) for x in g["shape"][:])
        barcodes = [b.decode() for b in g["barcodes"][:]]
        ids, labels = [b.decode() for b in g["features/id"][:]], [b.decode() for b in g["features/name"][:]]
        kinds = [b.decode() for b in g["features/feature_type"][:]] if "features/feature_type" in g else [""] * rows

    def run(parts):
        import numpy as np
        import pandas as pd

        with h5py.File(path) as f:
            g = f[group]
            for part in parts:
                a, b = int(part["col_id"].min()), int(part["col_id"].max()) + 1
                ptr = g["indptr"][a : b + 1]
                yield pd.DataFrame({"row_id": g["indices"][ptr[0] : ptr[-1]].astype("int64"), "col_id": np.repeat(np.arange(a, b), np.diff(ptr)), "val": g["data"][ptr[0] : ptr[-1]].astype("float64")})

    entries = spark.range(cols).select(F.col("id").alias("col_id")).mapInPandas(run, "row_id long, col_id long, val double")
    features = spark.createDataFrame([(i, f"{a}_{b}" if a != b else a, k) for i, (a, b, k) in enumerate(zip(ids, labels, kinds, strict=True))], "row_id long, row_name string, feature_type string")
    return SparseMatrix(entries, features, spark.createDataFrame(list(enumerate(barcodes)), "col_id long, col_name string"), {"producer": "10x"})
