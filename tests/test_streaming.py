from cellgrid.operators import project
from cellgrid.sources.fragments import parse_lines, tile_counts
from cellgrid.streaming import fragments as stream
from pyspark.sql import functions as F
from tests.test_matrix import COLS, NO_COL, ROWS, matrix


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.tsv").write_text("chr1\t0\t30\tA\nchr1\t25\t40\tB\n")
    (src / "b.tsv").write_text("chr1\t5\t12\tA\nbad line\n")
    q = stream.stream_tile_counts(spark.readStream.option("maxFilesPerTrigger", 1).text(str(src)), 10, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = stream.total_counts(spark.read.parquet(str(tmp_path / "out"))).collect()
    want = tile_counts(parse_lines(spark.read.text(str(src))), 10).collect()
    assert sorted((r.chrom, r.tile, r.barcode, r.val) for r in got) == sorted(map(tuple, want)) and len(want) > 4


def test_projection_is_seeded_and_weighted(spark):
    m = matrix(spark)
    a = {r.col_id: r.vec for r in project.project(m, 4).collect()}
    assert a == {r.col_id: r.vec for r in project.project(m.with_(entries=m.entries.repartition(3)), 4).collect()} or all(max(abs(x - y) for x, y in zip(a[k], v)) < 1e-12 for k, v in a.items())
    assert a[NO_COL] == [0.0] * 4 and len(a) == COLS
    none = spark.createDataFrame([(i, 0.0) for i in range(ROWS)], "row_id long, weight double")
    assert all(not any(r.vec) for r in project.project(m, 4, weights=none).collect())
    codes = project.sign_groups(project.project(m, 4), 4, 3)
    assert codes.agg(F.max("code")).first()[0] < 8


def test_centred_batches_meet(spark):
    rows = [(i, [float(i % 5) + (4.0 if i % 2 else 0.0), float(i % 3)]) for i in range(40)]
    vecs = spark.createDataFrame(rows, "col_id long, vec array<double>")
    batches = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(40)], "col_id long, batch string")
    gap = lambda df: df.join(batches, "col_id").groupBy("batch").agg(F.avg(F.get("vec", F.lit(0))).alias("m")).orderBy("batch").collect()
    before, after = gap(vecs), gap(project.centred_batches(vecs, 2, batches, rounds=3))
    assert abs(after[1].m - after[0].m) < abs(before[1].m - before[0].m)


def test_poor_codes_fall_together():
    counts = [(0, "a", 3), (0, "b", 2), (1, "a", 4), (2, "a", 1), (3, "b", 1)]
    to = project.merged_codes(counts, 2, 2, 1)
    assert to[0] == to[1] == 0 and to[2] == to[3] == 2
