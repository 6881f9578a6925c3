"""Names, graphs and islands against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from cellgrid.operators import align, annotate, graph, qc, select, stats
from cellgrid.sources import mtx


def plain_unique(names):
    used, counts, out = set(names), {}, []
    for n in names:
        if n not in counts:
            counts[n] = 1
            out.append(n)
            continue
        while f"{n}-{counts[n]}" in used:
            counts[n] += 1
        used.add(f"{n}-{counts[n]}")
        out.append(f"{n}-{counts[n]}")
    return out


def test_unique_names_equal_a_loop(spark):
    rng = random.Random(1)
    for names in (["x", "x", *(f"x-{i}" for i in range(1, 7))], [rng.choice(["a", "a-1", "a-3", "a-1-2", "b", "b-01", "a-2"]) for _ in range(60)]):
        df = spark.createDataFrame(list(enumerate(names)), "i long, n string")
        assert [r.n for r in select.unique_names(df, "n", "i").orderBy("i").collect()] == plain_unique(names)


@pytest.fixture()
def ranges(spark):
    """Small shuffles keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_unique_names_over_many_ranges_equal_a_loop(spark, ranges):
    test_unique_names_equal_a_loop(spark)


def test_a_name_of_a_third_of_the_rows_is_numbered_in_many_tasks(spark, ranges):
    n = 200_000
    name = F.when(F.col("i") % 3 == 0, "hot").when(F.col("i") % 30 == 1, F.concat(F.lit("hot-"), F.col("i"))).otherwise(F.concat(F.lit("n"), F.col("i")))
    df = spark.range(n).withColumnRenamed("id", "i").withColumn("n", name)
    names = ["hot" if i % 3 == 0 else f"hot-{i}" if i % 30 == 1 else f"n{i}" for i in range(n)]
    got = {r.i: r.n for r in select.unique_names(df, "n", "i").collect()}
    assert [got[i] for i in range(n)] == plain_unique(names)
    ranged = select.running(df, ["n"], ["i"])
    whole = ranged.filter("n = 'hot'").agg(F.max("_n"), F.countDistinct("_n")).first()
    assert tuple(whole) == (66_667, 66_667)
    sizes = [r["count"] for r in df.repartitionByRange("n", "i").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 0.4 * n  # as `running` deals them


def test_names_with_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, None, 2.0), (2, "a", 3.0), (3, None, 4.0), (4, "", 5.0), (5, "", 6.0)], "i long, n string, v double")
    assert [tuple(r) for r in select.unique_names(df, "n", "i").orderBy("i").collect()] == [(0, "a", 1.0), (1, None, 2.0), (2, "a-1", 3.0), (3, None, 4.0), (4, "", 5.0), (5, "-1", 6.0)]
    assert select.unique_names(df.limit(0), "n", "i").collect() == []


def test_lines_are_numbered_across_splits(spark, ranges, tmp_path):
    import gzip

    lines = [f"line {i}\t{'x' * (i % 50)}" if i % 17 else "" for i in range(5000)]
    (tmp_path / "plain.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "dos.tsv").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "packed.tsv.gz").write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    (tmp_path / "empty.tsv").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        for name in ("plain.tsv", "dos.tsv", "packed.tsv.gz"):
            assert {r.pos: r.value for r in mtx.numbered_lines(spark, str(tmp_path / name)).collect()} == dict(enumerate(lines)), name
        assert mtx.numbered_lines(spark, str(tmp_path / "empty.tsv")).count() == 0
        assert spark.read.text(str(tmp_path / "plain.tsv")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_components_and_reachability(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(0, k) for k in range(100, 180)]
    nodes = [*range(80), *range(100, 180), 500]
    got = {r.node: (r.part, r.size) for r in graph.sized_components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    roots = sorted({find(n) for n in nodes})
    assert got == {n: (roots.index(find(n)), sum(find(m) == find(n) for m in nodes)) for n in nodes}
    chain = spark.createDataFrame([(str(i), str(i + 1), "is_a") for i in range(100)] + [("100", "99", "is_a")], "child string, parent string, rel string")
    assert annotate.closure(chain).filter("term = '0'").count() == 101  # deeper than 64, with a cycle


def test_islands_equal_a_sweep(spark):
    rng = random.Random(3)
    loci = [(rng.choice("ab"), s := rng.randrange(3000), s + rng.randrange(0, 12) + (900 if i % 150 == 0 else 0)) for i in range(600)]
    df = spark.createDataFrame(loci, "chrom string, start long, stop long").repartition(6)
    want = set()
    for c in "ab":
        group = []
        for s, e in sorted((s, e) for k, s, e in loci if k == c and e > s):
            if group and s >= max(x[1] for x in group):
                want |= {(c, *x, group[0][0], max(y[1] for y in group)) for x in group}
                group = []
            group.append((s, e))
        want |= {(c, *x, group[0][0], max(y[1] for y in group)) for x in group}
    assert {tuple(r) for r in align.islands(df).collect()} == want


def test_ranks_over_ranges(spark):
    rng = random.Random(4)
    values = [rng.choice([1.0, 2.5, rng.random()]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    assert qc.upper_median(df, "v") == sorted(values)[250]
    got = {r.p: r.value for r in stats.quantiles(df, "v").collect()}
    assert got == {p: sorted(values)[round(499 * p)] for p in (0.0, 0.25, 0.5, 0.75, 1.0)}
    assert qc.upper_median(df.filter(F.lit(False)), "v") is None


def test_prefix_tier(spark):
    df = spark.createDataFrame([(0, "cell1"), (1, "cell12"), (2, "other@b")], "col_id long, n string")
    asked = spark.createDataFrame([("cell1",), ("cell12@x",), ("cell",), ("other@b-1",), ("zz",)], "query string")
    got = {(r.query, r.col_id, r.tier) for r in select.membership_matches(df, "n", asked).collect()}
    assert got == {("cell1", 0, 0), ("cell12@x", 1, 1), ("cell", 0, 2), ("cell", 1, 2), ("other@b-1", 2, 1)}
