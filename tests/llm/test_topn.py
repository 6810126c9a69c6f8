import datetime as dt
import decimal
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandwise.llm.topn import best_of_file, cluster_by_group, row_groups, top_n


def brute(rows, n):
    groups = {}
    for k, h, g, w, s, i in set(rows):
        if w is not None and w == w:
            groups.setdefault((k, h, None if g is None else g + 0.0), set()).add((-w, s is None, s or 0, i))
    return sorted(x[3] for v in groups.values() for x in sorted(v)[:n])


@pytest.mark.parametrize("size", [3, 100, 2000])
def test_against_brute_force(spark, size):
    rng = random.Random(5)
    rows = [(rng.choice(["HOT", "HOT", "A", "B", None]), rng.choice([4, 8]), rng.choice([None, 0.0, -0.0, 1.1]), rng.choice([None, float("nan"), 0.0, -0.0, 0.5, 0.25, 1.0]), rng.choice([None, *range(30)]), i) for i in range(3000)]
    rows += rows[:200]
    df = spark.createDataFrame([(*r, 0) for r in rows], "kmer string, halfwindow int, mingini double, windowed double, s long, peak_id long, place int")
    got = top_n(df, ["kmer", "halfwindow", "mingini"], "windowed", ["s", "peak_id"], 3, size)
    assert sorted(r.peak_id for r in got.collect()) == brute(rows, 3)
    assert top_n(df.limit(0), ["kmer"], "windowed", ["s", "peak_id"], 3).count() == 0


def test_row_groups_are_skipped(tmp_path):
    n = 10_000
    table = pa.table({"g": ["x"] * n, "w": sorted((k // 7 / 1000 for k in range(n)), reverse=True), "i": list(range(n))})
    pq.write_table(table, tmp_path / "f.parquet", row_group_size=500)
    read = list(best_of_file(pq.ParquetFile(tmp_path / "f.parquet"), ["g"], "w", ["i"], 5))
    assert len(read) == 1 and read[0].column("i").to_pylist() == [0, 1, 2, 3, 4]


def test_a_hot_group_is_hardly_read(spark, tmp_path):
    """Half of all rows in one group: of its row groups nearly none is read, and under half of all."""
    rng = random.Random(6)
    rows = [("HOT" if k % 2 else f"g{rng.randrange(2_000)}", rng.random(), k) for k in range(60_000)]
    df = spark.createDataFrame(rows, "g string, w double, i long")
    files = cluster_by_group(df, ["g"], "w", ["i"], str(tmp_path / "f"), 500)
    read, all_ = map(sum, zip(*[(r.n_read, r.n_all) for r in row_groups(files, ["g"], "w", ["i"], 3).collect()]))
    assert all_ >= 120 and read <= 75
    only_hot = cluster_by_group(df.where("g = 'HOT'"), ["g"], "w", ["i"], str(tmp_path / "h"), 500)
    read, all_ = map(sum, zip(*[(r.n_read, r.n_all) for r in row_groups(only_hot, ["g"], "w", ["i"], 3).collect()]))
    assert all_ >= 60 and read < all_ / 2


def test_other_types(spark):
    day = dt.date(2020, 1, 1)
    rows = [(day, True, decimal.Decimal("1.50"), dt.datetime(2020, 1, 1), 1), (day, True, decimal.Decimal("2.50"), None, 2), (None, True, decimal.Decimal("0.50"), None, 3), (day, False, None, None, 4)]
    df = spark.createDataFrame(rows, "d date, flag boolean, y decimal(10,2), t timestamp, i smallint")
    got = top_n(df, ["d", "flag"], "y", ["t", "i"], 1).collect()
    assert sorted(r.i for r in got) == [2, 3]
    with pytest.raises(ValueError):
        top_n(df, ["d"], "t", ["i"], 1)
