"""Pages from an index of ranges against a sorted list."""

import random

import pytest
from pyspark.sql import functions as F

from hirelake.operators import paging

ROWS = "g string, v string, id long"


def pages_of(rows, wanted, size, by):
    groups, found = {}, set()
    for g, v, i in rows:
        groups.setdefault(g if by else 0, []).append((g, v, i))
    for members in groups.values():
        members.sort(key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        last = -(-len(members) // size)
        for n in {last + 1 + w if w < 0 else w for w in wanted}:
            if 1 <= n <= last:
                found |= {(*r, n, at + 1, len(members)) for at, r in enumerate(members) if (n - 1) * size <= at < n * size}
    return sorted(found, key=str)


@pytest.mark.parametrize("by", [(), ("g",)])
def test_pages_equal_slices_of_the_sorted_list(spark, tmp_path, by):
    """Ties, nulls as keys and as a group, a group with most rows, pages that aren't there or are asked for twice."""
    r = random.Random(5)
    rows = [(r.choice(["a"] * 8 + ["b", "c", None]), r.choice([None, "", "x", "y", "y"]), i) for i in range(400)] + [("tiny", "z", 1000)]
    order, path, wanted = [F.asc("v"), F.asc("id")], str(tmp_path / "index"), [1, 2, 3, -1, -2, 999, -999]
    index = paging.build_index(spark.createDataFrame(rows, ROWS), path, order, by, ranges=9)
    got = paging.read_pages(index, order, wanted, 7, by).select("g", "v", "id", "page", "position", "total").collect()
    assert sorted(map(tuple, got), key=str) == pages_of(rows, wanted, 7, by)


def test_a_page_reads_its_ranges_alone(spark, tmp_path):
    path, order = str(tmp_path / "index"), [F.asc("id")]
    paging.build_index(spark.range(1000).toDF("id"), path, order, ranges=20)
    read = spark.read.parquet(path)
    page = paging.read_pages(read, order, [-1], 10)
    assert [row["id"] for row in page.orderBy("id").collect()] == list(range(990, 1000))
    assert read.where("id >= 990").select("_range").distinct().count() < read.select("_range").distinct().count() / 5
    assert "PartitionFilters: [" in page._jdf.queryExecution().toString() and "_range" in page._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_an_empty_table_has_no_pages(spark, tmp_path):
    path, order = str(tmp_path / "index"), [F.asc("v"), F.asc("id")]
    index = paging.build_index(spark.createDataFrame([], ROWS), path, order, ("g",))
    assert paging.read_pages(index, order, [1, -1], 10, ("g",)).collect() == []
