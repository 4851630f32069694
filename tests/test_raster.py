"""Tiled rasters: what points read, against dictionaries and plans."""

import re

import numpy as np
import pandas as pd
import pytest

from terrastat.sources import raster
from terrastat.sources.raster import Grid, raster_of, read_raster_window, sample_raster, write_raster

GRID = Grid(130, 16, (2.0, 0.0, 10.0, 0.0, 3.0, -5.0))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """100 x 130 pixels of three bands, some pixels and values missing."""
    rng = np.random.default_rng(1)
    rows = [
        (b, r, c, None if (r + c) % 9 == 0 else float(rng.normal()))
        for b in ("a", "b", "z")
        for r in range(100)
        for c in range(130)
        if (r * 131 + c) % 17
    ]
    path = str(tmp_path_factory.mktemp("r") / "raster")
    before, raster.GROUP_PIXELS = raster.GROUP_PIXELS, 512
    write_raster(spark.createDataFrame(rows, "band string, row long, col long, value double"), GRID, path)
    yield path, {(b, r, c): v for b, r, c, v in rows}
    raster.GROUP_PIXELS = before


def points(spark, n=300):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"id": np.arange(n), "x": rng.uniform(0, 300, n), "y": rng.uniform(-20, 330, n)})
    p.loc[p.id % 3 == 0, ["x", "y"]] = [50.5, 40.5]  # a third on one pixel
    return spark.createDataFrame(p)


@pytest.mark.parametrize("most", [200_000, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_values_under_points(spark, stored, monkeypatch, most, how):
    monkeypatch.setattr(raster, "MOST_KEYS", most)
    path, values = stored
    got = {r.id: r for r in sample_raster(points(spark), spark, path, GRID, ["z", "a"], how).collect()}
    seen = 0
    for p in points(spark).collect():
        r, c = int((p.y + 5.0) // 3.0), int((p.x - 10.0) // 2.0)
        there = ("a", r, c) in values
        if how == "inner":
            assert (p.id in got) == there
        if p.id in got:
            assert (got[p.id].row, got[p.id].col) == (r, c)
            assert (got[p.id].a, got[p.id].z) == (values.get(("a", r, c)), values.get(("z", r, c)))
            seen += there
    assert seen > 100


def test_folders_are_pruned_and_pixels_stay(spark, stored):
    path, _ = stored
    some = points(spark).where("id % 3 = 0")
    found = raster.pixels_at(spark, path, GRID, ["a"], raster.located_points(some, GRID))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "dynamicpruning" in plan and re.search(r"PartitionFilters: \[.*band", plan)
    assert re.search(r"BroadcastHashJoin LeftSemi", plan)
    assert found.count() == 1


def test_window(spark, stored):
    path, values = stored
    got = {(r.row, r.col): r.value for r in read_raster_window(spark, path, GRID, "b", 10, 30, 25, 20).collect()}
    assert got == {(r, c): v for (b, r, c), v in values.items() if b == "b" and 10 <= r < 35 and 30 <= c < 50}


def test_written_once_for_each_state_of_the_source(spark, tmp_path):
    src = str(tmp_path / "s")
    px = spark.createDataFrame([("a", 0, 0, 1.0)], "band string, row long, col long, value double")
    px.write.parquet(src)
    one = raster_of(spark.read.parquet(src), GRID, src)
    assert raster_of(spark.read.parquet(src), GRID, src) == one
    px.withColumn("row", px.row + 1).write.mode("append").parquet(src)
    two = raster_of(spark.read.parquet(src), GRID, src)
    assert two != one and spark.read.parquet(two).count() == 2
