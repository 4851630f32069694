"""Scalar functions, preparation and sources on small tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from terrastat.config import PH_LABELS, SCORE_BINS
from terrastat.functions import scalar as fn
from terrastat.operators import index, prep
from terrastat.operators import summary as s
from terrastat.sources import sinks, tables


def column(spark, values, expr, kind="double"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in d.select("i", expr.alias("y")).orderBy("i").collect()]


def test_bins_are_right_closed_and_labels_repeat(spark):
    got = column(spark, [5.0, 5.01, 6.0, 6.5, 7.0, 7.01, 8.2, 9.0, None, float("nan")], fn.right_closed_bin("x", SCORE_BINS["pH"], PH_LABELS))
    assert got == [1, 2, 4, 5, 5, 4, 2, 1, None, None]


def test_finite_lower_edge_excludes_it(spark):
    assert column(spark, [0.0, 0.1, 1.0, 1.1], fn.right_closed_bin("x", [0, 1], ["in"])) == [None, "in", "in", None]


def test_bins_need_one_label_each():
    with pytest.raises(ValueError):
        fn.right_closed_bin(F.lit(1.0), [0, 1, 2], ["a"])


def test_decimal_comma_and_group_id(spark):
    assert column(spark, ["1,5", "2.5", "x", None], fn.decimal_comma("x"), "string") == [1.5, 2.5, None, None]
    assert column(spark, ["P_1_12", "P", "P_1_"], fn.group_id("x"), "string") == ["P_1", "P", "P_1_"]


def test_format_p(spark):
    assert column(spark, [0.0001234, 0.001, 0.05, None], fn.format_p("x")) == ["1.23e-04", "0.001", "0.050", ""]


def test_significant_digits(spark):
    assert column(spark, [123456.0, 0.0012345, -98.76, 0.0], fn.round_significant("x", 3)) == [123000.0, 0.00123, -98.8, 0.0]


def test_category_codes_round_half_to_even(spark):
    assert column(spark, [0.5, 1.5, 2.5, 2.6], fn.category_code("x")) == [0, 2, 2, 3]


def test_nodata_tolerance(spark):
    got = column(spark, [-9999.0, -9998.95, -9998.0, float("inf"), float("nan"), 3.0], fn.nodata_to_null("x", -9999.0))
    assert got == [None, None, -9998.0, None, None, 3.0]


def test_poisson_weights_have_mean_one(spark):
    d = spark.range(20000).select(fn.poisson_one(fn.hash_uniform(F.lit("1"), "id")).alias("w"))
    row = d.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v"), F.avg((F.col("w") == 0).cast("double")).alias("z")).first()
    assert row["m"] == pytest.approx(1, abs=0.03) and row["v"] == pytest.approx(1, abs=0.06) and row["z"] == pytest.approx(0.3679, abs=0.015)


def test_slope_levels_are_centred_and_scaled():
    for coding in ("cm", "log", "rank"):
        v = prep.slope_levels([5, 15, 25, 55, 85], coding)
        assert sum(v) == pytest.approx(0, abs=1e-12) and sum(x * x for x in v) == pytest.approx(4)
    with pytest.raises(ValueError):
        prep.slope_levels([1, 2], "feet")


def test_excluded_count_warns_above_ten_percent(spark):
    d = spark.createDataFrame([(1.0, None)] * 2 + [(1.0, 2.0)] * 8, "a double, b double")
    assert tuple(prep.excluded_count(d, ["a", "b"]).first()) == (10, 8, 2, True)


def test_available_columns_warn(spark):
    with pytest.warns(UserWarning):
        assert prep.available_columns(spark.range(1).withColumn("a", F.lit(1)), ["a", "b"]) == ["a"]


def test_missing_weight_is_an_error(spark):
    w = spark.createDataFrame([("pH", 0.5)], "name string, w double")
    with pytest.raises(PySparkException, match="missing weight"):
        prep.align_weights(w, "name", "w", {"pH": "pH_score", "K": "K_score"}).collect()


def test_index_needs_every_score(spark):
    d = index.weighted_index(spark.createDataFrame([(1.0, 0.5), (1.0, None)], "a double, b double"), {"a": 0.6, "b": 0.4})
    d = index.classify(d, "index_value")
    assert [tuple(r) for r in d.select("index_value", "method", "class").collect()] == [
        (pytest.approx(0.8), "complete_2_indicators", "High"),
        (None, "insufficient", None),
    ]
    assert index.class_mismatches(d, "index_value", "class").first()["n_mismatch"] == 0


def test_separator_detection(spark, tmp_path):
    for sep in ";,\t|":
        path = str(tmp_path / f"f{ord(sep)}.txt")
        with open(path, "w") as f:
            f.write(sep.join(["a", "b c", "d"]) + "\n" + sep.join(["1", "x", "2"]) + "\n")
        assert tables.read_delimited(spark, path).columns == ["a", "b c", "d"]
    one = str(tmp_path / "one.txt")
    with open(one, "w") as f:
        f.write("a\n1\n")
    with pytest.raises(ValueError):
        tables.read_delimited(spark, one)
    with pytest.raises(FileNotFoundError):
        tables.read_delimited(spark, str(tmp_path / "absent"))


def test_strict_numeric_scan(spark, tmp_path):
    schema = StructType([StructField("id", StringType()), StructField("v", DoubleType())])
    for text, ok in (("id;v\na;1.5\n", True), ("id;v\na;1,5\n", False)):
        path = str(tmp_path / f"{ok}.csv")
        with open(path, "w") as f:
            f.write(text)
        df = tables.read_semicolon(spark, path, schema, ["id", "v"], ["v"])
        if ok:
            assert df.first()["v"] == 1.5
        else:
            with pytest.raises(PySparkException):
                df.collect()
    with pytest.raises(ValueError, match="missing columns"):
        tables.read_semicolon(spark, path, schema, ["w"], [])


def test_window_read_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "px")
    d = spark.range(100).select(F.lit("a").alias("band"), (F.col("id") / 10).cast("long").alias("row"), (F.col("id") % 10).alias("col"))
    d.write.partitionBy("band").parquet(path)
    out = tables.read_window(spark.read.parquet(path), "a", 2, 3, 2, 4)
    assert out.count() == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(band" in plan and "GreaterThanOrEqual(row,2)" in plan


def test_materialise_once_keeps_the_first_result(spark, tmp_path):
    path = str(tmp_path / "c")
    assert sinks.materialise_once(spark.range(3), path).count() == 3
    assert sinks.materialise_once(spark.range(9), path).count() == 3


def test_tile_sink_exports_nodata(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 0, 0, 1.5), ("a", 1, 0, 1, None)], "response string, tile int, row int, col int, value double")
    sinks.write_tiles(d, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.schema["value"].dataType.simpleString() == "float"
    assert sorted(r["value"] for r in back.collect()) == [-9999.0, 1.5]


def test_id_check_counts_null_once(spark):
    d = spark.createDataFrame([("a",), ("a",), (None,), (None,), ("b",)], "id string")
    assert tuple(s.id_check(d, ["id"]).first()) == (5, 2, 2)


def test_missing_cells_and_grid(spark):
    d = spark.createDataFrame([("p", "X", 1), ("p", "X", 2), ("q", "Y", 1)], "plot string, site string, depth int")
    gaps = prep.missing_cells(d, "plot", "depth", [1, 2, 3], ["site"])
    assert sorted((r["plot"], r["depth"]) for r in gaps.collect()) == [("p", 3), ("q", 2), ("q", 3)]
    grid = prep.grid_cells(d, {"site": ["X", "Y"], "depth": [1, 2]}, [F.count(F.lit(1)).alias("n")])
    assert {(r["site"], r["depth"]): r["n"] for r in grid.collect()} == {("X", 1): 1, ("X", 2): 1, ("Y", 1): 1, ("Y", 2): None}
