"""Round trips of files, sinks, and the streaming window."""

import json
import math
import sqlite3
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe import registry
from cellframe.functions import geometry as geo
from cellframe.plans.block import Block
from cellframe.plans.meta import Grid
from cellframe.sources import files, sinks
from cellframe.sources.geometry import GeometryFileSource, TableFeatures
from cellframe.sources.raster import MemorySource, ParquetSource, RasterFileSource
from cellframe.streaming.temporal import aggregate_stream

CRS = "EPSG:3857"
T0 = datetime(2000, 1, 1)


@pytest.fixture()
def features(spark):
    df = spark.createDataFrame([(5, 0.0, 1, "a", [1, 2], None), (6, 10.0, 2, None, [], 2.5)], "fid long, x double, n long, s string, lst array<int>, d double")
    return TableFeatures(df.withColumn("geom", geo.box(F.col("x"), F.col("x"), F.col("x") + 2, F.col("x") + 2)).drop("x"), CRS)


def listed(df):
    return [tuple(r) for r in df.orderBy("n").collect()]


def test_safe_path(tmp_path):
    assert files.safe_path("file:///a/b") == "/a/b" and files.safe_path("b/c", "/a") == "/a/b/c"
    with pytest.raises(IOError):
        files.safe_path("../x", "/a/b", strict=True)
    with pytest.raises(IOError):
        files.safe_path("/a/bc", "/a/b", strict=True)
    with pytest.raises(NotImplementedError):
        files.safe_path("http://x/y")


@pytest.mark.parametrize("name", ["out", "out.geojson", "out.geojsonl"])
def test_features_round_trip(spark, features, tmp_path, name):
    url = f"{tmp_path}/{name}"
    features.to_file(spark, url, fields={"n": "n", "text": "s", "lst": "lst", "d": "d"})
    source = GeometryFileSource(url)
    got = source.get_data(spark, projection=CRS)
    assert listed(got.select("n", "text", "lst", "d", F.round(geo.area(F.col("geom")), 6))) == [(1, "a", "[1,2]", None, 4), (2, None, "[]", 2.5, 4)]
    assert source.columns == {"n", "text", "lst", "d"} and {r["fid"] for r in got.collect()} == {5, 6}
    assert Block.from_json(source.to_json()).token == source.token


def test_sink_checks(spark, features, tmp_path):
    with pytest.raises(ValueError):
        features.to_file(spark, f"{tmp_path}/x", fields=["nothing"], dry_run=True)
    with pytest.raises(ValueError):
        features.to_file(spark, f"{tmp_path}/x.abc")
    features.to_file(spark, f"{tmp_path}/x", tile_size=5, dry_run=True)
    features.to_file(spark, f"{tmp_path}/tiles", tile_size=5)
    assert spark.read.parquet(f"{tmp_path}/tiles/features").count() == 2
    features.to_file(spark, f"{tmp_path}/t.csv", fields=["n"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/t.csv").filter("wkt like 'POLYGON%'").count() == 2


def test_geometry_limit(spark, features, tmp_path):
    features.to_file(spark, f"{tmp_path}/f")
    spark.conf.set("cellframe.geometry-limit", "1")
    try:
        with pytest.raises(RuntimeError):
            GeometryFileSource(f"{tmp_path}/f").get_data(spark)
        assert GeometryFileSource(f"{tmp_path}/f").get_data(spark, limit=1).count() == 1
    finally:
        spark.conf.unset("cellframe.geometry-limit")


def test_all_features_beyond_the_limit(spark, features, tmp_path):
    features.to_file(spark, f"{tmp_path}/f")
    spark.createDataFrame([(k, f"s{k}", k % 25, k / 2) for k in range(9)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.conf.set("cellframe.geometry-limit", "1")
    try:
        assert GeometryFileSource(f"{tmp_path}/f").get_data(spark, limit=math.inf).count() == 2
        got = registry.QUERIES["snk_geometry_roundtrip"](spark, f"{tmp_path}").orderBy("fid").collect()
        assert [tuple(r) for r in got] == [(k, f"s{k}", k / 2, float((1 + k % 3) ** 2)) for k in range(9)]
    finally:
        spark.conf.unset("cellframe.geometry-limit")


def test_feature_collection(spark, tmp_path):
    geometry = lambda k, c: {"type": k, "coordinates": c}
    rows = [geometry("Point", [1, 2]), geometry("LineString", [[0, 0], [1, 1]]), geometry("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]]), geometry("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]), None]
    found = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": g, "properties": {"n": k, "deep": {"a": k}, "mixed": k if k % 2 else f"{k}"}} for k, g in enumerate(rows)]}
    (tmp_path / "a.geojson").write_text(json.dumps(found))
    got = GeometryFileSource(f"{tmp_path}/a.geojson").get_data(spark).orderBy("n").collect()
    assert [r["geom"] and r["geom"]["kind"] for r in got] == ["point", "linestring", "polygon", "multipolygon", None] and got[1]["deep"] == '{"a": 1}' and got[1]["mixed"] == "1"


def test_geopackage(spark, tmp_path):
    path = tmp_path / "a.gpkg"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z INT, m INT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES ('land', 'shape', 'POLYGON', 28992, 0, 0)")
    con.execute("CREATE TABLE land (id INTEGER PRIMARY KEY, shape BLOB, name TEXT)")
    for k in range(3):
        wkb = files.to_wkb("polygon", geo.box_rings(k, 0, k + 1, 1))
        con.execute("INSERT INTO land VALUES (?, ?, ?)", (10 + k, b"GP\0\1" + struct.pack("<i", 28992) + wkb, f"n{k}"))
    con.commit()
    con.close()
    got = GeometryFileSource(str(path)).get_data(spark, geometry=(1.2, 0.2, 1.4, 0.4)).collect()
    assert [(r["fid"], r["name"]) for r in got] == [(11, "n1")]
    with pytest.raises(ValueError):
        GeometryFileSource(str(path), layer="sea")


def test_wkb():
    for kind, rings in (("point", [[(1, 2)]]), ("linestring", [[(0, 0), (1, 1)]]), ("polygon", geo.box_rings(0, 0, 1, 1)), ("multipolygon", geo.box_rings(0, 0, 1, 1) + geo.box_rings(5, 5, 6, 6))):
        got = files.from_wkb(files.to_wkb(kind, rings))
        assert got["kind"] == kind and [[(p["x"], p["y"]) for p in r] for r in got["rings"]] == rings


def test_shapefile(spark, tmp_path):
    shapes = b""
    for k in range(2):
        ring = geo.box_rings(k, 0, k + 1, 1)[0]
        body = struct.pack("<I4dIII", 5, k, 0, k + 1, 1, 1, len(ring), 0) + b"".join(struct.pack("<dd", *p) for p in ring)
        shapes += struct.pack(">II", k + 1, len(body) // 2) + body
    (tmp_path / "a.shp").write_bytes(struct.pack(">I20xI", 9994, (100 + len(shapes)) // 2) + struct.pack("<II8d", 1000, 5, *[0.0] * 8) + shapes)
    field = lambda n, k, s, d: n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([s, d]) + b"\0" * 14
    rows = b"".join(b" " + f"name{k}".encode().ljust(8) + f"{k + 0.5:6.2f}".encode() for k in range(2))
    (tmp_path / "a.dbf").write_bytes(bytes([3, 100, 1, 1]) + struct.pack("<IHH20x", 2, 32 + 64 + 1, 15) + field("label", "C", 8, 0) + field("size", "N", 6, 2) + b"\r" + rows)
    got = GeometryFileSource(f"{tmp_path}/a.shp").get_data(spark).orderBy("fid").select("label", "size", geo.area(F.col("geom"))).collect()
    assert [tuple(r) for r in got] == [("name0", 0.5, 1), ("name1", 1.5, 1)]


def cells(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect()}


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9\n1 2 3\n4 -9 6\n")
    source = RasterFileSource(f"{tmp_path}/a.asc")
    assert source.grid == Grid(10, 30, 5, 5, 3, 2, CRS)
    assert cells(source.get_data(spark)) == {(0, 0): 1, (0, 1): 2, (0, 2): 3, (1, 0): 4, (1, 1): None, (1, 2): 6}


@pytest.mark.parametrize("kind", ["uint8", "int32", "float32", "float64"])
def test_geotiff(spark, tmp_path, kind):
    values = np.arange(12, dtype=kind).reshape(3, 4)
    grid = Grid(135000, 456000, 0.5, 0.5, 4, 3, "EPSG:28992")
    (tmp_path / "a.tif").write_bytes(files.encode_tiff(values, grid, 5))
    source = RasterFileSource(f"{tmp_path}/a.tif")
    assert source.grid == grid and source.dtype == kind
    got = cells(source.get_data(spark))
    assert got == {(i, j): None if values[i, j] == 5 else values[i, j] for i in range(3) for j in range(4)}


def test_raster_sinks(spark, tmp_path):
    data = np.arange(2 * 5 * 7, dtype="uint8").reshape(2, 5, 7)
    source = MemorySource(data, 3, CRS, 2, (0, 10), T0, timedelta(hours=1))
    source.to_file(spark, f"{tmp_path}/r", tile_size=3, start=T0, stop=T0 + timedelta(hours=1))
    again = ParquetSource(f"{tmp_path}/r")
    assert again.period == source.period and again.timedelta == source.timedelta and again.dtype == "uint8"
    for t in source.all_times:
        assert cells(again.get_data(spark, start=t)) == cells(source.get_data(spark, start=t))
    plan = again.get_data(spark, start=T0, bbox=(0, 0, 4, 4), width=2, height=2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(t," in plan
    source.to_file(spark, f"{tmp_path}/t.tif", tile_size=4, start=T0)
    tiles = spark.read.parquet(f"{tmp_path}/t.tif").collect()
    assert len(tiles) == 4
    head, values = files.decode_raster(bytes(next(r["tif"] for r in tiles if (r["ty"], r["tx"]) == (1, 1))), "x.tif")
    assert (head.x0, head.y0, head.width, head.height) == (8, 2, 3, 1) and values[0].tolist() == data[0, 4:, 4:].tolist()
    with pytest.raises(ValueError):
        source.to_file(spark, f"{tmp_path}/u.tif", start=T0, stop=T0 + timedelta(hours=1))


@pytest.mark.parametrize("kind", ["gpkg", "shp"])
def test_single_files(spark, features, tmp_path, kind):
    url = f"{tmp_path}/a.{kind}"
    features.to_file(spark, url, fields=["n", "s", "lst", "d"])
    source = GeometryFileSource(url)
    assert source.columns == {"n", "s", "lst", "d"}
    got = source.get_data(spark).select("n", "s", "lst", "d", geo.area(F.col("geom")))
    assert listed(got) == [(1, "a", "[1,2]", None, 4), (2, None, "[]", 2.5, 4)]
    with pytest.raises(IOError):
        features.to_file(spark, url)


def test_gml(spark, features, tmp_path):
    from xml.etree import ElementTree

    features.to_file(spark, f"{tmp_path}/a.gml", fields=["n"])
    root = ElementTree.parse(f"{tmp_path}/a.gml").getroot()
    assert len(root.findall(".//{http://www.opengis.net/gml/3.2}Polygon")) == 2 and sorted(e.text for e in root.findall(".//{urn:cellframe}n")) == ["1", "2"]


def test_merged_files(spark, features, tmp_path):
    features.to_file(spark, f"{tmp_path}/lines.geojsonl")
    sinks.merge_features(spark, f"{tmp_path}/lines.geojsonl", f"{tmp_path}/one.geojson", remove_source=True)
    assert len(json.loads((tmp_path / "one.geojson").read_text())["features"]) == 2 and not (tmp_path / "lines.geojsonl").exists()
    with pytest.raises(IOError):
        sinks.merge_features(spark, f"{tmp_path}/lines.geojsonl", f"{tmp_path}/one.geojson")
    source = MemorySource(np.arange(16, dtype="uint8").reshape(4, 4), 255, CRS, 1, (0, 4))
    source.to_file(spark, f"{tmp_path}/t.tif", tile_size=3)
    sinks.merge_tiles(spark, f"{tmp_path}/t.tif", f"{tmp_path}/all")
    assert (tmp_path / "all" / "index.vrt").read_text().count("<SimpleSource>") == 4
    assert cells(RasterFileSource(f"{tmp_path}/all/1_0.tif").get_data(spark)) == {(0, j): 12 + j for j in range(3)}


def test_stream(spark, tmp_path):
    rows = [(T0 + timedelta(minutes=10 * k), 0, k % 2, k) for k in range(12)]
    spark.createDataFrame(rows, "t timestamp_ntz, i int, j int, v long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp_ntz, i int, j int, v long").parquet(f"{tmp_path}/in")
    query = aggregate_stream(stream, "1h", "sum", "2 hours").writeStream.outputMode("complete").format("memory").queryName("totals").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r["t"], r["j"], r["v"]) for r in spark.table("totals").collect())
    assert got == [(T0, 0, 6), (T0, 1, 9), (T0 + timedelta(hours=1), 0, 24), (T0 + timedelta(hours=1), 1, 27)]
    with pytest.raises(ValueError):
        aggregate_stream(stream, "1h", "median")
    with pytest.raises(ValueError):
        aggregate_stream(stream, "ME", "sum")


def test_strict_paths(spark, tmp_path):
    spark.conf.set("cellframe.strict-file-paths", "true")
    spark.conf.set("cellframe.root", str(tmp_path))
    try:
        with pytest.raises(IOError):
            RasterFileSource("/etc/a.asc")
    finally:
        spark.conf.unset("cellframe.strict-file-paths")
        spark.conf.unset("cellframe.root")


def test_scratch_is_shared(spark):
    assert sinks.scratch(spark, "x") != sinks.scratch(spark, "x")


def test_geojson_schema_is_of_all_rows(spark, tmp_path):
    """What differs after the first hundred lines counts as well."""
    point = {"type": "Point", "coordinates": [1.0, 2.0]}
    props = [{"n": k, "late": None, "text": k} for k in range(150)] + [{"n": 0.5, "late": 7, "text": "word", "new": True}]
    (tmp_path / "a.geojsonl").write_text("".join(json.dumps({"type": "Feature", "geometry": point, "properties": p}) + "\n" for p in props))
    got = GeometryFileSource(f"{tmp_path}/a.geojsonl").get_data(spark)
    assert {c: t for c, t in got.dtypes if c in ("n", "late", "text", "new")} == {"n": "double", "late": "bigint", "text": "string", "new": "boolean"}
    rows = got.select("n", "late", "text", "new").collect()
    assert len(rows) == 151 and [tuple(r) for r in rows if r["new"]] == [(0.5, 7, "word", True)]
    assert sorted(r["n"] for r in rows) == [0.0, 0.5, *map(float, range(1, 150))]
