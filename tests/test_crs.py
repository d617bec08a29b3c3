"""Projections: published points, round trips, columns against numbers."""

import math

import pytest
from pyspark.sql import functions as F

from cellframe.functions import crs

POINTS = {
    "EPSG:32631": (4.9, 52.3), "EPSG:32601": (-179.5, 10.0), "EPSG:32733": (16.2, -33.9), "EPSG:25832": (9.7, 50.1), "EPSG:3035": (5.0, 50.0),
    "EPSG:2154": (2.3522, 48.8566), "EPSG:28992": (5.4, 52.2), "EPSG:3857": (-100.0, 40.0), "EPSG:4258": (1.0, 2.0),
}


def test_published_points():
    # Transverse Mercator on the Airy ellipsoid, azimuthal equal area: the worked examples of the EPSG guidance notes
    grid = crs.TransverseMercator((6377563.396, 1 / 299.32496), -2, 49, 0.9996012717, 400_000, -100_000)
    assert crs._Numbers.through(grid.from_wgs, 0.5, 50.5) == pytest.approx((577274.99, 69740.50), abs=0.02)
    assert crs.transform_point(5, 50, "EPSG:4326", "EPSG:3035") == pytest.approx((3962799.45, 2999718.85), abs=0.02)
    assert crs.transform_point(10, 52, "EPSG:4326", "EPSG:3035") == pytest.approx((4321000, 3210000), abs=1e-3)
    # origins, by definition
    assert crs.transform_point(3, 46.5, "EPSG:4326", "EPSG:2154") == pytest.approx((700000, 6600000), abs=1e-6)
    assert crs.transform_point(9, 0, "EPSG:4326", "EPSG:32632") == pytest.approx((500000, 0), abs=1e-6)
    assert crs.transform_point(9, 0, "EPSG:4326", "EPSG:32732") == pytest.approx((500000, 10000000), abs=1e-6)


@pytest.mark.parametrize("lat1, lat2", [(49, 44), (28 + 23 / 60, 30 + 17 / 60)])
def test_conic_keeps_scale_on_its_parallels(lat1, lat2):
    grid = crs.Conic(crs.GRS80, 3, 46.5, lat1, lat2, 0, 0)
    a, f = crs.GRS80
    for lat in (lat1, lat2):
        (x0, y0), (x1, y1) = (crs._Numbers.through(grid.from_wgs, 3 + d, lat) for d in (-1e-4, 1e-4))
        true = 2e-4 * crs.DEG * a * math.cos(lat * crs.DEG) / math.sqrt(1 - f * (2 - f) * math.sin(lat * crs.DEG) ** 2)
        assert math.hypot(x1 - x0, y1 - y0) == pytest.approx(true, rel=1e-7)


@pytest.mark.parametrize("code", POINTS)
def test_round_trip(code):
    lon, lat = POINTS[code]
    back = crs.transform_point(*crs.transform_point(lon, lat, "EPSG:4326", code), code, "EPSG:4326")
    # a centimetre; the Dutch polynomial is good to under a metre
    assert back == pytest.approx((lon, lat), abs=1e-5 if code == "EPSG:28992" else 5e-8)


def test_between_grids(spark):
    there = crs.transform_point(11.9, 48.3, "EPSG:4326", "EPSG:25832")
    x, y = crs.transform_columns(F.lit(there[0]), F.lit(there[1]), "EPSG:25832", "EPSG:25833")
    assert spark.range(1).select(x, y).first() == pytest.approx(crs.transform_point(11.9, 48.3, "EPSG:4326", "EPSG:25833"), abs=1e-4)
    x, y = crs.transform_columns(F.lit(None).cast("double"), F.lit(1.0), "EPSG:25832", "EPSG:2154")
    assert spark.range(1).select(x).first()[0] is None


def test_columns_equal_numbers(spark):
    out, wanted = [], []
    for code, (lon, lat) in POINTS.items():
        x, y = crs.transform_columns(F.lit(float(lon)), F.lit(float(lat)), "EPSG:4326", code)
        u, v = crs.transform_columns(x, y, code, "EPSG:4326")
        there = crs.transform_point(lon, lat, "EPSG:4326", code)
        out += [x, y, u, v]
        wanted += [*there, *crs.transform_point(*there, code, "EPSG:4326")]
    assert list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(out))).first()) == pytest.approx(wanted, rel=1e-11, abs=1e-6)


@pytest.mark.parametrize(
    "text, code",
    [
        ("epsg:32631", "EPSG:32631"),
        ("+init=epsg:28992", "EPSG:28992"),
        ("+proj=longlat +datum=WGS84 +no_defs", "EPSG:4326"),
        ("+proj=utm +zone=33 +south +datum=WGS84 +units=m +no_defs", "EPSG:32733"),
        ("+proj=utm +zone=32 +ellps=GRS80 +towgs84=0,0,0,0,0,0,0 +units=m", "EPSG:25832"),
        ('PROJCRS["x",BASEGEOGCRS["y"],ID["EPSG",3035]]', "EPSG:3035"),
        ('PROJCS["x",GEOGCS["y",AUTHORITY["EPSG","4258"]],AUTHORITY["EPSG","25832"]]', "EPSG:25832"),
    ],
)
def test_names(text, code):
    assert crs.normalise(text) == code


@pytest.mark.parametrize("text", ["EPSG:1", "EPSG:32661", "+proj=utm +zone=61 +datum=WGS84", "+proj=utm +zone=31 +datum=WGS84 +units=ft", "+proj=utm +zone=31 +ellps=bessel", "+proj=merc", "+proj=utm +zone=31 +ellps=GRS80 +towgs84=1,0,0", "nothing"])
def test_unknown(text):
    with pytest.raises(ValueError):
        crs.normalise(text)
