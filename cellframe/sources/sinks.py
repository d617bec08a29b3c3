"""Writing features and rasters. Every task writes its own part; nothing is gathered on the driver unless one file is asked for."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs as crs_
from ..functions import geometry as geo
from ..plans.geometry import GeometryBlock
from ..plans.meta import Grid, dtype_max, step_of
from ..plans.raster import RasterBlock


def scratch(spark, name: str) -> str:
    """A fresh folder for passing data on, in the folder that driver and executors share. In local mode a temporary one does; on a cluster it would lose data, so it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        import atexit
        import shutil
        import tempfile

        base = tempfile.mkdtemp(prefix="cellframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _manifest(spark, url: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what),)], "value string").coalesce(1).write.mode("overwrite").text(f"{url}/manifest")


def _exported(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Columns by output name; nested ones as JSON text."""
    out = []
    for name, column in fields.items():
        if column not in df.columns:
            raise KeyError(f"column {column!r} isn't there")
        nested = isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType))
        out.append((F.to_json(column) if nested else F.col(f"`{column}`")).alias(name))
    return df.select(F.col("fid").alias("_fid"), "geom", *out)


class GeometryFileSink:
    """Features to files: a folder of Parquet (no extension), GeoJSON lines (.geojsonl), a WKT table (.csv), one GeoJSON collection (.geojson), or one file on the driver's disk (.gpkg, .shp, .gml)."""

    def __init__(self, source: GeometryBlock, url: str, fields: dict | None = None):
        if not isinstance(source, GeometryBlock):
            raise TypeError("features are needed")
        self.source, self.url = source, url
        self.fields = {c: c for c in sorted(source.columns)} if fields is None else dict(fields) if isinstance(fields, dict) else {c: c for c in fields}
        missing = set(self.fields.values()) - source.columns - {"fid"}
        if missing:
            raise ValueError(f"columns {sorted(missing)} aren't there")

    def write(self, spark, mode: str = "centroid", **request) -> None:
        url = self.url
        lonlat = url.endswith((".geojson", ".geojsonl"))
        crs = "EPSG:4326" if lonlat else crs_.normalise(request.get("projection") or self.source.projection)
        if request.get("geometry") is None:
            mode = "intersects"
        df = _exported(self.source.get_data(spark, mode=mode, **request), self.fields)
        if lonlat:
            here = crs_.normalise(request.get("projection") or self.source.projection)
            df = df.withColumn("geom", geo.transform(F.col("geom"), here, crs))
        if url.endswith(".csv"):
            df.withColumn("wkt", geo.wkt(F.col("geom"))).drop("geom").withColumnRenamed("_fid", "fid").write.option("header", True).csv(url)
        elif url.endswith(".geojsonl"):
            _features_json(df).write.text(url)
        elif url.endswith(".geojson"):
            # one document: its lines are gathered in a single task that streams them
            body = _features_json(df).select(F.concat(F.lit(""), F.col("value")).alias("value"))
            _one_collection(body).write.text(url)
        elif url.endswith((".gpkg", ".shp", ".gml")):
            from .single import write_single

            write_single(df, url, crs)
        elif "." in url.rsplit("/", 1)[-1]:
            raise ValueError(f"unknown extension of {url}")
        else:
            df.withColumnRenamed("_fid", "fid").write.parquet(f"{url}/features")
            _manifest(spark, url, {"crs": crs})


def _features_json(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c not in ("_fid", "geom")]
    rings = F.transform(F.col("geom.rings"), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    kind = F.col("geom.kind")
    point, line, polygon, multi = F.to_json(F.get(F.get(rings, F.lit(0)), F.lit(0))), F.to_json(F.get(rings, F.lit(0))), F.to_json(rings), F.to_json(F.transform(rings, lambda r: F.array(r)))
    coordinates = F.when(kind == "point", point).when(kind == "linestring", line).when(kind == "polygon", polygon).otherwise(multi)
    name = F.when(kind == "point", "Point").when(kind == "linestring", "LineString").when(kind == "polygon", "Polygon").otherwise("MultiPolygon")
    geometry = F.when(kind.isNull(), "null").otherwise(F.concat(F.lit('{"type": "'), name, F.lit('", "coordinates": '), coordinates, F.lit("}")))
    properties = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return df.select(F.concat(F.lit('{"type": "Feature", "id": '), F.coalesce(F.col("_fid").cast("string"), F.lit("null")), F.lit(', "properties": '), properties, F.lit(', "geometry": '), geometry, F.lit("}")).alias("value"))


def _one_collection(lines: DataFrame) -> DataFrame:
    def run(batches):
        first = True
        yield pd.DataFrame({"value": ['{"type": "FeatureCollection", "features": [']})
        for b in batches:
            text = [("" if first and k == 0 else ",") + v for k, v in enumerate(b["value"])]
            first = first and not text
            yield pd.DataFrame({"value": text})
        yield pd.DataFrame({"value": ["]}"]})

    return lines.coalesce(1).mapInPandas(run, "value string")


def write_features(source: GeometryBlock, spark, url: str, fields=None, tile_size=None, dry_run: bool = False, **request) -> None:
    """Features to a file or folder. Tiles deal the work by place; dry_run only validates."""
    if tile_size:
        from ..operators.vector import GeometryTiler

        source = GeometryTiler(source, tile_size, request.get("projection") or source.projection)
        request.setdefault("geometry", tuple(source.args[0].get_data(spark, mode="extent").first()))
    sink = GeometryFileSink(source, url, fields)
    if not dry_run:
        sink.write(spark, **request)


def write_raster(source: RasterBlock, spark, url: str, tile_size: int | tuple[int, int] = 256, **request) -> None:
    """A raster to a folder: Parquet cells by tile with a manifest, or, if url ends in .tif, a folder of GeoTIFF tiles of one frame; tiles without data are left out."""
    h, w = (tile_size, tile_size) if isinstance(tile_size, int) else tile_size
    start, stop = request.pop("start", None), request.pop("stop", None)
    grid = source.grid if request.get("bbox") is None else Grid.from_bbox(request["bbox"], request["width"], request["height"], request.get("projection") or source.projection)
    times = source.times(start, stop)
    df = source.get_data(spark, start=start, stop=stop, **request)
    df = df.withColumns({"ty": F.floor(F.col("i") / h).cast("int"), "tx": F.floor(F.col("j") / w).cast("int")})
    if url.endswith(".tif"):
        if len(times) != 1:
            raise ValueError("a GeoTIFF has one frame here; ask for one")
        _tiles(df, grid, source.dtype, h, w).write.mode("overwrite").parquet(url)
        return
    step = step_of(times)
    if len(times) > 1 and step is None:
        raise ValueError("frames are not equidistant")
    df.repartition("ty", "tx").write.partitionBy("ty", "tx").parquet(f"{url}/cells")
    _manifest(spark, url, {"grid": [grid.x0, grid.y0, grid.dx, grid.dy, grid.width, grid.height, grid.crs], "first": times[0].isoformat(), "delta": step.total_seconds() if step else None, "frames": len(times), "dtype": source.dtype, "dense": True})


def _tiles(df: DataFrame, grid: Grid, dtype: str, h: int, w: int) -> DataFrame:
    """(ty, tx, tif): each tile an encoded GeoTIFF; a tile has h x w cells, so its task is bounded."""
    from .files import encode_tiff

    none = dtype_max(dtype) if dtype != "bool" else None

    def run(key, p: pd.DataFrame) -> pd.DataFrame:
        ty, tx = map(int, key)
        if p["v"].isna().all():
            return pd.DataFrame({"ty": [], "tx": [], "tif": []})
        rows, cols = min(h, grid.height - ty * h), min(w, grid.width - tx * w)
        values = np.full((rows, cols), 0 if none is None else none, dtype="uint8" if dtype == "bool" else dtype)
        known = p[p["v"].notna()]
        values[known["i"] - ty * h, known["j"] - tx * w] = known["v"].astype(values.dtype)
        at = Grid(grid.x0 + tx * w * grid.dx, grid.y0 - ty * h * grid.dy, grid.dx, grid.dy, cols, rows, grid.crs)
        return pd.DataFrame({"ty": [ty], "tx": [tx], "tif": [encode_tiff(values, at, none)]})

    return df.groupBy("ty", "tx").applyInPandas(run, "ty int, tx int, tif binary")


def merge_features(spark, path: str, target: str, remove_source: bool = False) -> None:
    """GeoJSON lines of a folder as one GeoJSON file on the driver's disk, streamed feature by feature. An existing target is an IOError."""
    import os
    import shutil

    if os.path.exists(target):
        raise IOError(f"{target} exists")
    with open(target, "w", encoding="utf-8") as f:
        f.write('{"type": "FeatureCollection", "features": [')
        for k, r in enumerate(spark.read.text(path).toLocalIterator()):
            f.write(("," if k else "") + "\n" + r["value"])
        f.write("\n]}")
    if remove_source:
        shutil.rmtree(path)


def merge_tiles(spark, path: str, target: str) -> None:
    """GeoTIFF tiles of write_raster as files in a folder on the driver's disk, tile by tile, with a VRT index over them."""
    import os

    from .files import decode_raster

    if os.path.exists(target):
        raise IOError(f"{target} exists")
    os.makedirs(target)
    found = []
    for r in spark.read.parquet(path).toLocalIterator():
        name = f"{r['ty']}_{r['tx']}.tif"
        with open(f"{target}/{name}", "wb") as f:
            f.write(r["tif"])
        found.append((name, decode_raster(bytes(r["tif"]), name)[0]))
    if not found:
        return
    x0, y0, dx, dy = min(h.x0 for _, h in found), max(h.y0 for _, h in found), found[0][1].dx, found[0][1].dy
    width = round((max(h.x0 + h.width * dx for _, h in found) - x0) / dx)
    height = round((y0 - min(h.y0 - h.height * dy for _, h in found)) / dy)
    parts = "".join(
        f'<SimpleSource><SourceFilename relativeToVRT="1">{n}</SourceFilename><SourceBand>1</SourceBand><SrcRect xOff="0" yOff="0" xSize="{h.width}" ySize="{h.height}"/>'
        f'<DstRect xOff="{round((h.x0 - x0) / dx)}" yOff="{round((y0 - h.y0) / dy)}" xSize="{h.width}" ySize="{h.height}"/></SimpleSource>'
        for n, h in found
    )
    head = found[0][1]
    none = "" if head.none is None else f"<NoDataValue>{head.none}</NoDataValue>"
    with open(f"{target}/index.vrt", "w", encoding="utf-8") as f:
        f.write(f'<VRTDataset rasterXSize="{width}" rasterYSize="{height}"><SRS>{head.crs}</SRS><GeoTransform>{x0}, {dx}, 0, {y0}, 0, {-dy}</GeoTransform><VRTRasterBand dataType="{head.dtype}" band="1">{none}{parts}</VRTRasterBand></VRTDataset>')
