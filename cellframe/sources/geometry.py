"""Feature sources: tables, files and a single geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import crs as crs_
from ..functions import geometry as geo
from ..plans.block import setting
from ..plans.geometry import FeatureContext, FeatureRequest, GeometryBlock, chosen


class TableFeatures(GeometryBlock):
    """A DataFrame with fid, geom and properties; features are in the order of `order`, or of fid."""

    def __init__(self, df: DataFrame, projection: str, order: str | None = None):
        super().__init__(df, crs_.normalise(projection), order)

    columns = property(lambda self: {c for c in self.args[0].columns if c not in ("fid", "geom")})
    projection = property(lambda self: self.args[1])

    def plan(self, ctx: FeatureContext, request: FeatureRequest) -> DataFrame:
        df, crs, order = self.args
        return chosen(df.withColumn("_ord", F.col(order or "fid").cast("long")), request, crs)


class GeometryWKTSource(GeometryBlock):
    """One feature from WKT, with id 0."""

    def __init__(self, wkt: str, projection: str):
        geo.parse_wkt(wkt)
        super().__init__(wkt, crs_.normalise(projection))

    columns = property(lambda self: set())
    projection = property(lambda self: self.args[1])

    def plan(self, ctx, request):
        df = ctx.spark.range(1).select(F.col("id").alias("fid"), F.col("id").alias("_ord"), geo.from_wkt(self.args[0]).alias("geom"))
        return chosen(df, request, self.args[1])


class GeometryFileSource(GeometryBlock):
    """Features of a file or folder: GeoJSON (a collection, or a feature per line), GeoPackage, shapefile, or Parquet as GeometryFileSink writes it. More features than geometry-limit are an error unless a limit is asked for; math.inf asks for all."""

    def __init__(self, url: str, layer: str | None = None, id_field: str | None = None):
        from .files import feature_schema

        super().__init__(url, layer, id_field)
        columns, crs = feature_schema(url, layer)
        object.__setattr__(self, "_columns", columns)
        object.__setattr__(self, "_crs", crs)

    columns = property(lambda self: {c for c, _ in self._columns} - {self.args[2]})
    projection = property(lambda self: self._crs)

    def plan(self, ctx, request):
        from .files import read_features

        url, layer, id_field = self.args
        df = read_features(ctx.spark, url, layer, self._columns)
        if id_field:
            df = df.withColumn("fid", F.col(id_field)).drop(id_field)
        guard = int(setting(ctx.spark, "geometry-limit"))
        return chosen(df, request, self._crs, ctx.spark, guard)
